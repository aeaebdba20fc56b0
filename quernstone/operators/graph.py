"""Graph operators over edge tables (source, target): closures, paths, impact, components, invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .publish import work_folder

#: Relationships that watch or govern and carry no load.
CONTROL = ["observes", "monitors", "scales_on", "governed_by", "policy_for"]
MAX_DEPTH = 24


def _cut(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage: write df in the folder that the cluster names, and read it again.

    A table that is read carries no inferred constraints, which would pile up over the rounds.
    It stays until publish.clean(), or until the session ends.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nodes_of(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Known nodes, and unknown ones for endpoints that no block declares."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return blocks.select("id", "kind").unionByName(ends.join(blocks.select("id"), "id", "left_anti").withColumn("kind", F.lit("unknown")))


def without_control(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("relationship").isin(CONTROL))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def distances(edges: DataFrame, start: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin, node, depth) of every node reachable from start (a column `id`), each at its least depth.

    The frontier of one round is joined with the edges and stripped of what is
    known; an origin is not reachable from itself, whatever the cycles.
    """
    steps = edges.select("source", "target").distinct()
    known = frontier = _cut(start.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.join(steps, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node")).distinct()
        frontier = _cut(ahead.join(known, ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)  # each round writes its frontier alone
    return known.where("depth > 0")


def path_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (source, target) with `exists`; a node always reaches itself."""
    reach = distances(edges, pairs.select(F.col("source").alias("id"))).select(F.col("origin").alias("source"), F.col("node").alias("target"), F.lit(True).alias("_r"))
    return pairs.join(reach, ["source", "target"], "left").select("source", "target", (F.coalesce("_r", F.lit(False)) | (F.col("source") == F.col("target"))).alias("exists"))


def shortest_paths(edges: DataFrame, start: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(origin, node, path): a shortest path to each node; ties follow the edges' `ord`."""
    steps = edges.groupBy("source", "target").agg(F.min("ord").alias("ord"))
    known = frontier = _cut(start.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.array("id").alias("path"), F.array().cast("array<long>").alias("ords")).distinct())
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ahead = frontier.join(steps, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node"), F.array_append("path", F.col("target")).alias("path"), F.array_append("ords", F.col("ord").cast("long")).alias("ords"))
        ahead = ahead.join(known.select("origin", "node"), ["origin", "node"], "left_anti")
        frontier = _cut(ahead.groupBy("origin", "node").agg(F.min(F.struct("ords", "path")).alias("b")).select("origin", "node", "b.path", "b.ords"))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known.where("origin <> node").select("origin", "node", "path")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each undirected component, by shrinking labels."""
    both = edges.select("source", "target").union(reverse(edges)).distinct()
    both = _cut(both.union(both.select("source", F.col("source").alias("target")).distinct()))
    labels = _cut(both.groupBy(F.col("source").alias("node")).agg(F.min("target").alias("component")))
    while True:
        spread = both.join(labels, F.col("target") == F.col("node")).groupBy(F.col("source").alias("node")).agg(F.min("component").alias("c"))
        # a label's own label is at most as large: jump to it
        jump = labels.select(F.col("node").alias("j"), F.col("component").alias("to"))
        new = _cut(spread.join(jump, F.col("c") == F.col("j"), "left").select("node", F.coalesce("to", "c").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "was"), "node").where("component <> was")
        if changed.isEmpty():
            return new
        labels = new


def impact(edges: DataFrame, changed: DataFrame, nodes: DataFrame, critical: str = "critical") -> DataFrame:
    """(id, reach): changed, direct (neighbours either way) or transitive (both closures)."""
    ids = changed.select("id").distinct()
    ahead = distances(edges, ids).select(F.col("node").alias("id"), "depth")
    back = distances(reverse(edges), ids).select(F.col("node").alias("id"), "depth")
    met = ahead.unionByName(back).groupBy("id").agg(F.min("depth").alias("depth")).join(ids, "id", "left_anti")
    out = met.select("id", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("reach"))
    return ids.withColumn("reach", F.lit("changed")).unionByName(out).join(nodes.select("id", critical), "id", "left")


def is_systemic(impacted: DataFrame, n_nodes: int, critical: str = "critical") -> DataFrame:
    """One row: how many are impacted, and whether that counts as systemic."""
    out = impacted.where("reach <> 'changed'").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(critical), F.lit(False)).alias("c"))
    return out.select("n", (F.col("c") | (F.col("n") >= max(5, n_nodes // 2))).alias("systemic"))


def maximal_paths(edges: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path) of all simple paths from nodes without incoming edges (all nodes, if there are none) that end where they cannot go on."""
    steps = edges.select("source", "target").where("source <> target").distinct()
    sources = steps.select("source").distinct()
    roots = sources.join(steps.select(F.col("target").alias("source")), "source", "left_anti")
    roots = sources if roots.isEmpty() else roots
    live, done = _cut(roots.select(F.array("source").alias("path"))), []
    for _ in range(max_depth - 1):
        grown = live.withColumn("at", F.element_at("path", -1)).join(steps, F.col("at") == F.col("source"), "left")
        grown = grown.withColumn("ok", F.col("target").isNotNull() & ~F.array_contains("path", F.coalesce("target", "at")))
        ended = grown.groupBy("path").agg(F.bool_or("ok").alias("any")).where(~F.col("any") & (F.size("path") > 1)).select("path")
        done.append(ended)
        live = _cut(grown.where("ok").select(F.array_append("path", F.col("target")).alias("path")))
        if live.isEmpty():
            break
    else:
        done.append(live)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def out_degree_bounds(edges: DataFrame, nodes: DataFrame, least: int, most: int) -> DataFrame:
    """Nodes whose out-degree is outside the bounds."""
    deg = edges.select("source", "target").distinct().groupBy("source").agg(F.count("*").alias("degree"))
    out = nodes.join(deg, F.col("id") == F.col("source"), "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.where((F.col("degree") < least) | (F.col("degree") > most))


def failover_overload(edges: DataFrame, nodes: DataFrame, amplification: float = 1.0) -> DataFrame:
    """Edges whose target cannot take the source's load on top of its own."""
    a = nodes.select(F.col("id").alias("source"), F.col("load").alias("source_load"))
    b = nodes.select(F.col("id").alias("target"), F.col("load").alias("target_load"), F.col("capacity"))
    return edges.join(a, "source").join(b, "target").withColumn("demand", F.col("target_load") + F.col("source_load") * amplification).where("demand > capacity")


def capacity_margin(nodes: DataFrame, margin: float) -> DataFrame:
    """Nodes whose capacity is below their load with a margin."""
    return nodes.where(F.col("capacity") < F.col("load") * (1 + margin))


def amplification(paths: DataFrame, factors: DataFrame, budget: float) -> DataFrame:
    """Paths on which the product of at least two factors over 1 is beyond the budget."""
    rows = paths.withColumn("_p", F.array_join("path", ">")).select("_p", F.explode("path").alias("id")).join(factors.where("factor > 1"), "id")
    return rows.groupBy(F.col("_p").alias("path")).agg(F.count("*").alias("n"), F.product("factor").alias("amplification")).where((F.col("n") > 1) & (F.col("amplification") > budget))


def too_many_active(states: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """Rules of which more than `most` (component, state) pairs hold."""
    hit = rules.join(states, ["component", "state"])
    return hit.groupBy("rule").agg(F.count("*").alias("active")).where(F.col("active") > most)


def all_hold(states: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of which all (component, state) pairs hold."""
    hit = rules.join(states.withColumn("_h", F.lit(1)), ["component", "state"], "left")
    return hit.groupBy("rule").agg(F.count("*").alias("n"), F.count("_h").alias("h")).where("n = h").select("rule", "n")


def relation_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (source, target, wanted) whose edge is there but forbidden, or lacking but required."""
    have = edges.select("source", "target").distinct().withColumn("_h", F.lit(True))
    return rules.join(have, ["source", "target"], "left").where(F.coalesce("_h", F.lit(False)) != F.col("wanted")).select("source", "target", "wanted")


def blind_spots(edges: DataFrame, nodes: DataFrame, scalers: DataFrame) -> DataFrame:
    """(controller, node): upstream nodes that limit what a scaler sees, and that its controller does not observe."""
    up = distances(reverse(edges), scalers.select(F.col("observed").alias("id"))).select(F.col("origin").alias("observed"), F.col("node").alias("id"))
    cap = nodes.select("id", "capacity")
    rows = scalers.join(cap.select(F.col("id").alias("observed"), F.col("capacity").alias("seen")), "observed").join(up, "observed").join(cap, "id").where("capacity < seen")
    watched = scalers.select("controller", F.col("observed").alias("id"))
    return rows.select("controller", "id").distinct().join(watched, ["controller", "id"], "left_anti")
