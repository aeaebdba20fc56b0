import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.operators import analysis, graph, inference, suggestions
from quernstone.plans import QUERIES

R = random.Random(3)


def test_profiles_take_all_words_of_all_documents(spark, tmp_path):
    texts = [(i, "ab"[i % 3 == 0] if i != 5 else None, " ".join(R.choice("one two three four five six Seven 8th".split()) for _ in range(R.randint(3, 90)))) for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams, profile = {}, defaultdict(Counter)
    for i, lang, t in texts:
        w = [x for x in t.lower().split() if x != "8th"]
        grams[i] = Counter((n, tuple(w[k:k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1))
        profile[lang] += grams[i]
    want = {(i, lang): sum({1: 2.0, 2: 5.0, 3: 8.0}[g[0]] * min(c, p[g]) for g, c in grams[i].items()) for i in grams for lang, p in profile.items()}
    got = {(r.doc_id, r.lang): r.score for r in QUERIES["profile_ranking"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v >= 6}


def test_scores_of_items_in_several_rows(spark):
    rows = [(1, "a", ["x", "y", "x"]), (2, "b", ["x", "y"]), (3, None, []), (4, "b", None), (5, None, ["y", "x", "y"])]
    once = spark.createDataFrame(rows, "item int, label string, words array<string>")
    general = lambda df: analysis.profile_scores(analysis.gram_profile(df, "item", "words"), analysis.gram_profile(df, "label", "words"), "item", "label")
    for df in (once, once.unionByName(once.where("item = 1").withColumn("label", F.lit("b")))):
        assert {tuple(r) for r in analysis.label_scores(df, "item", "label", "words").collect()} == {tuple(r) for r in general(df).collect()}
    assert analysis.label_scores(once.limit(0), "item", "label", "words").count() == 0


def test_similar_outcomes_look_at_every_unit(spark, tmp_path):
    rows = [(i, u, a, v) for i, (u, a, v) in enumerate([(1, "x", 3.5), (2, "x", 3.1), (3, "x", 3.9), (4, "x", 4.0)] * 4 + [(u, "y", 7.0) for u in range(30)] + [(5, "x", 4.2), (6, "x", None)])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    units = defaultdict(set)
    for i, u, a, v in rows:
        if i % 4:
            units[a, v if v is None else int(v)].add(u)
    got = {(r.action, r.resource): r.n for r in QUERIES["similar_outcome"](spark, str(tmp_path)).collect()}
    assert got == {k: len(u) for k, u in units.items() if 2 <= len(u) <= 8} and got


def test_shortest_paths_have_no_depth_bound(spark):
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(29)], "source int, target int, ord int")
    got = {r.node: r.path for r in graph.shortest_paths(edges, spark.createDataFrame([(0,)], "id int")).collect()}
    assert got == {n: list(range(n + 1)) for n in range(1, 30)}


def test_selections_of_any_size_are_whole(spark, tmp_path):
    from quernstone.operators.catalogue import SELECTION_LIMIT

    n = 2 * SELECTION_LIMIT + 3
    spark.range(n).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 2 == 1, "A").otherwise("B").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    assert QUERIES["bounded_selection"](spark, str(tmp_path)).count() == n // 2 > SELECTION_LIMIT


def test_purposes_of_many_units_are_compared_by_their_words(spark):
    objects = ["part list", "part 1 list", "part list part 2", "list", "", None, "part 3 list now", "2 part"]
    units = [(i, R.choice(["find", "get", "build", None]), R.choice(objects)) for i in range(60)]
    known = [(i, R.choice(["find", "get", "send", "build"]), R.choice(objects), f"P{i}") for i in range(1, 40, 2)]
    want = {}
    for i, action, thing in units:
        exact = [t for _, a, o, t in known if a == action and o == thing and None not in (a, o)]
        near = [(-len(set(o.split(" ")) & set(thing.split(" "))), n, t) for n, a, o, t in known if o is not None and thing is not None and action in ("find", "get") and a in ("find", "get")]
        near = [t for n, _, t in sorted(near) if n <= -2]
        if exact or near:
            want[i] = (exact or near)[0]
    schema = "action string, object string"
    got = suggestions.existing_purpose(spark.createDataFrame(units, f"id int, {schema}"), spark.createDataFrame(known, f"ord int, {schema}, text string"), ["find", "get"])
    assert {r.id: r.text for r in got.collect()} == want
    many = spark.range(30_000).select("id", F.lit("find").alias("action"), F.concat(F.lit("part "), F.col("id") % 7, F.lit(" list")).alias("object"))
    theirs = many.select(F.col("id").alias("ord"), "action", F.lit("part list now").alias("object"), F.concat(F.lit("P"), "id").alias("text"))
    began = time.monotonic()
    assert suggestions.existing_purpose(many, theirs, ["find"]).where("text = 'P0'").count() == 30_000
    assert time.monotonic() - began < 60  # 900 million pairs otherwise


def test_connections_of_modules_need_no_shuffle_of_pairs(spark):
    rows = [(i, f"m{i % 3}", f"f{i % 4}", f"m{i % 3}.q{i}" if i % 2 else None) for i in range(24)] + [(5, "m0", "g", None), (7, None, "f1", None), (None, "m1", "f2", None)]
    boxes = spark.createDataFrame(rows, "id int, module string, symbol string, qualified_name string")
    calls = [("m0", "f1"), ("m0", "m1.f1"), ("m1", "m0.q3"), ("m1", "f2"), ("m2", "m0.f3"), ("m2", "m0.q3"), ("m2", "none"), ("m0", "f1"), ("m0", "g")]
    imports = [("m0", "m1"), ("m0", "m2"), ("m1", "m1"), ("m2", "m9")]
    last = lambda pick: max((r[0] for r in rows if r[0] is not None and pick(r)), default=None)
    want = defaultdict(set)
    for m, name in calls:
        q = last(lambda r: r[3] == name)
        head, dot, tail = name.rpartition(".")
        at = q if q is not None else last(lambda r: r[1] == (head if dot else m) and r[2] == (tail if dot else name))
        for r in rows:
            if at is not None and r[1] == m and r[0] not in (None, at):
                want[r[0], at, "uses", "high"].add(f"call:{name}")
    for m, other in imports:
        for r in rows:
            for o in rows:
                if r[1] == m and o[1] == other and r[0] != o[0] and None not in (r[0], o[0]):
                    want[r[0], o[0], "depends_on", "medium"].add(f"import:{other}")
    got = inference.connections(boxes, spark.createDataFrame(calls, "module string, name string"), spark.createDataFrame(imports, "module string, imported string"))
    assert {tuple(r)[:4]: r.evidence for r in got.collect()} == {k: sorted(v) for k, v in want.items()}
    large = spark.range(6000).select("id", (F.col("id") % 2).cast("string").alias("module"), F.lit("f").alias("symbol"), F.lit(None).cast("string").alias("qualified_name"))
    none, both = spark.createDataFrame([], "module string, name string"), spark.createDataFrame([("0", "1")], "module string, imported string")
    # pairs are the output of the join: no exchange stands above the one that gives them
    pairs = inference.connections(large, none, both)
    assert pairs.count() == 9_000_000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert plan[0].startswith("Union") and not any("Aggregate" in line for line in plan[1:next(i for i, line in enumerate(plan) if "Join" in line)])


def test_grams_are_counted_in_slices_of_a_batch():
    lists = pa.array([[f"w{R.randrange(50)}" for _ in range(n)] for n in [3000] * 200 + [0, 300_000, 5]] + [None], pa.list_(pa.string()))
    ids = pa.array(range(len(lists)))
    batch = pa.RecordBatch.from_arrays([ids, ids, lists], names=["item", "label", "tokens"])
    got = list(analysis._of_items((1, 2))(iter([batch])))
    total = Counter()
    for b in got:
        assert len(set(b.column(0).to_pylist())) <= 88  # 2**18 words
        for i, w in zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True):
            total[i] += w
    assert total == Counter({i: 2 * len(x) - 1 for i, x in enumerate(lists.to_pylist()) if x})
