import random

import pytest
from pyspark.sql import functions as F

from quernstone.operators import digest as tree
from quernstone.operators import publish
from quernstone.operators.publish import Conflict, Journal
from quernstone.operators.store import Damaged, Locked, Store

EDITS = "uid string, seq long, op string, field string, value string"


def rows(spark, n, **changed):
    return spark.range(n).select(F.concat(F.lit("u"), "id").alias("uid"), F.col("id").alias("ordinal"), F.create_map(F.lit("a"), F.col("id").cast("string"), F.lit("pad"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 4)).alias("fields"))


def content(df):
    return {r.uid: (r.ordinal, r.revision, r.fields.get("a")) for r in df.collect()}


def whole_digest(records):
    return tree.root(tree.tree(records.select("ordinal", "uid", tree.record_digest(F.col("uid"), F.col("fields")).alias("digest"))))


@pytest.fixture(scope="module")
def edited(spark, tmp_path_factory):
    """A store after an import, two patches and a replacement, and what was expected at each revision."""
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"), buckets=4)
    want = {1: {f"u{i}": (i, 1, str(i)) for i in range(3000)}}
    store.import_records(rows(spark, 3000), actor="t")
    for rev, keys in ((2, [5, 700]), (3, [5, 2999])):
        edits = spark.createDataFrame([(f"u{k}", 1, "set", "a", f"new{rev}") for k in keys], EDITS)
        assert store.apply_patches(edits, actor="t", reason="r", expected=rev - 1) == rev
        want[rev] = want[rev - 1] | {f"u{k}": (k, rev, f"new{rev}") for k in keys}
    now = store.read().where("ordinal <> 10").select("uid", F.when(F.col("ordinal") == 11, 5000).when(F.col("ordinal") == 20, 21).when(F.col("ordinal") == 21, 20).otherwise(F.col("ordinal")).alias("ordinal"), "fields")
    now = now.unionByName(spark.createDataFrame([("fresh", 10, {"a": "f"})], "uid string, ordinal long, fields map<string,string>"))
    assert store.replace(now, actor="t", reason="r", expected=3) == 4
    want[4] = {k: v for k, v in want[3].items() if k != "u10"} | {"fresh": (10, 4, "f"), "u11": (5000, 1, "11"), "u20": (21, 1, "20"), "u21": (20, 1, "21")}
    return store, want


def test_every_revision_reads_as_it_was(spark, edited):
    store, want = edited
    for rev, records in want.items():
        assert content(store.read(rev)) == records
        assert store.digest(rev) == whole_digest(store.read(rev).repartition(7))
    assert len({store.digest(r) for r in want}) == 4
    kinds = {(r.operation, r.kind): r.n for r in store.log().groupBy("operation", "kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {(1, "record.upsert"): 3000, (2, "record.patch"): 2, (3, "record.patch"): 2, (4, "record.delete"): 1, (4, "record.upsert"): 1, (4, "records.reorder"): 1}
    with pytest.raises(ValueError, match="no revision"):
        store.read(9)


def test_writes_grow_with_the_patch(spark, edited):
    store, _ = edited
    base = publish.size(spark, f"{store.folder}/base")
    assert 3 * publish.size(spark, f"{store.folder}/delta") < base
    assert all(d["rows"] <= 5 for d in store.state()["deltas"])
    plan = store._records(store.state(), [1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_compaction_keeps_content_digest_and_history(spark, edited):
    store, want = edited
    before = store.digest()
    assert store.doctor() == dict.fromkeys(("distinct", "log", "digest", "places"), True)
    store.compact()
    assert store.state()["deltas"] == [] and store.digest() == before and store.revision() == 4
    for rev in (4, 3):
        assert content(store.read(rev)) == want[rev]
    assert store.apply_patches(spark.createDataFrame([("fresh", 1, "clear", "a", None)], EDITS), actor="t", reason="r", expected=4) == 5
    assert store.digest() == whole_digest(store.read()) and store.doctor()["digest"]
    held = content(store.read())
    gone = store.vacuum(2)
    assert [x.split("/")[0] for x in gone] == ["base", "delta", "delta", "delta", "log", "log", "log"]
    assert content(store.read()) == held and content(store.read(4)) == want[4] and all(store.doctor().values())
    with pytest.raises(ValueError, match="no revision"):
        store.read(3)
    assert {r.operation for r in store.log().select("operation").distinct().collect()} == {4, 5} and store.vacuum(2) == []


def test_random_changes_bring_the_digest_along(spark):
    r = random.Random(1)
    at = {f"u{i}": i * 3 for i in range(900)}
    text = {u: "0" for u in at}
    table = lambda: spark.createDataFrame([(o, u, tree_digest(u, text[u])) for u, o in at.items()], "ordinal long, uid string, digest string")
    tree_digest = lambda u, t: f"{u}={t}"
    stored = {0: spark.createDataFrame(tree.leaves(table()).collect(), f"idx long, members {tree.MEMBERS}, digest string")}
    nodes = spark.createDataFrame(tree.tree(table()).collect(), "level int, idx long, digest string")
    for _ in range(3):
        was = dict(at)
        free = sorted(set(range(4000)) - set(at.values()))
        for u in r.sample(sorted(at), 12):
            what = r.choice(["text", "move", "go"])
            if what == "go":
                del at[u]
            elif what == "move":
                at[u] = free.pop(r.randrange(len(free)))
            else:
                text[u] += "x"
        new = f"v{r.random()}"
        at[new], text[new] = free.pop(), "n"
        touched = [u for u in {*was, *at} if was.get(u) != at.get(u) or len(text[u]) > 1]
        changes = spark.createDataFrame([(u, was.get(u), at.get(u), tree_digest(u, text[u])) for u in touched], "uid string, was long, ordinal long, digest string")
        made = {}

        def write(df, level):
            made[level] = spark.createDataFrame(df.collect(), df.schema)
            return made[level].select("idx", "digest")

        top = tree.update(lambda level: nodes.where(F.col("level") == level).select("idx", "digest"), stored[0], changes, write)
        want = spark.createDataFrame(tree.tree(table()).collect(), "level int, idx long, digest string")
        assert top == tree.root(want)
        nodes = want
        stored[0] = spark.createDataFrame(tree.leaves(table()).collect(), f"idx long, members {tree.MEMBERS}, digest string")
        assert made[0].count() <= 26


def test_a_reorder_changes_the_digest_and_a_partitioning_does_not(spark):
    one = rows(spark, 700)
    other = one.withColumn("ordinal", F.when(F.col("ordinal") == 3, 4).when(F.col("ordinal") == 4, 3).otherwise(F.col("ordinal")))
    assert whole_digest(one) == whole_digest(one.repartition(9, "uid")) != whole_digest(other)
    assert whole_digest(one.limit(0)) is None


@pytest.mark.parametrize("step", ["stage records", "stage log", "audit", "stage digest", "publish"])
def test_a_crash_at_any_step_leaves_the_old_version(spark, tmp_path, step):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    store.import_records(rows(spark, 50), actor="t")
    before, old = store.digest(), content(store.read())

    def crash(name):
        if name == step:
            raise KeyboardInterrupt(name)

    edits = spark.createDataFrame([("u3", 1, "set", "a", "z")], EDITS)
    broken = Store(spark, str(tmp_path / "s"), on_step=crash)
    with pytest.raises(KeyboardInterrupt):
        broken.apply_patches(edits, actor="t", reason="r", expected=1)
    again = Store(spark, str(tmp_path / "s"))
    assert again.revision() == 1 and again.digest() == before and content(again.read()) == old
    lost = again.recover()
    assert bool(lost) == (step != "stage records") and again.doctor()["places"]
    assert again.apply_patches(edits, actor="t", reason="r", expected=1) == 2 and content(again.read())["u3"] == (3, 2, "z")


def test_a_migration_is_verified_before_it_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a"))
    assert store.migrate(rows(spark, 40), actor="t") == 1 and store.doctor()["log"]
    twice = rows(spark, 5).unionByName(rows(spark, 1))
    with pytest.raises(ValueError, match="repeated"):
        Store(spark, str(tmp_path / "b")).migrate(twice, actor="t")

    def spoil(step):
        if step == "audit":
            base = tmp_path / "c" / "base"
            publish.remove(spark, f"{base}/{publish.children(spark, str(base))[0]}/records/bucket=1")

    with pytest.raises(Damaged):
        Store(spark, str(tmp_path / "c"), buckets=2, on_step=spoil).migrate(rows(spark, 40), actor="t")
    assert Store(spark, str(tmp_path / "c")).revision() == 0


def test_of_two_writers_one_is_refused_and_locks_hold(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s"), buckets=2) for _ in range(2))
    one.import_records(rows(spark, 20), actor="one")
    edits = spark.createDataFrame([("u3", 1, "set", "a", "z")], EDITS)

    def meanwhile(step):
        if step == "publish":
            two.on_step = lambda s: None
            two.set_locked("two", True)

    late = Store(spark, str(tmp_path / "s"), on_step=meanwhile)
    with pytest.raises(Conflict):  # the lock came between the look and the publishing
        late.apply_patches(edits, actor="one", reason="r", expected=1)
    with pytest.raises(Locked):
        one.apply_patches(edits, actor="one", reason="r", expected=1)
    with pytest.raises(Locked):
        one.set_locked("one", True)
    fence = two.set_locked("two", True)
    assert two.apply_patches(edits, actor="two", reason="r", expected=1, fence=fence) == 2
    two.set_locked("two", False)
    assert one.set_locked("one", True) == fence + 1
    with pytest.raises(Locked):
        two.apply_patches(edits, actor="two", reason="r", expected=2, fence=fence)
    one.set_locked("one", False)
    with pytest.raises(Locked):  # a number that has been given back
        two.apply_patches(edits, actor="one", reason="r", expected=2, fence=fence + 1)


def test_entries_of_a_journal_are_published_once(spark, tmp_path):
    a, b = Journal(spark, str(tmp_path / "j")), Journal(spark, str(tmp_path / "j"))
    assert a.last() == 0
    for n in range(1, 12):
        a.append(n, {"n": n, "half": n // 2})
    with pytest.raises(Conflict):
        b.append(11, {"n": 0, "half": 0})
    assert b.last() == a.last() == 11 and b.get(11) == {"n": 11, "half": 5} and b.last_with("half", 3) == 7 and b.last_with("half", -1) == 0
    assert [n for n in publish.children(spark, str(tmp_path / "j")) if not n.startswith(".")] == [f"{n:020d}.json" for n in range(1, 12)]


def test_work_folders_go_with_clean(spark):
    folder = publish.work_folder(spark)
    spark.range(3).write.parquet(f"{folder}/t")
    assert publish.exists(spark, folder) and publish.clean(spark) >= 1 and not publish.exists(spark, folder)
