import random

from quernstone.operators import history, rules


def test_sets_are_compared_whole(spark):
    draw = random.Random(4)
    rows = [(g, draw.choice("abcd")) for g in range(60) for _ in range(draw.randint(1, 6))] + [(100, None), (101, "a"), (101, None)]
    sides = rows, [(g, m) for g, m in rows if g % 3 == 0] + [(900, "z")]
    sets = [{g: frozenset(m for k, m in side if k == g and m) for g, _ in side} for side in sides]
    frames = [spark.createDataFrame(side, "g long, m string") for side in sides]
    got = {(r.g, r.n) for r in rules.without_same_sets(*frames, "g", "m").collect()}
    assert got == {(g, len(s)) for g, s in sets[0].items() if s not in sets[1].values()} and (100, 0) in got
    nothing = spark.createDataFrame([], "g long, m string")
    assert rules.without_same_sets(nothing, frames[0], "g", "m").count() == 0
    assert rules.without_same_sets(frames[0], nothing, "g", "m").count() == len(sets[0])
    both = spark.createDataFrame([(1, None)], "g long, m string")
    assert rules.without_same_sets(both, both, "g", "m").count() == 0


def test_equal_digests_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(rules.F, "xxhash64", lambda *c: rules.F.lit(0))  # all sets of a size collide
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z")], "g long, m string")
    b = spark.createDataFrame([(5, "y"), (5, "x")], "g long, m string")
    assert [r.g for r in rules.without_same_sets(a, b, "g", "m").collect()] == [2]


def test_fields_a_kind_needs(spark):
    rows = [(1, "code", "d", ("p", "s")), (2, " CODE", "", ("p", None)), (3, None, "d", None), (4, "logical", None, None), (None, "logical", "d", ("p", "s")), (6, "", "d", ("", "s"))]
    df = spark.createDataFrame(rows, "id int, kind string, domain string, code struct<path:string,symbol:string>")
    got = rules.incomplete_by_kind(df, "kind", {"code": ["id", "domain", "code.path", "code.symbol"]}, default="code", always=["id"])
    assert {r.id: r.missing for r in got.collect()} == {2: ["domain", "code.symbol"], 3: ["code.path", "code.symbol"], None: ["id"], 6: ["code.path"]}


def test_histories_of_entities(spark):
    deltas = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 3), ("b", 3), ("b", 99)], "uid string, op long")
    log = spark.createDataFrame([(i, i // 2, f"r{i}") for i in range(40)], "op long, revision long, reason string")
    got = history.entity_history(deltas, log, "a", uid="uid", operation="op", revision="revision").collect()
    want = sorted(range(40), key=lambda i: (-(i // 2), i))[:30]
    assert [r.op for r in got] == want
    every = history.entity_histories(deltas, log, uid="uid", operation="op", revision="revision").collect()
    assert sorted((r.seq, r.op) for r in every if r.uid == "a") == list(enumerate(want, 1))
    assert [r.op for r in every if r.uid == "b"] == [3, 3]  # an operation out of the log is none of the history


def test_sizes_of_empty_tables(spark):
    empty = spark.createDataFrame([], "kind string, raw string, after string, published timestamp")
    got = {(r.section, r["name"], r.n, r.n_bytes) for r in history.size_report(empty, "kind", "raw", empty, "raw", "after", empty, empty, "published").collect()}
    assert got == {("records", "all", 0, 0), ("changes", "all", 0, 0), ("operations", "all", 0, 0), ("pending", "all", 0, 0)}
