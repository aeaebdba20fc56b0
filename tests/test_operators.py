import pytest
from pyspark.sql import functions as F

from quernstone.functions import scalars as s
from quernstone.operators import graph, history, reconcile, rules
from quernstone.operators.store import Conflict, Store, table_digest
from quernstone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, s.canonical_json(F.lit('{"b": 1, "a": [1, 2]}'))) == '{"a":[1,2],"b":1}'
    assert one(spark, s.shard_name(F.lit(" Big / Area!! "))) == "big_area"
    assert one(spark, s.shard_name(F.lit("!!"))) == "uncategorized"
    assert one(spark, s.identifier_tokens(F.lit("parseHTTPRequest2"))) == ["parse", "http", "request", "2"]
    assert one(spark, s.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert one(spark, s.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, s.template_variables(F.lit("{{ b }} ${a} {{b}}"))) == ["a", "b"]
    assert one(spark, s.moved_path(F.lit("src/a.py"), "src", "lib")) == "lib/a.py"
    assert one(spark, s.moved_path(F.lit("srcs/a.py"), "src", "lib")) == "srcs/a.py"
    assert one(spark, s.spreadsheet_safe(F.lit("@sum(A1)"))) == "'@sum(A1)"
    assert one(spark, s.sql_effect(F.lit("UPDATE  users SET a=1"))).asDict() == {"verb": "update", "target": "users"}
    assert one(spark, s.first_sentence(F.lit("Do it. Then stop."))) == "Do it"
    assert one(spark, s.parse_value(F.lit("None"))) == "null"
    assert len(one(spark, s.stable_uid(F.lit("block"), F.lit("a"), F.lit(1)))) == 36


def test_drift_pairing_and_moves(spark):
    d, o = (spark.createDataFrame(r, "p string, k string") for r in ([("a", "class"), ("m", "function")], [("a", "class"), ("u", "function")]))
    assert {tuple(r) for r in reconcile.drift(d, o, ["p", "k"]).collect()} == {("m", "function", "MISSING_DECLARED"), ("u", "function", "UNDECLARED")}
    before = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, name string, v string")
    after = spark.createDataFrame([(1, "a", "x"), (9, "b", "q"), (8, "n", "n")], "id int, name string, v string")
    got = {tuple(r) for r in reconcile.pair_by_priority(after, before, ["id", "name"], "v").collect()}
    assert got == {(1, 1, "same"), (9, 2, "modified"), (8, None, "created"), (None, 3, "removed")}


def test_group_sizes(spark):
    rows = [(1, "h", "strong"), (2, "h", "strong"), (3, "g", "weak"), (4, "g", "weak"), (5, "z", "weak")]
    got = rules.group_size(spark.createDataFrame(rows, "id int, h string, strength string"), ["h"], "strength").orderBy("id").collect()
    assert [(r.group_size, r.duplicated) for r in got] == [(2, "yes"), (2, "yes"), (2, "check"), (2, "check"), (1, "no")]


def test_graph_in_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 1, 3), (3, 4, 4)], "source int, target int, ord int")
    start = spark.createDataFrame([(1,)], "id int")
    assert {(r.node, r.depth) for r in graph.distances(e, start).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {r.node: r.path for r in graph.shortest_paths(e, start).collect()}[4] == [1, 2, 3, 4]
    assert {tuple(r.path) for r in graph.maximal_paths(e.where("target <> 1")).collect()} == {(1, 2, 3, 4)}
    assert {r.component for r in graph.components(e).collect()} == {1}


def test_event_types_have_two_precedences(spark):
    changed = F.array(F.lit("id"), F.lit("intent"))
    yes = F.lit(True)
    assert one(spark, history.event_type(yes, yes, changed, history.CAPTURE_ORDER)) == "intent.changed"
    assert one(spark, history.event_type(yes, yes, changed, history.OUTBOX_ORDER)) == "block.renamed"


def test_corrupt_line_after_the_latest(spark):
    rows = [("a", 1, False, "pass"), ("b", 2, False, "pass"), (None, 3, True, None), ("a", 4, False, "fail")]
    got = history.trusted_latest(spark.createDataFrame(rows, "k string, line int, bad boolean, status string"), "k", "line", "bad", ["status"])
    assert {(r.k, r.status, r.state) for r in got.collect()} == {("a", "fail", "ok"), ("b", "pass", "corrupt")}


def test_store_round_trip_conflicts_and_reorder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("u1", 0, {"a": "1"}), ("u2", 1, {"a": "2", "b": "x"})], "uid string, ordinal long, fields map<string,string>")
    assert store.import_records(rows, actor="t") == 1
    with pytest.raises(Conflict):
        store.import_records(rows, actor="t")
    edits = spark.createDataFrame([("u1", 1, "set", "a", "9"), ("u1", 2, "set", "c", "z"), ("u2", 3, "clear", "b", None)], "uid string, seq long, op string, field string, value string")
    assert store.apply_patches(edits, actor="t", reason="r", expected=1, dry_run=True).count() == 2 and store.revision() == 1
    assert store.apply_patches(edits, actor="t", reason="r", expected=1) == 2
    assert {r.uid: r.fields for r in store.read().collect()} == {"u1": {"a": "9", "c": "z"}, "u2": {"a": "2"}}
    with pytest.raises(Conflict):
        store.apply_patches(edits, actor="t", reason="r", expected=1)
    swapped = store.read().select("uid", (1 - F.col("ordinal")).alias("ordinal"), "fields")
    assert [r.kind for r in store.difference(swapped).collect()] == ["records.reorder"]
    assert store.replace(store.read().select("uid", "ordinal", "fields"), actor="t", reason="same", expected=2) == 2
    a, b = table_digest(store.read(1), ["uid", "ordinal"]).first(), table_digest(store.read(2), ["uid", "ordinal"]).first()
    assert a == b and {r.uid: r.fields for r in store.read(1).collect()}["u1"] == {"a": "1"}


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "build").mkdir(parents=True)
    (tmp_path / "t" / "a.py").write_text("x = 1\n")
    (tmp_path / "t" / "build" / "b.py").write_text("x = 1\n")
    (tmp_path / "t" / "c.txt").write_text("x")
    got = files.source_tree(spark, str(tmp_path / "t"))
    assert [(r.path, r.language) for r in got.collect()] == [("a.py", "python")]
    assert files.stale_files(got, got).count() == 0
    (tmp_path / "j.jsonl").write_text('{"k": "a", "n": 1}\n\n{broken\n{"k": "b", "n": 2}\n')
    rows = files.journal(spark, str(tmp_path / "j.jsonl"), "k string, n int").orderBy("line").collect()
    assert [(r.k, r.corrupt) for r in rows] == [("a", False), (None, True), ("b", False)]
    data = files.from_rows(spark, [{"key": "row 1", "total": 12}, {"key": "row 2", "remark": "+1+cmd"}], "key")
    files.export_csv(data, str(tmp_path / "csv"))
    assert "'+1+cmd" in {r.remark for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()}
    with pytest.raises(ValueError):
        files.registry(spark, [("py", "a"), ("py", "b")])
