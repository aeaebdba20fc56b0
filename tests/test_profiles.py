import random
from collections import defaultdict

from pyspark.sql import functions as F

from quernstone.operators import changes, effects, inference, profiles
from quernstone.sources import extract, files


def evidence(spark, rows):
    schema = "unit string, " + ", ".join(f"{n} {t}" for n, t in profiles.EVIDENCE.items())
    names = ["unit", *profiles.EVIDENCE]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_keys_are_inherited_level_by_level_and_cycles_end(spark):
    units = evidence(spark, [
        {"unit": "leaf", "kind": "function", "symbol": "leaf", "action": "send", "resource": "http_api", "target": "billing", "outcome_key": "k"},
        {"unit": "mid", "kind": "class", "symbol": "mid", "resolved": ["leaf"]}, {"unit": "top", "kind": "class", "symbol": "top", "resolved": ["mid", "leaf"]},
        {"unit": "a", "kind": "function", "symbol": "a", "wrapper": True, "wrapper_target": "b", "calls": ["b"], "resolved": ["b"]},
        {"unit": "b", "kind": "function", "symbol": "b", "wrapper": True, "wrapper_target": "leaf", "calls": ["leaf"], "resolved": ["leaf"]},
    ])
    calls = spark.createDataFrame([("mid", "leaf", 0), ("top", "mid", 0), ("top", "leaf", 1), ("a", "b", 0), ("b", "leaf", 0), ("leaf", "leaf", 0)], "unit string, child string, ord int")
    got = {r.unit: r["keys"] for r in profiles.inherited_keys(units, "unit", calls).collect()}
    own = "send|http_api|billing|*"
    assert got["leaf"].duplicate_key == own
    assert (got["mid"].duplicate_key, got["mid"].strength) == (f"child|{own}", "weak")
    assert got["b"].duplicate_key == f"delegate|leaf|child:{own}"
    assert got["a"].duplicate_key == f"delegate|b|child:delegate|leaf|child:{own}"
    assert got["top"].duplicate_key == f"child|{own}"  # the weak key of mid is passed over


def test_generic_targets_and_weak_actions_are_no_hard_signals(spark):
    units = evidence(spark, [
        {"unit": "1", "kind": "function", "symbol": "f", "calls": ["queue.publish"]}, {"unit": "2", "kind": "function", "symbol": "f", "calls": ["queue.publish"], "constants": ["order_created"]},
        {"unit": "3", "kind": "function", "symbol": "f", "action": "write", "resource": "file", "target": "path.write_text", "outcome_key": "k"}, {"unit": "4", "kind": "function", "symbol": "f", "constants": ["SELECT a FROM t"]},
        {"unit": "5", "kind": "function", "symbol": "x.run", "decorators": ["app.command"]},
    ])
    got = {r.unit: r["keys"].duplicate_key for r in profiles.duplicate_keys(units).collect()}
    assert got == {"1": None, "2": "publish|message_queue|order_created", "3": None, "4": None, "5": "command|cli|run"}


def test_units_find_their_effects_in_source(spark):
    source = "import requests\n\ndef pull(url):\n    print(url)\n    data = requests.get(url)\n    if not data:\n        raise ValueError('bad')\n    return data\n"
    facts = extract.python_facts(spark.createDataFrame([(1, source), (2, "def ("), (3, None)], "k int, text string"), "k", "text")
    got = {(r.action, r.resource, r.target) for r in effects.infer_effects(facts.withColumnRenamed("symbol", "unit"), "unit").collect() if r.action != "return"}
    assert got == {("render", "terminal", "print"), ("send", "http_api", "get"), ("raise", "exception", "ValueError")}
    assert facts.first().roots == ["ValueError", "data", "print", "requests", "url"]


def test_levels_leave_cycles_out(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d")], "source string, target string")
    assert {r.node: r.level for r in inference.dependency_levels(nodes, edges).collect()} == {"a": 2, "b": 1, "c": 0, "d": None, "e": None}


def test_greedy_groups_use_each_item_once(spark):
    rows = [("x", i, 2) for i in (1, 2, 3)] + [("y", i, 1) for i in (2, 3, 4, 5)] + [("z", i, 1) for i in (5, 6)]
    got = inference.greedy_moves(spark.createDataFrame(rows, "group string, item int, weight int"), "weight").collect()
    assert [(r.group, r.place, r["items"]) for r in got] == [("x", 1, [1, 2, 3]), ("y", 2, [4, 5])]


def test_greedy_groups_choose_by_blocks(spark, monkeypatch):
    r, cuts, cut = random.Random(5), [], inference._cut
    monkeypatch.setattr(inference, "_cut", lambda df: cuts.append(1) or cut(df))
    rows = [(g, g * 3 + i, 1) for g in range(60) for i in range(5)] + [(g, r.randrange(400), 1 + g % 3) for g in range(60, 100) for _ in range(r.randrange(1, 12))]
    items, weights = defaultdict(set), {}
    for g, i, w in rows:
        items[g].add(i)
        weights[g] = w
    used, want = set(), []
    for g in sorted(items, key=lambda g: (-len(items[g]) * weights[g], -len(items[g]), g)):
        free = items[g] - used
        if len(free) >= 3:
            used |= free
            want.append((g, sorted(free)))
    df = spark.createDataFrame(rows, "group int, item int, weight int")
    for block in (1_000_000, 150):
        cuts.clear()
        got = inference.greedy_moves(df, "weight", least=3, block=block).orderBy("place").collect()
        assert [(r.group, r["items"]) for r in got] == want
        assert len(cuts) < 8 or block < 1_000_000  # a chain of groups is one block, not a round for each
    large = spark.createDataFrame([("x", i, 1) for i in range(5)] + [("y", i, 1) for i in (4, 5, 6)], "group string, item int, weight int")
    assert [(r.group, r["items"]) for r in inference.greedy_moves(large, "weight", block=3).collect()] == [("x", [0, 1, 2, 3, 4]), ("y", [5, 6])]


def test_roots_and_states():
    roots = files.source_roots
    assert roots(["go.mod", "a.py"], [".py"], folders=["src"]) == ["."] and roots(["a.py"], [".py"], folders=["web", "src", "x"]) == ["src", "web"]
    assert roots(["a.py"], [".py"], folders=[]) == ["."] and roots(["a.txt"], [".py"], folders=[]) == ["src", "app"]
    assert [files.document_state(*x) for x in ((False, 0, 0), (True, 0, 0), (True, 2, 1), (True, 2, 0), (True, 2, 0, False))] == ["missing", "empty", "draft", "defined", "invalid"]


def test_sinks_keep_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 5)], "k int, z string, a int")
    files.export_json(rows, f"{tmp_path}/json", key="k")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"a":5,"k":1,"z":"a"}', '{"a":null,"k":2,"z":"b"}']
    for _ in range(2):
        files.append_journal(rows.limit(1), f"{tmp_path}/journal")
    assert spark.read.json(f"{tmp_path}/journal").count() == 2
    files.replace_table(rows, f"{tmp_path}/t")
    files.replace_table(rows.where("k = 1"), f"{tmp_path}/t")
    assert files.read_table(spark, f"{tmp_path}/t").count() == 1
    files.backup(spark, f"{tmp_path}/json", f"{tmp_path}/copy", form="text")
    assert changes.same_rows(spark.read.text(f"{tmp_path}/json"), spark.read.text(f"{tmp_path}/copy")) and not changes.same_rows(rows, rows.union(rows))


def test_shards_and_flow_references(spark, tmp_path):
    for name, k in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(f'{{"id": {k}}}\n')
    got = files.sharded(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"], "id int")
    assert {(r.id, r.shard) for r in got.collect()} == {(1, "a.json"), (2, "b.json")}
    sources = spark.createDataFrame([("x/m.go", '//go:embed p.md q*.md ./r.md\nvar s = "conf/c.yaml"\n'), ("x/n.go", 'open("p.md")\n')], "path string, text string")
    there = spark.createDataFrame([("x/p.md",), ("x/r.md",), ("x/conf/c.yaml",)], "path string")
    bound = spark.createDataFrame([("x/r.md",)], "path string")
    assert {tuple(r) for r in files.flow_references(sources, there, bound, [".md", ".yaml"]).collect()} == {("x/p.md", "x/n.go"), ("x/conf/c.yaml", "x/m.go")}


def test_null_columns_do_not_break_detectors(spark):
    assert evidence(spark, [{"unit": "1"}]).select(F.size(profiles.signals()).alias("n")).first().n == 0
