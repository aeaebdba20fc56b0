import pytest
from pyspark.sql import functions as F

from quernstone.operators import runs

FILES = [("b.py", "python", "def f():\n    return 1\n"), ("a.go", "go", "func G() {\n}\n"), ("c.html", "html", "<p id='x'>t</p>"), ("d.py", "python", "def ("), ("e.rs", "rust", None), ("f.kt", "kotlin", "fun x()"), ("g.kt", "kotlin", "")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(FILES, "path string, language string, text string").withColumn("size", F.coalesce(F.length("text"), F.lit(-1)))


def test_a_project_is_scanned_in_all_languages(sources):
    scan = runs.scan_project(sources)
    assert [(r.path, r.symbol, r.language) for r in scan.units.collect()] == [("a.go", "G", "go"), ("b.py", "f", "python"), ("c.html", "p#x", "html")]
    assert {tuple(r) for r in scan.findings.collect()} == {("d.py", "PARSE_ERROR", "block"), ("e.rs", "READ_ERROR", "block"), ("kotlin", "NO_EXTRACTOR", "info")}


def test_unchanged_files_come_from_the_cache(sources):
    cached = runs.strategy("full")(sources).withColumn("symbol", F.concat(F.lit("cached "), "symbol"))
    before = sources.select("path", F.when(F.col("path") == "b.py", 0).otherwise(F.col("size")).alias("size"))
    got = runs.strategy("cached")(sources, cached, before, ["size"])
    assert {r.symbol for r in got.collect()} == {"cached G", "f", "cached p#x"}
    with pytest.raises(ValueError):
        runs.strategy("other")


def test_steps_stop_at_a_blocking_finding(spark):
    made = lambda *s: lambda: spark.createDataFrame([(x,) for x in s], "severity string")
    assert runs.run_steps([("a", made("warning")), ("b", made()), ("c", made("BLOCK", "info")), ("d", made())]) == [("a", 1, False), ("b", 0, False), ("c", 2, True)]


def test_adapters_locks_and_exports(spark):
    adapters = runs.Adapters()
    adapters.register("range", lambda n: spark.range(n))
    assert adapters.open("range", 5).count() == 5
    for bad in (lambda: adapters.register("range", None), lambda: adapters.open("none")):
        with pytest.raises(ValueError):
            bad()
    lock = runs.Lock()
    lock.set("a", True)
    lock.check("a")
    with pytest.raises(runs.Locked):
        lock.set("b", False)
    lock.set("a", False)
    lock.check()
    assert [len(b) for b in runs.exported(spark.range(450), ["id"], lambda: 1)] == [200, 200, 50]
    seen = iter([1, 1, 2])
    with pytest.raises(RuntimeError):
        list(runs.exported(spark.range(450), ["id"], lambda: next(seen)))
