import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quernstone.operators.publish import Journal
from quernstone.streaming import watch

START = datetime(2026, 1, 1)
CHANGES = "root string, path string, ts timestamp"


def put(spark, folder, rows):
    spark.createDataFrame([(r, p, START + timedelta(milliseconds=ms)) for r, p, ms in rows], CHANGES).coalesce(1).write.mode("append").parquet(folder)


def ran(q):
    assert q.awaitTermination(180), "the stream did not end"


def kept(out):
    return lambda batch, epoch: out.extend((r.root, r.n, r.paths) for r in batch.collect())


def test_bursts_give_one_set_each_and_a_single_run_drains(spark, tmp_path):
    src, got = str(tmp_path / "in"), []
    put(spark, src, [("a", "x", 0), ("a", "y", 700), ("a", "x", 1500), ("a", "z", 2301), ("b", None, 0), ("b", "q", 800), (None, "w", 5)])

    def run():
        sets = watch.change_sets(watch.read_changes(spark, src, CHANGES, files_per_batch=None), "root", "path", "ts", drain=True)
        ran(sets.writeStream.foreachBatch(kept(got)).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())

    run()
    assert sorted(got, key=repr) == sorted([("a", 3, ["x", "y"]), ("a", 1, ["z"]), ("b", 2, ["q"]), (None, 1, ["w"])], key=repr)
    got.clear()
    run()
    assert got == []
    put(spark, src, [("a", "n", 2400)])
    run()
    assert got == [("a", 1, ["n"])]


def test_a_timer_closes_the_last_set(spark, tmp_path):
    src, got = str(tmp_path / "in"), []
    put(spark, src, [("a", "x", 0), ("a", "y", 10)])
    sets = watch.change_sets(watch.read_changes(spark, src, CHANGES), "root", "path", "ts", gap_ms=3000)
    q = sets.writeStream.foreachBatch(kept(got)).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    end = time.monotonic() + 90
    try:
        while not got and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        q.stop()
    assert got == [("a", 2, ["x", "y"])]


def test_findings_are_emitted_when_they_change_also_over_restarts(spark, tmp_path):
    src, cp, out = str(tmp_path / "in"), str(tmp_path / "cp"), []

    def run(found=lambda df: df.select("root").distinct(), emit=lambda df, epoch: out.append(sorted(r.root for r in df.collect()))):
        ran(watch.watch(watch.read_changes(spark, src, CHANGES), found, emit, cp))

    put(spark, src, [("a", "x", 0)])
    run()
    put(spark, src, [("a", "y", 0)])
    run()
    assert out == [["a"]]
    put(spark, src, [("b", "y", 0)])

    def dies(df, epoch):
        raise KeyError("lost")

    with pytest.raises(Exception, match="lost"):
        run(emit=dies)
    assert out == [["a"]]
    run()
    run()
    assert out == [["a"], ["b"]]
    assert Journal(spark, f"{cp}-marks").get(2)["epoch"] == 2


EVENTS = "event_id long, created_at timestamp, body string"


def test_events_are_published_once_whatever_breaks(spark, tmp_path):
    src, ledger, cp = (str(tmp_path / x) for x in ("in", "ledger", "cp"))

    def add(ids):
        spark.createDataFrame([(i, START + timedelta(seconds=i), f"b{i}") for i in ids], EVENTS).coalesce(1).write.mode("append").parquet(src)

    def run(on_step=lambda step, epoch: None):
        ran(watch.publish_outbox(watch.read_changes(spark, src, EVENTS), ledger, cp, on_step=on_step))

    def ids():
        return sorted(r.event_id for r in watch.published(spark, ledger, EVENTS).collect())

    assert ids() == []
    add([1, 2, 2, 1, 3])
    run()
    assert ids() == [1, 2, 3]
    for at, more in (("sink", [3, 4]), ("mark", [4, 5, 1])):
        add(more)

        def dies(step, epoch, at=at):
            if step == at:
                raise KeyError("lost")

        before = ids()
        with pytest.raises(Exception, match="lost"):
            run(dies)
        assert ids() == before
        run()
    assert ids() == [1, 2, 3, 4, 5]
    run()
    marks = Journal(spark, f"{ledger}/marks")
    assert marks.get(marks.last())["published"] == 5
    assert watch.published(spark, ledger, EVENTS).where(F.col("body") != F.concat(F.lit("b"), "event_id")).isEmpty()
