"""Structured Streaming: debounced sets of changes, findings that are emitted only when they change, and an outbox that is published once.

What a stream has done is committed beside its checkpoint in a journal, so that it
outlives the driver: a query that is stopped, or dies, anywhere and starts again
neither repeats nor loses anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernstone.operators.publish import Journal, exists, is_file

#: Changes that come within this time of the last one belong to the same set.
DEBOUNCE_MS = 800


def read_changes(spark: SparkSession, folder: str, schema: str, *, files_per_batch: int | None = 100) -> DataFrame:
    """A stream over the Parquet files of a folder as they come, or over one file; without files_per_batch, all that are there at once."""
    reader = spark.readStream.schema(schema)
    if is_file(spark, folder):
        folder, _, name = folder.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def change_sets(changes: DataFrame, key: str, path: str, ts: str, *, gap_ms: int = DEBOUNCE_MS, drain: bool = False) -> DataFrame:
    """Sets (key, first, last, n, paths) of the changes of each key with no pause of more than gap_ms, from a stream (key, path, ts).

    A set is closed by a later change after a pause, or by a timer, gap_ms after the
    set's last arrival; until then state holds it. paths are distinct and sorted, n
    counts changes. With drain, for a run that ends by itself, nothing stays open
    and there are no timers; such a run needs a checkpoint of its own. Null keys are
    a key of their own; changes without ts are left out.
    """
    kind = dict(changes.dtypes)[key]
    gap = pd.Timedelta(milliseconds=gap_ms)

    def closed(names: tuple, sets: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(names[0], a, z, n, sorted(p)) for a, z, n, p in sets], columns=[key, "first", "last", "n", "paths"])

    def step(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = None
        if state.exists:
            a, z, n, paths = state.get
            held = (pd.Timestamp(a), pd.Timestamp(z), n, set(paths))
        if state.hasTimedOut:
            state.remove()
            yield closed(names, [held])
            return
        rows = pd.concat(list(batches)).dropna(subset=[ts]).sort_values(ts, kind="stable")
        done = []
        for at, what in zip(rows[ts], rows[path], strict=True):
            if held is not None and at - held[1] > gap:
                done.append(held)
                held = None
            held = (at, at, 0, set()) if held is None else held
            if what is not None:
                held[3].add(what)
            held = (min(held[0], at), max(held[1], at), held[2] + 1, held[3])
        if drain and held is not None:
            done.append(held)
        if not drain and held is not None:
            state.update((held[0].to_pydatetime(), held[1].to_pydatetime(), held[2], sorted(held[3])))
            state.setTimeoutDuration(gap_ms)
        yield closed(names, done)

    rows = changes.select(F.col(key), F.col(path).cast("string").alias(path), F.col(ts).cast("timestamp").alias(ts))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, first timestamp, last timestamp, n long, paths array<string>", "first timestamp, last timestamp, n long, paths array<string>", "append", GroupStateTimeout.NoTimeout if drain else GroupStateTimeout.ProcessingTimeTimeout)


def findings_fingerprint(findings: DataFrame) -> str:
    """Order-free fingerprint of a finding table: count and sum of row hashes."""
    r = findings.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*findings.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r.n}:{r.h}"


def _started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{DEBOUNCE_MS} milliseconds")).start()


def watch(changes: DataFrame, verify: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Verify on every batch; emit only if the findings differ from the last emitted ones, also those of an earlier run.

    The mark of what was emitted is an entry of a journal beside the checkpoint. A
    batch that runs again after its mark was written is not emitted again; one that
    died between the two is, with the same epoch, by which emit can tell.
    """
    marks = Journal(changes.sparkSession, f"{checkpoint}-marks")

    def step(batch: DataFrame, epoch: int) -> None:
        last = marks.last()
        before = marks.get(last) if last else {"epoch": -1, "mark": None}
        if epoch <= before["epoch"]:
            return
        found = verify(batch)
        mark = findings_fingerprint(found)
        if mark != before["mark"]:
            emit(found, epoch)
            marks.append(last + 1, {"epoch": epoch, "mark": mark})

    return _started(changes, step, checkpoint, once)


def publish_outbox(events: DataFrame, ledger: str, checkpoint: str, *, event_id: str = "event_id", created: str = "created_at", delay: str = "1 hour", once: bool = True, on_step: Callable[[str, int], None] = lambda step, epoch: None) -> StreamingQuery:
    """Bring a stream of outbox events into a ledger, each event_id once, and mark what has been published.

    Repeats are dropped by state that a watermark of `delay` bounds; an event that
    comes later than that after its time counts as a repeat. A batch goes to a part
    of the ledger of its own, which a batch that runs again replaces, and an entry of
    the ledger's journal then marks it as published; readers see marked parts alone.
    So no batch ever reads the ledger, and a crash between sink and mark adds nothing.
    """
    spark = events.sparkSession
    marks = Journal(spark, f"{ledger}/marks")
    new = events.withWatermark(created, delay).dropDuplicatesWithinWatermark([event_id])

    def step(batch: DataFrame, epoch: int) -> None:
        last = marks.last()
        if last and marks.get(last)["epoch"] >= epoch:
            return
        on_step("sink", epoch)
        part = f"{ledger}/events/epoch={epoch}"
        batch.sortWithinPartitions(created, event_id).write.mode("overwrite").parquet(part)
        on_step("mark", epoch)
        n = spark.read.schema(batch.schema).parquet(part).count()
        marks.append(last + 1, {"epoch": epoch, "n": n, "published": (marks.get(last)["published"] if last else 0) + n})

    return _started(new, step, checkpoint, once)


def published(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """The events of a ledger that are marked as published, with their epoch."""
    marks = Journal(spark, f"{ledger}/marks")
    last = marks.last()
    if not last or not exists(spark, f"{ledger}/events"):
        return spark.createDataFrame([], f"{schema}, epoch long")
    return spark.read.schema(f"{schema}, epoch long").parquet(f"{ledger}/events").where(F.col("epoch") <= marks.get(last)["epoch"])
