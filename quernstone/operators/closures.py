"""Closures of events, kept as references to shared components with the members that are missing.

Events of one component mostly have the same closure, but for themselves. So a
component's members are stored once, and an event keeps a reference and the few
members that its closure lacks; a closure that is not at least half of its component
stays inline. All of it is rows, not lists: no closure or component has to fit
anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut, components


@dataclass(frozen=True)
class Compacted:
    """What is kept: events (event, owner, component; null if inline), members (component, member), and rows (event, member) that are missing, or inline."""

    events: DataFrame
    members: DataFrame
    missing: DataFrame
    inline: DataFrame

    def write(self, folder: str) -> None:
        for name in ("events", "members", "missing", "inline"):
            getattr(self, name).write.mode("errorifexists").parquet(f"{folder}/{name}")

    @staticmethod
    def read(spark, folder: str) -> Compacted:
        return Compacted(*[spark.read.parquet(f"{folder}/{name}") for name in ("events", "members", "missing", "inline")])

    def sizes(self) -> DataFrame:
        """(part, n): rows of each part."""
        count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        return count(self.events, "events").unionByName(count(self.members, "members")).unionByName(count(self.missing, "missing")).unionByName(count(self.inline, "inline"))


def compact(closures: DataFrame, owners: DataFrame) -> Compacted:
    """closures (event, member) of the events of owners (event, owner), as references where that is shorter.

    A component holds what closures and owners connect; an owner is never in its own
    closure. Only events that lack fewer members than they have are compared with
    their component, so that no more rows arise than closures have.
    """
    rows = _cut(closures.join(owners, "event").where("member <> owner").select("event", "owner", "member").distinct())
    labels = _cut(components(rows.select(F.col("owner").alias("source"), F.col("member").alias("target")).distinct()))
    whole = labels.groupBy("component").agg(F.count("*").alias("size"))
    own = rows.groupBy("event", "owner").agg(F.count("*").alias("n"))
    placed = own.join(labels, F.col("owner") == F.col("node")).join(whole, "component").select("event", "owner", "component", "n", "size")
    # the component less the owner less the closure is what is missing
    placed = _cut(placed.withColumn("refers", F.col("size") - 1 - F.col("n") < F.col("n")))
    refers = placed.where("refers").select("event", "owner", "component", "n", "size")
    members = labels.join(refers.select("component").distinct(), "component", "left_semi").select("component", F.col("node").alias("member"))
    partial = refers.where("size - 1 > n").select("event", "owner", "component")
    expected = partial.join(members, "component").where("member <> owner").select("event", "member")
    missing = expected.join(rows.select("event", "member"), ["event", "member"], "left_anti")
    inline = rows.join(placed.where("not refers").select("event"), "event", "left_semi").select("event", "member")
    events = owners.select("event", "owner").join(refers.select(F.col("event").alias("e"), "component"), F.col("event") == F.col("e"), "left").select("event", "owner", "component")
    return Compacted(events, members, missing, inline)


def expand(kept: Compacted) -> DataFrame:
    """The closures (event, member) as they were."""
    shared = kept.events.where("component is not null").join(kept.members, "component").where("member <> owner").select("event", "member")
    return shared.join(kept.missing, ["event", "member"], "left_anti").unionByName(kept.inline)


def closure_of(kept: Compacted, events: DataFrame) -> DataFrame:
    """The closures of some events (event) alone."""
    some = events.select("event").distinct()
    only = lambda df: df.join(some, "event", "left_semi")
    return expand(Compacted(only(kept.events), kept.members, only(kept.missing), only(kept.inline)))
