"""A versioned table of records: import, compare-and-set patches, replacement by difference, deltas, digest, lock.

A store is a folder of Parquet tables and a journal. Records lie in base tables,
partitioned by a hash of their uid; a change writes only the records that it
changes, and its log, and the nodes of the digest above them. Readers merge: of a
uid the latest change counts, else the base. compact() writes a new base.

Every change goes through stage, audit and publish. What is staged lies in a folder
of its own that no reader knows; it is read back and checked; then one entry of the
journal names it, which makes it count, all at once. The entry is conditional on the
one that the writer saw: of two writers one is refused, also when what came between
was a lock. What a crash leaves before that is never read, and recover() deletes it.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalars import changed_keys

from . import digest as tree
from . import publish
from .publish import Conflict

PATCH_LIMIT = 100_000
#: Roots that a patch may not touch.
FORBIDDEN = ["uid", "revision", "ordinal"]
#: Changed records that are broadcast when records are merged; more are joined by a shuffle.
FEW = 1_000_000
#: Changes after which a store should be compacted: that many, or that share of the base's records.
MAX_DELTAS, MAX_SHARE = 32, 0.3


class Locked(RuntimeError):
    """A change under a lock that another holds."""


class Damaged(RuntimeError):
    """What was staged is not what was meant; nothing has been published."""


class Store:
    """Records (uid string, ordinal long, revision long, fields map<string,string>) with a log of operations.

    uids and ordinals are distinct. buckets counts only when a store is imported.
    on_step is called with the name of each step before it, and may raise, as a
    crash would.
    """

    SCHEMA = "uid string, ordinal long, revision long, fields map<string,string>"
    CHANGE = f"{SCHEMA}, gone boolean, commit long, bucket int"
    LOG = "operation long, seq long, kind string, uid string, before map<string,string>, after map<string,string>"
    LEAF = f"idx long, members {tree.MEMBERS}, digest string, commit long, shelf long"
    NODE = "level int, idx long, digest string, commit long"

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 16, on_step: Callable[[str], None] = lambda step: None) -> None:
        self.spark, self.folder, self.buckets, self.on_step = spark, folder.rstrip("/"), buckets, on_step
        self.journal = publish.Journal(spark, f"{self.folder}/journal")

    # state

    def state(self) -> dict:
        """The last entry of the journal; of an empty store, revision 0."""
        last = self.journal.last()
        return self.journal.get(last) if last else {"entry": 0, "revision": 0, "lock": None}

    def revision(self) -> int:
        return self.state()["revision"]

    def state_at(self, revision: int) -> dict:
        """The last state of a revision, which a compaction may have made."""
        at = self.journal.last_with("revision", revision)
        if not at or (state := self.journal.get(at))["revision"] != revision or revision < self.state().get("oldest", 1):
            raise ValueError(f"no revision {revision}")
        return state

    def _place(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, schema: str, places: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*map(self._place, places))

    def _merged(self, state: dict, base: DataFrame, kind: str, schema: str, key: list[str]) -> DataFrame:
        """Rows of a base table with the deltas of a state over them: of each key the latest change."""
        if not state["deltas"]:
            return base
        changes = self._read(schema, [f"{d['place']}/{kind}" for d in state["deltas"]])
        rest = [c for c in changes.columns if c not in (*key, "commit")]
        newest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "commit").alias("new")).select(*key, "new.*")
        gone = newest.select(*key)
        kept = base.join(F.broadcast(gone) if sum(d["rows"] for d in state["deltas"]) <= FEW else gone, key, "left_anti")
        return kept.select(*newest.columns).unionByName(newest)

    def _records(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """Records of a state with their bucket; of some buckets, whose files alone are read."""
        base = self._read(f"{self.SCHEMA}, bucket int", [f"{state['base']}/records"]).withColumn("gone", F.lit(False))
        out = self._merged(state, base, "changes", self.CHANGE, ["bucket", "uid"])
        out = out if buckets is None else out.where(F.col("bucket").isin(buckets))
        return out.where("not gone").select("uid", "ordinal", "revision", "fields", "bucket")

    def read(self, revision: int | None = None) -> DataFrame:
        """Records as they are, or as they were at a revision."""
        return self._records(self.state() if revision is None else self.state_at(revision)).drop("bucket")

    def log(self) -> DataFrame:
        """The operations of all revisions."""
        return self.spark.read.schema(self.LOG).parquet(self._place("log/*"))

    # digest

    def digest(self, revision: int | None = None) -> str | None:
        """The digest of the whole document in its order, as its state has it."""
        return (self.state() if revision is None else self.state_at(revision))["digest"]

    def _leaves(self, state: dict) -> DataFrame:
        base = self._read(self.LEAF.replace(", commit long", ""), [f"{state['base']}/leaves"])
        return self._merged(state, base, "leaves", self.LEAF, ["shelf", "idx"])

    def _nodes(self, state: dict) -> DataFrame:
        base = self._read(self.NODE.replace(", commit long", ""), [f"{state['base']}/nodes"])
        return self._merged(state, base, "nodes", self.NODE, ["level", "idx"])

    # changes

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int")

    def _publish(self, state: dict, **changes) -> dict:
        self.on_step("publish")
        new = {**state, **changes, "entry": state["entry"] + 1}
        self.journal.append(new["entry"], new)
        return new

    def _checked(self, state: dict, expected: int | None, owner: str | None, fence: int | None) -> None:
        """Refuse a change at another revision, under another's lock, or with a lock that has been taken anew."""
        if expected is not None and state["revision"] != expected:
            raise Conflict(f"expected revision {expected}, found {state['revision']}")
        lock = state["lock"]
        if lock and lock["owner"] != owner:
            raise Locked(f"held by {lock['owner']}")
        if fence is not None and (not lock or lock["fence"] != fence):
            raise Locked(f"lock {fence} is held no longer")

    def set_locked(self, owner: str, locked: bool) -> int | None:
        """Take or give back the lock, which only its owner may; its number, larger than any before."""
        state = self.state()
        lock = state["lock"]
        if lock and lock["owner"] != owner:
            raise Locked(f"held by {lock['owner']}")
        if bool(lock) == locked:
            return lock["fence"] if lock else None
        fence = state.get("fence", 0) + locked
        self._publish(state, lock={"owner": owner, "fence": fence} if locked else None, fence=fence)
        return fence if locked else None

    def _stage_base(self, records: DataFrame, buckets: int) -> dict:
        """Write records (uid, ordinal, revision, fields) as a base with their tree; what a state needs of it."""
        place = f"base/{uuid4().hex}"
        self.on_step("stage records")
        rows = records.select("uid", F.col("ordinal").cast("long"), F.col("revision").cast("long"), "fields", self._bucket(buckets).alias("bucket"))
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(self._place(f"{place}/records"))
        stored = self._read(f"{self.SCHEMA}, bucket int", [f"{place}/records"])
        counts = stored.agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u"), F.countDistinct("ordinal").alias("o")).first()
        if counts.n != counts.u or counts.n != counts.o:
            raise ValueError("repeated uid or ordinal")
        self.on_step("stage digest")
        leaf = tree.leaves(stored.select("ordinal", "uid", tree.record_digest(F.col("uid"), F.col("fields")).alias("digest")))
        leaf.withColumn("shelf", F.expr(f"idx div {tree.SHELF}")).hint("rebalance", F.col("shelf")).write.partitionBy("shelf").parquet(self._place(f"{place}/leaves"))
        level = self._read(self.LEAF.replace(", commit long", ""), [f"{place}/leaves"]).select("idx", "digest")
        nodes = level.select(F.lit(0).alias("level"), "idx", "digest")
        for n in range(1, tree.HEIGHT + 1):
            level = tree.above(level)
            nodes = nodes.unionByName(level.select(F.lit(n).alias("level"), "idx", "digest"))
        nodes.write.parquet(self._place(f"{place}/nodes"))
        return {"base": place, "base_rows": counts.n, "deltas": [], "digest": tree.root(self._read(self.NODE, [f"{place}/nodes"])), "buckets": buckets}

    def _stage_log(self, revision: int, deltas: DataFrame) -> str:
        place = f"log/{revision:020d}-{uuid4().hex}"
        self.on_step("stage log")
        deltas.select(F.lit(revision).cast("long").alias("operation"), "seq", "kind", "uid", "before", "after").write.parquet(self._place(place))
        return place

    def _commit(self, state: dict, changes: DataFrame, deltas: DataFrame, actor: str, reason: str) -> int:
        """Stage changed records (uid, was, ordinal, revision, fields, gone), bring them into the digest, audit and publish."""
        revision = state["revision"] + 1
        place = f"delta/{revision:020d}-{uuid4().hex}"
        self.on_step("stage records")
        rows = changes.select("uid", "ordinal", "revision", "fields", "gone", F.lit(revision).cast("long").alias("commit"), self._bucket(state["buckets"]).alias("bucket"), "was")
        rows.write.parquet(self._place(f"{place}/changes"))
        log = self._stage_log(revision, deltas)
        stored = self._read(f"{self.CHANGE}, was long", [f"{place}/changes"])
        self.on_step("audit")
        seen = stored.agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u")).first()
        meant = self._read(self.LOG, [log]).where("uid is not null").select("uid")
        if seen.n != seen.u or not meant.join(stored, "uid", "left_anti").isEmpty():
            raise Damaged("the staged records are not those of the log")
        self.on_step("stage digest")
        place_of = F.when(~F.col("gone"), F.col("ordinal"))
        moved = stored.select("uid", "was", place_of.alias("ordinal"), tree.record_digest(F.col("uid"), F.col("fields")).alias("digest"))
        old_leaves, old_nodes = self._leaves(state), self._nodes(state)
        shelf = lambda c: F.expr(f"{c} div {tree.LEAF * tree.SHELF}")
        shelves = [r[0] for r in moved.select(shelf("was")).union(moved.select(shelf("ordinal"))).distinct().collect() if r[0] is not None]

        def write(nodes: DataFrame, level: int) -> DataFrame:
            if level == 0:
                nodes = nodes.select("idx", "members", "digest", F.lit(revision).cast("long").alias("commit"), F.expr(f"idx div {tree.SHELF}").alias("shelf"))
                nodes.write.parquet(self._place(f"{place}/leaves"))
                nodes = self._read(self.LEAF, [f"{place}/leaves"])
            new = nodes.select(F.lit(level).alias("level"), "idx", "digest", F.lit(revision).cast("long").alias("commit"))
            new.write.mode("append").parquet(self._place(f"{place}/nodes"))
            return self._read(self.NODE, [f"{place}/nodes"]).where(F.col("level") == level).select("idx", "digest")

        top = tree.update(lambda level: old_nodes.where((F.col("level") == level) & F.col("digest").isNotNull()).select("idx", "digest"), old_leaves.where(F.col("shelf").isin(shelves)), moved, write)
        deltas_now = [*state["deltas"], {"place": place, "rows": seen.n}]
        return self._publish(state, revision=revision, deltas=deltas_now, digest=top, log=log, actor=actor, reason=reason)["revision"]

    def import_records(self, records: DataFrame, *, actor: str) -> int:
        """First version, from (uid, ordinal, fields); only into an empty store, and only with distinct uids and ordinals."""
        state = self.state()
        if state["revision"]:
            raise Conflict("the store is not empty")
        self._checked(state, 0, actor, None)
        staged = self._stage_base(records.withColumn("revision", F.lit(1)), self.buckets)
        none = F.lit(None).cast("map<string,string>")
        first = self._read(f"{self.SCHEMA}, bucket int", [f"{staged['base']}/records"])
        log = self._stage_log(1, first.select(F.col("ordinal").alias("seq"), F.lit("record.upsert").alias("kind"), "uid", none.alias("before"), F.col("fields").alias("after")))
        return self._publish(state, **staged, revision=1, log=log, actor=actor, reason="import")["revision"]

    def migrate(self, records: DataFrame, *, actor: str) -> int:
        """import_records(), but published only if what has been staged equals records row by row, both ways, and gives the same digest."""
        state = self.state()
        if state["revision"]:
            raise Conflict("the store is not empty")
        self._checked(state, 0, actor, None)
        staged = self._stage_base(records.withColumn("revision", F.lit(1)), self.buckets)
        self.on_step("audit")
        there = self._read(f"{self.SCHEMA}, bucket int", [f"{staged['base']}/records"])
        plain = lambda df: df.select("uid", F.col("ordinal").cast("long").alias("ordinal"), F.array_sort(F.map_entries("fields")).alias("fields"))
        meant, found = plain(records), plain(there)
        if not meant.exceptAll(found).isEmpty() or not found.exceptAll(meant).isEmpty():
            raise Damaged("the staged records differ from the source")
        again = tree.tree(records.select("ordinal", "uid", tree.record_digest(F.col("uid"), F.col("fields")).alias("digest")))
        if tree.root(again) != staged["digest"]:
            raise Damaged("the staged digest differs from the source's")
        none = F.lit(None).cast("map<string,string>")
        log = self._stage_log(1, there.select(F.col("ordinal").alias("seq"), F.lit("record.upsert").alias("kind"), "uid", none.alias("before"), F.col("fields").alias("after")))
        return self._publish(state, **staged, revision=1, log=log, actor=actor, reason="migration")["revision"]

    def _folded(self, records: DataFrame, edits: DataFrame) -> DataFrame:
        """The edited ones of records, with what edits (uid, seq, op set|clear, field, value) make of each, folded in order of seq."""
        steps = edits.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "field", "value"))).alias("steps"))
        with_ = lambda m, s: F.map_concat(F.map_filter(m, lambda k, v: k != s["field"]), F.map_from_arrays(F.array(s["field"]), F.array(s["value"])))
        fold = lambda m, s: F.when(s["op"] == "clear", F.map_filter(m, lambda k, v: k != s["field"])).otherwise(with_(m, s))
        # at most PATCH_LIMIT edits
        out = records.join(F.broadcast(steps), "uid")
        return out.select("uid", "ordinal", "revision", F.col("fields").alias("old"), F.aggregate("steps", F.col("fields"), fold).alias("fields"))

    def apply_patches(self, edits: DataFrame, *, actor: str, reason: str, expected: int, dry_run: bool = False, fence: int | None = None) -> DataFrame | int:
        """Apply edits if the store is at the expected revision; with dry_run, give the changes only.

        Reads the buckets of the edited records and writes what changes.
        """
        state = self.state()
        self._checked(state, expected, actor, fence)
        if edits.limit(PATCH_LIMIT + 1).count() > PATCH_LIMIT:
            raise ValueError("too many edits")
        if not edits.where(F.col("field").isin(FORBIDDEN) | ~F.col("op").isin("set", "clear")).isEmpty():
            raise ValueError("a patch touches a forbidden field or has an unknown operation")
        buckets = [r[0] for r in edits.select(self._bucket(state["buckets"])).distinct().collect()]
        records = self._records(state, buckets).drop("bucket")
        if not edits.join(records.select("uid"), "uid", "left_anti").isEmpty():
            raise ValueError("unknown uid")
        if "expected_revision" in edits.columns:
            stale = edits.join(records.select("uid", F.col("revision").alias("_r")), "uid").where("expected_revision <> _r")
            if not stale.isEmpty():
                raise Conflict("a record is at another revision")
        new = self._folded(records, edits).where(F.size(changed_keys(F.col("old"), F.col("fields"))) > 0)
        deltas = new.select(F.col("ordinal").alias("seq"), F.lit("record.patch").alias("kind"), "uid", F.col("old").alias("before"), F.col("fields").alias("after"))
        if dry_run:
            return deltas
        if deltas.isEmpty():
            return state["revision"]
        changes = new.select("uid", F.col("ordinal").alias("was"), "ordinal", F.lit(state["revision"] + 1).cast("long").alias("revision"), "fields", F.lit(False).alias("gone"))
        return self._commit(state, changes, deltas, actor, reason)

    def _compared(self, state: dict, new: DataFrame) -> DataFrame:
        """Records of a state beside new ones, each null where the other alone has the uid."""
        a = self._records(state).select("uid", F.col("ordinal").alias("o1"), F.col("revision").alias("r1"), F.col("fields").alias("before"))
        b = new.select("uid", F.col("ordinal").cast("long").alias("o2"), F.col("fields").alias("after"))
        content = (F.col("o1").isNull() | F.col("o2").isNull()) | (F.size(changed_keys(F.col("before"), F.col("after"))) > 0)
        return a.join(b, "uid", "full_outer").withColumn("content", content)

    @staticmethod
    def _deltas(both: DataFrame) -> DataFrame:
        kind = F.when(F.col("o2").isNull(), "record.delete").otherwise("record.upsert")
        rows = both.where("content").select(F.coalesce("o2", "o1").alias("seq"), kind.alias("kind"), "uid", "before", "after")
        none = F.lit(None).cast("map<string,string>")
        moved = both.where("o1 <> o2").select(F.lit(-1).cast("long").alias("seq"), F.lit("records.reorder").alias("kind"), F.lit(None).cast("string").alias("uid"), none.alias("before"), none.alias("after")).limit(1)
        return rows.unionByName(moved)

    def difference(self, new: DataFrame) -> DataFrame:
        """Deltas from the current records to new ones (uid, ordinal, fields); order alone is one delta."""
        return self._deltas(self._compared(self.state(), new))

    def replace(self, new: DataFrame, *, actor: str, reason: str, expected: int, fence: int | None = None) -> int:
        """Make new the current records; nothing happens when nothing differs. Writes the records that differ, in content or place."""
        state = self.state()
        self._checked(state, expected, actor, fence)
        if not new.groupBy("uid").count().where("count > 1").isEmpty() or not new.groupBy("ordinal").count().where("count > 1").isEmpty():
            raise ValueError("repeated uid or ordinal")
        both = self._compared(state, new)
        differs = both.where("content or o1 <> o2")
        if differs.isEmpty():
            return state["revision"]
        stamp = F.when(F.col("content"), F.lit(state["revision"] + 1)).otherwise(F.col("r1")).cast("long")
        changes = differs.select("uid", F.col("o1").alias("was"), F.coalesce("o2", "o1").alias("ordinal"), stamp.alias("revision"), F.coalesce("after", "before").alias("fields"), F.col("o2").isNull().alias("gone"))
        return self._commit(state, changes, self._deltas(both), actor, reason)

    # upkeep

    def should_compact(self) -> bool:
        state = self.state()
        return len(state["deltas"]) >= MAX_DELTAS or sum(d["rows"] for d in state["deltas"]) > MAX_SHARE * max(state["base_rows"], 1)

    def compact(self) -> None:
        """Write the current records as a new base; the revision and the digest stay, and so do older revisions."""
        state = self.state()
        if not state["revision"] or not state["deltas"]:
            return
        staged = self._stage_base(self._records(state).drop("bucket"), state["buckets"])
        if staged["digest"] != state["digest"]:
            raise Damaged("the new base's digest is not the document's")
        self._publish(state, **staged)

    def _named(self, entry: dict) -> set[str]:
        return {entry[k] for k in ("base", "log") if entry.get(k)} | {d["place"] for d in entry.get("deltas", [])}

    def recover(self) -> list[str]:
        """Delete what was staged and never published, as crashes leave it; the names of what went. No writer may be at work."""
        named = {x for n in range(1, self.journal.last() + 1) for x in self._named(self.journal.get(n))}
        lost = [f"{kind}/{name}" for kind in ("base", "delta", "log") for name in publish.children(self.spark, self._place(kind)) if f"{kind}/{name}" not in named]
        for x in lost:
            publish.remove(self.spark, self._place(x))
        return lost

    def vacuum(self, keep: int) -> list[str]:
        """Give up all revisions but the newest `keep`, with their logs; the names of the tables that went.

        What the kept revisions read stays, also where it was written before. Run
        compact() first, so that they need no old base.
        """
        state = self.state()
        oldest = max(state["revision"] - keep + 1, state.get("oldest", 1))
        if oldest > state.get("oldest", 1):
            state = self._publish(state, oldest=oldest)
        entries = [self.journal.get(n) for n in range(1, state["entry"] + 1)]
        # of each kept revision what its last state names
        last = {e["revision"]: e for e in entries if e["revision"] >= oldest}
        kept = {x for e in last.values() for x in self._named(e)}
        lost = {x for e in entries for x in self._named(e)} - kept
        gone = [x for x in sorted(lost) if publish.exists(self.spark, self._place(x))]
        for x in gone:
            publish.remove(self.spark, self._place(x))
        return gone

    def doctor(self) -> dict[str, bool]:
        """Whether uids and ordinals are distinct, the log tells every record's last content, the stored digests are those of the records, and nothing is left over."""
        state = self.state()
        records = self._records(state)
        n = records.agg(F.count("*").alias("n"), F.countDistinct("uid").alias("u"), F.countDistinct("ordinal").alias("o")).first()
        oldest = state.get("oldest", 1)
        told = self.log().where("uid is not null").groupBy("uid").agg(F.max_by("after", "operation").alias("after"), F.max_by("kind", "operation").alias("kind"))
        entries = lambda c: F.array_sort(F.map_entries(c))
        untold = F.col("of").isNull() if oldest == 1 else F.lit(False)  # a log that has been cut does not tell of all
        apart = records.join(told.where("kind <> 'record.delete'").withColumnRenamed("uid", "of"), F.col("uid") == F.col("of"), "full_outer").where(F.col("uid").isNull() | untold | (F.col("of").isNotNull() & ~entries("fields").eqNullSafe(entries("after"))))
        fresh = tree.tree(records.select("ordinal", "uid", tree.record_digest(F.col("uid"), F.col("fields")).alias("digest")))
        kept = self._nodes(state).where("digest is not null").select("level", "idx", "digest")
        same = fresh.exceptAll(kept).isEmpty() and kept.exceptAll(fresh).isEmpty()
        named = {x for k in range(1, state["entry"] + 1) for x in self._named(self.journal.get(k))}
        there = {f"{kind}/{name}" for kind in ("base", "delta", "log") for name in publish.children(self.spark, self._place(kind))}
        places = there <= named and (oldest > 1 or named == there) and self._named(state) <= there
        return {"distinct": n.n == n.u == n.o, "log": apart.isEmpty(), "digest": same and tree.root(fresh) == state["digest"], "places": places}


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and an order-free digest of them (a sum of row hashes, which merges)."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def csv_edits(rows: DataFrame, baseline: DataFrame, uid: str, columns: list[str]) -> DataFrame:
    """One edit per cell that differs from the baseline; rows that are not there are no deletions."""
    long = lambda df, name: df.select(uid, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("c")).select(uid, "c.field", F.col("c.v").alias(name))
    both = long(rows, "value").join(long(baseline, "was"), [uid, "field"])
    return both.where(~F.col("value").eqNullSafe(F.col("was")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones that they don't replace."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
