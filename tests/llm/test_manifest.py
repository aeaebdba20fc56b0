import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm.manifest import manifest, verified_manifest
from quernstone.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, digest string, idx long, level int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """The top's digest, and of every leaf the (siblings before, siblings after) of each level."""
    nodes, steps = [(d, [i]) for i, d in enumerate(digests)], [[] for _ in digests]
    while len(nodes) > 1:
        up = []
        for at in range(0, len(nodes), 3):
            run = nodes[at:at + 3]
            for k, (_, members) in enumerate(run):
                for m in members:
                    steps[m].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1:])))
            up.append((sha(*(d for d, _ in run)), [m for _, ms in run for m in ms]))
        nodes = up
    return nodes[0][0], steps


def by_hand(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        now = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((-1 if doc_id is None else doc_id, leaf(doc_id, text, lang, source, n_chars), doc_id, leaf(doc_id, now, lang, source, n_chars)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in order}
    root, upper = tree([lower[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, own, doc_id, now), steps in zip(sorted(groups[s], key=lambda x: x[:2]), lower[s][1], strict=True):
            folded = now
            for before, after in steps + above:
                folded = sha(before, folded, after)
            out.append((repr(doc_id), own, lower[s][0], root, sha(*(b + a for b, a in steps + above)), folded, folded == root))
    return sorted(out)


def found(df):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def query(docs):
    damaged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified_manifest(docs, F.when(damaged, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def test_any_shape_equals_a_tree_by_hand(spark):
    r = random.Random(6)
    for sizes in ([1], [2], [3, 1], [1, 1], [28, 4, 1, 9, 10, 27, 2, 81, 3, 82]):
        sources = r.sample([None, "", "a", "é", "Z", "漢字", "=", "b b", "\U0001f600", "￿"], len(sizes))
        rows = [(r.randint(0, 10**6), r.choice([None, "", "a\nb", "é\n\n", "x" * 50]), r.choice([None, "en"]), s, r.choice([None, 7]), "clash", "clash", 1, 1) for s, n in zip(sources, sizes, strict=True) for _ in range(n)]
        rows = [(None, *x[1:]) if r.random() < 0.05 else x for x in rows]
        if len(rows) > 20:
            rows += rows[:15] + [(5, "long \n" * 300_000, None, "a", 3, "", "", 0, 0)]
        assert found(query(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_a_source_with_nearly_all_rows(spark):
    rows = [(i, f"t{i % 7}\n", "en", "hot" if i % 50 else f"s{i % 3}", i) for i in range(3000)]
    assert found(query(spark.createDataFrame(rows, SCHEMA.split(", grp")[0]))) == by_hand(rows)


def test_any_change_shows(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 4}", i) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA.split(", grp")[0])
    roots = {manifest(docs).first().root}
    for change in ({"text": "text 8"}, {"lang": None}, {"source": "s1"}, {"n_chars": 8}, {"doc_id": 99}):
        changed = docs
        for c, v in change.items():
            changed = changed.withColumn(c, F.when(F.col("doc_id") == 7, F.lit(v)).otherwise(F.col(c)))
        roots.add(manifest(changed).first().root)
    assert len(roots) == 6
    assert manifest(docs.repartition(7)).first().root in roots


def test_an_empty_table_gives_no_row(spark):
    assert verified_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op11_merkle_manifest"])
    got = QUERIES["op11_merkle_manifest"](spark, path).select(want.columns)
    rows = {tuple(r) for r in got.collect()}
    assert rows == set(want.fetchall()) and {r[-1] for r in rows} == {True, False}
    docs = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    assert len(rows) == len(docs) and sorted((repr(r[0]), *r[1:]) for r in rows) == by_hand(docs)
