import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm.fim import cuts, draws, fill_in_middle, restored, with_sentinel
from quernstone.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, n string, form string, output string, _key string, prefix_chars string"


def by_hand(doc_id, text):
    text = text or ""
    hexa = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexa[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(4)
    parts = ["a", "é", "漢", "😀", "é", "<", ">", "P", "S", "M", "<P", "S>", "<M>", "<S>", "\n", " ", "word ", "\x00"]
    some = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(600)]
    return [None, "", "<", "<P>", "x<S", ">", "<P", ">", *some, "é漢😀" * 500_000, "<" * 100_000 + "P>"]


def test_rows_equal_a_cut_by_hand(spark):
    rows = [(i if i % 50 else None, t, "en", *["clash"] * 5) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    out = fill_in_middle(df)
    assert len(set(out.columns)) == len(out.columns) and {"lang", "_key"} <= set(out.columns)
    got = sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect())
    want = sorted((repr(d), *by_hand(d, t), t or "") for d, t, *_ in rows + rows[:20])
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_bytes_of_cuts_and_sentinels_stay_within_their_rows():
    rows = ["é<", "P>漢", "", "<P>", "a<S>b"]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in rows])])
    assert with_sentinel(data, off).tolist() == [False, False, False, True, True]
    h = draws([1, 2, 3, 4, 5])
    n, unit, byte = cuts(data, off, h)
    assert n.tolist() == [len(t) for t in rows]
    for t, a, (x, y), (u, v) in zip(rows, off, byte, unit, strict=False):
        assert (t[:u].encode(), t[:v].encode()) == (t.encode()[: x - a], t.encode()[: y - a])


def test_an_empty_table_gives_no_row(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op13_fill_in_middle"])
    got = QUERIES["op13_fill_in_middle"](spark, path)
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())
    assert got.where("output_sha256 <> restored_sha256").count() > 0
