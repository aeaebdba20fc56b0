import random
import re

import numpy as np
import pytest
import xxhash

from quernstone.llm.common import Scratch
from quernstone.llm.components import connected_components
from quernstone.llm.queries import QUERIES
from quernstone.llm.simhash import BITS, Search, at_distance, correlation, fingerprints, grouped, linked_fingerprints, pieces, simhash_components, value

SCHEMA = "doc_id long, text string, fp string, least string, root string, component_id string, key long"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(prints, ids):
    """For each row the smallest id that links of 3 or fewer bits reach, by comparing all with all."""
    own = sorted(set(prints))
    x = np.array(own, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    label = np.arange(len(own))
    while True:
        after = np.array([label[row].min() for row in near])
        if (after == label).all():
            break
        label = after
    least = {}
    for p, i in zip(prints, ids, strict=True):
        c = label[own.index(p)]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(label[own.index(p)]) for p in prints]


def test_fingerprints_equal_those_by_hand():
    r = random.Random(2)
    parts = ["a", "Word", "ÉA", "漢字", " ", "  ", "\t\n", "\x0b", "\x1f", "x" * 90, " ", "z z"]
    texts = ["", " ", "one", "Two words", "a b c", "a b c " * 400, *["".join(r.choice(parts) + r.choice([" ", ""]) for _ in range(r.randint(0, 60))) for _ in range(300)]]
    texts.append(" ".join(f"w{i * 7919 % 5003}" for i in range(90_000)))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert fingerprints(data, off).view(np.uint64).tolist() == [fingerprint(t) for t in texts]


def noisy(r, n):
    """Fingerprints of several kinds: far apart, in dense balls, in chains, and with bits that never change."""
    out = {0, 1, 7, (1 << 64) - 1}
    for _ in range(n):
        out.add(r.getrandbits(64))
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(n // 3):
            out.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 6))}))
    x = r.getrandbits(64)
    for _ in range(60):
        x ^= sum({1 << r.randrange(64) for _ in range(3)})
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("limit", "partitions"), [(4096, (2, 3, 4)), (20, (4,)), (12, (3,)), (12, (2,))])
def test_links_join_what_comparing_all_with_all_joins(spark, limit, partitions):
    prints = noisy(random.Random(limit + len(partitions)), 900)
    if partitions == (4,):  # half of the bits always the same
        prints = sorted({p & 0xFFFFFFFF00000000 | 5 for p in prints})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    scratch = Scratch(spark)
    stored = scratch.table(spark.createDataFrame([(p,) for p in signed], "fp long"), "prints")
    links = linked_fingerprints(stored, scratch, limit, partitions)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 40 for r in links.collect())
    root = {r.node: r.root for r in connected_components(links, scratch).collect()}
    got = [root.get(p, p) for p in signed]
    want = least_reachable(prints, list(range(len(prints))))
    assert len(set(want)) > 100 or partitions == (4,)
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_thresholds_lose_no_near_fingerprint():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 3000, dtype=np.int64)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    corr = correlation(bits.astype(float).T @ bits.astype(float), len(x))
    for m in (2, 3, 4):
        parts = grouped(corr, m)
        assert sorted(np.concatenate(parts).tolist()) == list(range(BITS))
        counts = [[np.bincount(value(bits, p), minlength=1 << len(p)) for p in pieces(part)] for part in parts]
        search = Search(parts, counts, len(x))
        _, chosen = search.thresholds(bits)
        assert (chosen.sum(1) == 3 - m + 1).all() and chosen.min() >= -1
        for d in range(4):
            for row in range(0, 3000, 97):
                flips = r.choice(64, d, replace=False)
                inside = [np.isin(flips, part).sum() <= t for part, t in zip(parts, chosen[row], strict=True)]
                assert any(inside)


def test_counts_at_a_distance():
    c = np.random.default_rng(1).integers(0, 9, 64)
    got = at_distance(c)
    for v in (0, 5, 63):
        assert got[:, v].tolist() == [sum(c[w] for w in range(64) if bin(v ^ w).count("1") == d) for d in range(4)]


def test_documents_equal_brute_force(spark):
    r = random.Random(8)
    base = [" ".join(r.choice(["red", "Blue", "sea", "Sky", "É", "run"]) + str(r.randint(0, 60)) for _ in range(120)) for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b", *base, *base[:20]]
    texts += [" ".join(w for i, w in enumerate(t.split()) if i != r.randint(0, 119)) for t in base[:10] for _ in range(12)] + ["long words " * 300_000]
    rows = [(i if i % 9 else None, t, *["clash"] * 4, 3) for i, t in enumerate(texts)]
    rows += rows[:30]
    got = simhash_components(spark.createDataFrame(rows, SCHEMA), limit=30).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = least_reachable(prints, [d for d, *_ in rows])
    assert sorted((repr(x.doc_id), x.fp % (1 << 64), repr(x.component_id)) for x in got) == sorted((repr(d), p, repr(c)) for (d, *_), p, c in zip(rows, prints, want, strict=True))
    assert len({c for c in want}) < len(rows) - 100


def test_an_empty_table_gives_no_row(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    prints = [fingerprint(d.text) for d in docs]
    want = least_reachable(prints, [d.doc_id for d in docs])
    got = QUERIES["op12_simhash_near_dedup"](spark, path)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == sorted((d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, want, strict=True))
