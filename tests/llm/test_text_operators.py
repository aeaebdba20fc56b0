import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from quernstone.llm import decontaminate, jaccard, language, licenses, lines, substrings, tokenfile  # noqa: E402
from quernstone.llm.bpe import bpe_round_trip  # noqa: E402
from quernstone.llm.common import Scratch  # noqa: E402
from quernstone.llm.rangecoder import decode_segment, encode_segment  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, score int"
R = random.Random(5)


def prose(n, alphabet="abcdefghijklmnop"):
    return " ".join("".join(R.choice(alphabet) for _ in range(R.randint(2, 7))) for _ in range(n))


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 12}", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


BASE = prose(120)
EDGE = [None, "", " ", "word", "a b", "Ünï cödé 日本語 text", "x" * 3000, "ab " * 1500, BASE, BASE, BASE.replace("a", "b", 1), "<|endoftext|> in text", "it's we'll  \n\n end "]


def test_license_places_and_labels(spark):
    texts = [*EDGE, "MIT License. mit-license; Apache License, Version 2.0", "the General Public\nLicense", "general license", "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        hits = [(k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == (min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
    assert "cc-nc" in got[len(texts) - 1].labels


def test_bpe_equals_the_library(spark):
    t = tokenizers.Tokenizer.from_file(PATH)
    texts = [*EDGE, *("".join(R.choice([" ", "\n", "'s", "é", "Ab", "12", "³", "!?", "　", "<|endoftext|>", "😀"]) for _ in range(20)) for _ in range(100))]
    got = {r.doc_id: r for r in bpe_round_trip(documents(spark, texts), PATH, keep=True).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_token_file_round_trip(spark, tmp_path):
    t = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in tokenfile.token_file(documents(spark, EDGE).repartition(3), PATH, 2, f"file://{tmp_path}/ids").collect()}
    at = 0
    for i, x in enumerate(EDGE):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = tokenfile.token_file(documents(spark, EDGE).where("doc_id < 0"), PATH, 2, f"file://{tmp_path}/none")
    assert empty.count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 4097, 70_000])
def test_range_coder(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_257, n), r.zipf(1.3, n) % 50_257, np.zeros(n)):
        ids = ids.astype(np.int32)
        assert (decode_segment(encode_segment(ids)) == ids).all()


def test_damaged_blocks_tables_and_missing_blocks_are_noticed():
    whole = encode_segment(np.arange(30_000, dtype=np.int32) % 700)
    for at in (2, 30, len(whole) // 2, len(whole) - 20):
        data = bytearray(whole)
        data[at] ^= 1
        with pytest.raises(ValueError):
            decode_segment(bytes(data))
    with pytest.raises(ValueError):
        decode_segment(whole[: whole.rindex(b"QRC1")])


def test_coded_ids_are_smaller_than_their_order_0_entropy():
    r = np.random.default_rng(8)
    words = [r.integers(0, 3000, r.integers(1, 5)) for _ in range(4000)]
    ids = np.concatenate([words[i] for i in np.minimum(r.zipf(1.2, 150_000) - 1, 3999)]).astype(np.int32)
    count = np.bincount(ids)
    count = count[count > 0]
    entropy = -(count * np.log2(count / len(ids))).sum() / 8
    assert len(encode_segment(ids)) < 0.9 * min(entropy, len(zlib.compress(ids.astype("<u2").tobytes(), 9)))


def _without_repeats(texts):
    """By brute force, what op3 gives for each text."""
    raw = [(t or "").encode() for t in texts]
    windows = Counter(b[i:i + 400] for b in raw for i in range(len(b) - 399))
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if windows[b[k:k + 400]] > 1:
                gone[k:k + 400] = True
        gone = gone[: len(b)]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        yield len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize(("group", "few", "batches", "chunk"), [(2048, 500_000, 4, 2 << 20), (2, 0, 3, 1000), (3, 500_000, 4, 2 << 20)])
def test_repeated_strings_are_removed(spark, monkeypatch, group, few, batches, chunk):
    for name, value in (("GROUP", group), ("FEW", few), ("CHUNK_BYTES", chunk)):
        monkeypatch.setattr(substrings, name, value)
    shared, long = prose(90), prose(400)
    texts = [*EDGE, *(prose(20) + "".join(R.choice("abcdef") for _ in range(k)) * (450 // k) + prose(20) for k in (1, 9, 50, 150, 200, 225)), *(f"{prose(40)} {shared} {prose(30)}" for _ in range(9)), long + long, shared[:399], shared[:401] + prose(3), "é" * 500]
    got = {r.doc_id: r for r in substrings.substring_dedup(documents(spark, texts), batches).collect()}
    for i, want in enumerate(_without_repeats(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert substrings.substring_dedup(documents(spark, texts).where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("group", [2048, 8])
def test_planted_passages_of_all_lengths_are_removed(spark, monkeypatch, group):
    passages = [(prose(400) + "x" * 999)[: R.randint(380, 800)] for _ in range(60)]
    texts = [f"{prose(R.randint(1, 60))} {R.choice(passages)} {prose(R.randint(1, 60))}" for _ in range(300)]
    line = "the same line on all of the pages, as pages have them at their foot, so often that it says nothing. "
    texts += [prose(R.randint(1, 90)) + line * R.choice([1, 1, 1, 2, 5]) + prose(R.randint(1, 90)) for _ in range(80)]
    monkeypatch.setattr(substrings, "GROUP", group)
    got = {r.doc_id: r for r in substrings.substring_dedup(documents(spark, texts).repartition(7)).collect()}
    for i, want in enumerate(_without_repeats(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_arrays_are_sorted_with_their_common_prefixes_and_periodic_text_is_sparse(spark):
    for text in ("x" * 200_000, "ab " * 70_000, prose(40_000)):
        data = np.frombuffer(text.encode(), np.uint8)
        rows = substrings.sampled(data, np.array([0, len(data)]))
        assert len(rows[0]) < 4 * len(data) / (substrings.SIZE - substrings.GRAM)
        assert (rows[3] - rows[2] + 1).sum() == len(data) - substrings.SIZE + 1
    family = substrings.IndexFamily(Scratch(spark))
    docs = documents(spark, [prose(300) for _ in range(40)] + [BASE * 4] * 9).selectExpr("xxhash64(doc_id, text) th", "text")
    for i in range(3):
        family.add(docs.where(f"pmod(th, 3) = {i}").mapInArrow(substrings._index, substrings._ARRAY))
    assert sorted(family.levels) == [0, 1]
    for _, level in family.levels.values():
        rows = level.orderBy("suffix").collect()
        assert len({bytes(r.suffix) for r in rows}) == len(rows)
        for a, b in zip(rows, rows[1:], strict=False):
            common = next(i for i in range(65) if a.suffix[:i + 1] != b.suffix[:i + 1])
            assert b.lcp in (common, 0)  # 0 where a partition begins


def _components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [(i, len(s), root[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("limit", [jaccard.LIMIT, 1500])
def test_jaccard_components(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "LIMIT", limit)

    def edited(words, rate):
        return " ".join(R.choice(["zz", "yy", "xx"]) + str(R.random()) if R.random() < rate else w for w in words)

    words = prose(150).split()
    texts = [*EDGE, *(edited(words, r) for r in [0.01, 0.02, 0.03, 0.05, 0.08] * 8), *(prose(60) + " " + " ".join(words[:60]) for _ in range(10)), "a b c", "a b c", "a b d"]
    got = sorted(tuple(r) for r in jaccard.jaccard_components(documents(spark, texts), k=4, num=85, den=100).collect())
    assert got == _components(texts, 4, 85, 100)
    assert jaccard.jaccard_components(documents(spark, texts).where("doc_id < 0")).count() == 0


def test_chains_of_near_copies_link_through_the_tree(spark):
    # each text differs from the next by one word, so hubs link few of them and the rest is left to the searches
    words, texts = prose(90).split(), []
    for i in range(40):
        words = [*words[:2 * i], f"new{i}", *words[2 * i + 1:]]
        texts.append(" ".join(words))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(documents(spark, texts), k=4, num=85, den=100).collect())
    assert got == _components(texts, 4, 85, 100)


def test_a_large_group_of_near_copies_gives_no_pairs(spark):
    words = prose(200).split()
    texts = [" ".join([*words[:i % 50], f"x{i}", *words[i % 50 + 1:]]) for i in range(2000)]
    got = jaccard.jaccard_components(documents(spark, texts), k=4, num=85, den=100).collect()
    assert len(got) == 2000 and {r.component_id for r in got} == {0}


def test_equal_first_hashes_do_not_merge_sets():
    h, off = np.arange(1, 7, dtype=np.uint64), np.array([0, 3, 6])
    cid, other = jaccard.class_of(h, off, np.zeros(0, np.int64))
    again, same = jaccard.class_of(h, off, cid[:1].view(np.int64))
    assert again[0] != cid[0] and again[1] == cid[1] and (same == other).all()


def test_null_ids_link_and_repeated_rows_stay(spark):
    rows = [(None, BASE), (None, BASE + " more words here"), (7, BASE + " more words there"), (7, BASE + " more words there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(df).collect()} == {7}
    assert jaccard.jaccard_components(df).count() == 4


def test_tree_finds_what_the_bound_allows():
    r = np.random.default_rng(3)
    sizes = np.full(300, 200)
    base = r.multinomial(200, np.full(jaccard.VECTOR, 1 / jaccard.VECTOR))
    points = np.array([r.multinomial(200, np.full(jaccard.VECTOR, 1 / jaccard.VECTOR)) if i % 3 else np.maximum(base - (r.random(jaccard.VECTOR) < 0.04), 0) for i in range(300)]).astype("<u2")
    tree = jaccard.CountTree(points, sizes)
    for i in range(0, 300, 37):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= jaccard.least_overlap(np.int64(200), sizes, 85, 100))
        assert sorted(tree.search(points[i], 200, 85, 100)) == want.tolist()
    pairs = [(i, j) for a, b in tree.pairs(points, sizes, 85, 100) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(300) for j in sorted(tree.search(points[i], 200, 85, 100).tolist())]


def test_language_of_held_out_texts(spark):
    a, b = "abcde", "vwxyz"
    rows = [(i, prose(60, a if i % 2 else b) if i % 9 else None, "aa" if i % 2 else "bb", "s", 1, "clash", 1) for i in range(80)] + [(99, "123 !!", None, None, 1, "c", 1), (None, prose(30, a), None, "s", 1, "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA).drop("score")
    for r in language.add_language(df).collect():
        want = "und" if r.text is None or r.doc_id == 99 else "aa" if r.doc_id is None else r.lang
        assert r.lang_pred == want and 0 <= r.score <= 1
    assert {r.lang_pred for r in language.add_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_phrases_are_longest_matches():
    sample = {"aa": prose(200, "abcde"), "bb": prose(200, "defgh")}
    parser = language.Parser(sample)
    code = lambda t: parser.lut[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
    plain = {k: bytes(code(t)) for k, t in sample.items()}
    for text in (prose(60, "abcdefgh"), prose(2, "ab"), "a", prose(300, "defg")):
        codes = code(text)
        got = parser.phrases(codes, np.array([0, len(codes)]))[0]
        for k, lang in enumerate(parser.langs):
            n = 0
            for a in range(0, len(codes), language.BLOCK):
                block, at = bytes(codes[a:a + language.BLOCK]), 0
                n += 1
                while at < len(block):
                    size = 0
                    while at + size < len(block) and block[at:at + size + 1] in plain[lang]:
                        size += 1
                    if at + size >= len(block):
                        break
                    n += 1  # the character that ends a phrase begins the next one, or stands alone
                    at += size + (block[at + size:at + size + 1] not in plain[lang])
            assert got[k] == n, (lang, got[k], n)


def test_lines_on_many_sites_go(spark):
    texts = [f"own {prose(8)}\nshared line here\n\nlast {prose(9)}" for _ in range(11)] + [None, "", "shared line here", "few sites\nother " + prose(5), "few sites\nanother " + prose(5)]
    got = {r.doc_id: r for r in lines.line_dedup(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = t.replace("shared line here\n", "") if t and t != "shared line here" else t
        assert got[i].text == want and got[i].n_removed == int(want != t) and got[i].n_lines == (0 if t is None else t.count("\n") + 1)
    assert set(documents(spark, texts).columns) < set(lines.line_dedup(documents(spark, texts)).columns)


def test_short_pages_lose_their_boilerplate_too(spark):
    shared = "a long line of boilerplate that every site carries, much longer than the page"
    texts = [f"{shared}\nown {i}" for i in range(11)] + [f"{shared}\n\n{shared}"]
    got = {r.doc_id: r for r in lines.line_dedup(documents(spark, texts)).collect()}
    assert all((got[i].text, got[i].n_removed) == (f"own {i}", 1) for i in range(11))
    assert (got[11].text, got[11].n_removed) == (texts[11], 0)


def _bag(words):
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def _similar(a, b):
    size = lambda g: sum(len(w.encode()) for w in g)
    least, most = sum(n * size(g) for g, n in (a & b).items()), sum(n * size(g) for g, n in (a | b).items())
    return least / most if most else 0.0


def test_contaminated_documents_equal_brute_force(spark):
    items = [prose(R.choice([6, 20, 20, 35])) for _ in range(25)]
    texts = [None, "", "one two"]
    for i in range(150):
        words = items[i % 25].split()
        rate = R.choice([0, 0.02, 0.04, 0.06, 0.1])
        texts.append(f"{prose(R.randint(0, 20))} {' '.join(w if R.random() >= rate else prose(1) for w in words)} {prose(R.randint(0, 20))}")
    want = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        for i, item in enumerate(items):
            x = item.split()
            best = max((_similar(_bag(w[k:k + len(x)]), _bag(x)) for k in range(max(len(w) - len(x), 0) + 1)), default=0) if w else 0
            if best >= decontaminate.THRESHOLD:
                want[d, i] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == want and len(want) > 80


def test_values_near_a_piece_reach_the_radius():
    r = np.random.default_rng(1)
    widths = np.tile(np.diff(decontaminate._BOUNDS), 2)
    assert widths.sum() == 128 and decontaminate.RADIUS < decontaminate.BLOCKS * (decontaminate.NEAR + 1)
    for _ in range(300):
        flips = np.zeros(128, int)
        flips[r.choice(128, decontaminate.RADIUS, replace=False)] = 1
        pieces = np.split(flips, np.cumsum(widths)[:-1])
        assert any(sum(b << i for i, b in enumerate(p.tolist())) in decontaminate.near_values(len(p)) for p in pieces)


def test_contaminated_documents_are_found_and_clean_ones_left(spark):
    items = [prose(36) for _ in range(12)] + ["one two", ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    half = " ".join(items[2].split()[:15])
    texts = [*EDGE, f"{prose(50)} {items[0].upper()}. {prose(50)}", items[1], f"{prose(9)} {half} {prose(9)}", " ".join(w if i != 17 else "changed" for i, w in enumerate(items[3].split())), "zero one two three"]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    n = len(EDGE)
    changed = _similar(_bag(items[3].split()), _bag(texts[n + 3].split()))
    assert set(got) == {(n, 0), (n + 1, 1), (n + 4, 12)} | ({(n + 3, 3)} if changed >= decontaminate.THRESHOLD else set())
    assert got[n, 0] == got[n + 1, 1] == 1.0
    left = {r.doc_id for r in decontaminate.clean(documents(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in got}
