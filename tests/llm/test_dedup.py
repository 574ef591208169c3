"""Substring and SimHash de-duplication, the positional index: brute force."""

import hashlib

import numpy as np
import pytest
import xxhash
from cases import LONG, PASSAGE, TEXTS, by_rows, docs, lower, plain, spaced

from jobsift.llm import positional_index as P
from jobsift.llm import simhash_dedup as S
from jobsift.llm import substring_dedup as D
from jobsift.llm.components import components


def brute_substring(texts, size):
    first = {}
    rank = lambda i: float("inf") if i is None else i
    for i, t, _ in texts:
        w = spaced(t)
        for a in range(len(w) - size + 1):
            key = tuple(w[a:a + size])
            first[key] = min(first.get(key, float("inf")), rank(i))
    out = []
    for i, t, _ in texts:
        w = spaced(t)
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a:a + size])] < rank(i):
                gone.update(range(a, a + size))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return out


@pytest.mark.parametrize("size", [50, 5])
def test_substring_equals_brute_force(spark, size):
    got = D.substring_dedup(docs(spark), window=size)
    assert len(set(got.columns)) == len(got.columns) and "source" in got.columns
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()]
    assert by_rows(rows) == by_rows(brute_substring(TEXTS, size))


def test_a_narrow_sketch_loses_nothing(spark, monkeypatch):
    texts = [(i, f"{PASSAGE} {LONG[:i * 400]}", "en") for i in range(25)]
    monkeypatch.setattr(D, "RANGE_CELLS", 1 << 8)
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept_text)
            for r in D.substring_dedup(docs(spark, texts), window=20).collect()]
    assert by_rows(rows) == by_rows(brute_substring(texts, 20))


def test_windows_counted_twice_are_all_flagged():
    key = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    for bits in (10, 20):
        cells = D._cells(key, 0, bits)
        assert cells.max() < 1 << bits


def brute_fingerprint(text):
    w = spaced(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_simhash_equals_brute_force(spark):
    prints = [brute_fingerprint(t) for _, t, _ in TEXTS]
    root = brute_classes(prints)
    least = {}
    for r, (i, _, _) in zip(root, TEXTS):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = [(i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(TEXTS, prints, root)]
    assert by_rows(map(tuple, S.simhash_near_dedup(docs(spark)).collect())) == by_rows(want)
    kept = S.one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns and kept.count() == len(set(root))


def chained(rng, n):
    """Random codes, chains of codes three bits apart, and tight clusters."""
    codes = list(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    for _ in range(n):
        at = codes[rng.integers(len(codes))]
        flips = rng.choice(64, rng.integers(1, 6), replace=False)
        codes.append(at ^ np.uint64(sum(1 << int(b) for b in flips)))
    return np.unique(np.array(codes, np.uint64))


@pytest.mark.parametrize("d", [0, 1, 3])
def test_gray_index_finds_every_link(d):
    rng = np.random.default_rng(d)
    codes = chained(rng, 400)
    bucket = (codes >> np.uint64(61)).astype(np.int64)
    index = S.GrayIndex(bucket, codes, fan_out=4)
    i, j = index.links(d, np.arange(len(codes)))
    b = bucket[index.order]
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= d
    want = {(x, y) for x, y in zip(*np.nonzero(near)) if x < y and b[x] == b[y]}
    assert set(zip(i.tolist(), j.tolist())) == want
    assert (np.diff(S.gray_rank(index.codes[b == b[0]]).astype(object)) > 0).all()


def test_links_join_the_same_classes_as_all_pairs(spark):
    codes = chained(np.random.default_rng(7), 150)
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "__fp long")
    root = {r.a: r.root for r in components(S.links(table)).collect()}
    of = lambda c: root.get(int(c), int(c))
    want = brute_classes([int(c) for c in codes])
    got = [of(c) for c in codes.view(np.int64)]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (60, 59)]
    got = {r.a: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1200)}


def brute_matches(text, item):
    w, q = plain(text), plain(item)
    n = min(13, len(q))
    windows = {tuple(q[a:a + n]) for a in range(max(1, len(q) - 12))} if q else set()
    return {x for a in range(len(w) - n + 1) if tuple(w[a:a + n]) in windows for x in range(a, a + n)}


BENCHMARK = [(1, " ".join(PASSAGE.split()[10:40])), (2, "brown FOX jumps"), (3, None), (4, "..."), (10, "one"),
             (10, "one"), (11, "lazy dog over quick"), (None, "two"), (12, " ".join(PASSAGE.split()[:13]))]


def test_index_equals_brute_force(spark):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = P.decontaminate(docs(spark), bench)
    rows = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()]
    want = []
    for i, t, _ in TEXTS:
        hits = [("" if k is None else str(k), brute_matches(t, x)) for k, x in BENCHMARK]
        n, words = len(set().union(*[h for _, h in hits])), len(plain(t))
        want.append((i, words, n, tuple(sorted({k for k, h in hits if h})), n > 0 and 20 * n >= words))
    assert by_rows(rows) == by_rows(want)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) >= r.n_hit


def test_proximity_matches_words_out_of_order(spark):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    near = {r.doc_id: r.near_items for r in P.decontaminate(docs(spark), bench).collect()}
    assert "11" in near[1] and "11" not in near[8]


def test_queries_are_sent_in_pieces(spark, monkeypatch):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    whole = P.decontaminate(docs(spark), bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    monkeypatch.setattr(P, "QUERY_WORDS", 4)
    pieces = P.decontaminate(docs(spark), bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    assert by_rows(whole) == by_rows(pieces)


def test_clean_documents_keep_rows_and_columns(spark):
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    bad = P.decontaminate(docs(spark), bench).filter("contaminated").count()
    clean = P.clean_documents(docs(spark), bench)
    assert bad and clean.count() == len(TEXTS) - bad and clean.columns == docs(spark).columns


def test_empty_tables(spark):
    none = docs(spark, [])
    assert D.substring_dedup(none).count() == 0
    assert S.simhash_near_dedup(none).count() == 0
    assert S.one_of_each(none).count() == 0
    bench = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    assert P.decontaminate(none, bench).count() == 0
    rows = P.decontaminate(docs(spark), bench.limit(0)).collect()
    assert len(rows) == len(TEXTS) and not any(r.contaminated for r in rows)
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
