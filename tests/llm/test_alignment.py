"""Two tokenizers' tokens: encoding by the libraries themselves, groups, links and counts by brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import TEXTS, by_rows, docs
from hypothesis import given, settings, strategies as st

from jobsift.llm import cross_tokens as X
from jobsift.llm.blocks import importable

MORE = [(20, "a ▁ b", None), (21, "ﬁne  \t x\n\n y ", None), (22, "<|endoftext|> <s> </s> <unk> <0x41>", None),
        (23, " lead and trail ", None), (24, " é́ ​한글 \U0001F468‍\U0001F469", None), (25, "naïve " * 40, None)]


@pytest.fixture(scope="module")
def pair():
    with open(X.BYTE_BPE, encoding="utf-8") as f, open(X.PIECES, "rb") as g:
        return X.Pair(f.read(), g.read())


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(X.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=X.PIECES)


def brute_tokens(pair, libraries, text):
    if not text:
        return [], []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    raw = (" " + text).encode()
    ok = b"".join(pair.a.bytes[i] for i in a) == raw == b"".join(pair.b.bytes[i] for i in b)
    return (a, b) if ok else ([], [])


def spans(table, ids):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def brute_groups(pair, a, b):
    a, b = spans(pair.a.bytes, a), spans(pair.b.bytes, b)
    cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    out, at = [], 0
    for c in cuts:
        out.append(([i for s, e, i in a if at < e <= c], [i for s, e, i in b if at < e <= c]))
        at = c
    return out


def brute_links(pair, a, b):
    a, b = spans(pair.a.bytes, a), spans(pair.b.bytes, b)
    return [(i, j) for s, e, i in a for t, f, j in b if s < f and t < e]


def brute_rows(pair, libraries, rows):
    tokens = [(i, *brute_tokens(pair, libraries, t)) for i, t, *_ in rows]
    links = [brute_links(pair, a, b) for _, a, b in tokens]
    count = Counter(p for ls in links for p in set(ls))
    best = defaultdict(int)
    for (i, _), c in count.items():
        best[i] = max(best[i], c)
    out = []
    for (i, a, b), ls in zip(tokens, links):
        groups = brute_groups(pair, a, b)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(ls), sum(count[p] == best[p[0]] for p in ls),
                    sum(count[p] for p in ls), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_rows_equal_brute_force(spark, pair, libraries):
    importable(spark)
    texts = [t for t in TEXTS + MORE if len(t[1] or "") < 2000] + [(26, "x" * 900, None)]
    table = docs(spark, texts).repartition(3)
    got = X.alignment_counts(table)
    assert got.columns == COLUMNS
    assert by_rows(map(tuple, got.collect())) == by_rows(brute_rows(pair, libraries, texts))


def test_documents_of_the_table(spark, pair, libraries):
    from jobsift.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in rows if len(t or "") < 600}
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_token_alignment"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        a, b = brute_tokens(pair, libraries, t)
        assert got[i][1:3] == (len(a), len(b))
        if i in short:
            assert got[i][3:5] == (len(brute_groups(pair, a, b)), len(brute_links(pair, a, b)))


def test_counts_across_blocks(spark, pair, libraries, monkeypatch):
    """Copies make a pair's count; they may lie in any task."""
    importable(spark)
    texts = [(i, f"shared words hating café {'extra ' * (i % 3)}{i % 7}", None) for i in range(60)]
    got = X.alignment_counts(docs(spark, texts).repartition(7))
    assert by_rows(map(tuple, got.collect())) == by_rows(brute_rows(pair, libraries, texts))


def test_alignments_give_the_tokens(spark, pair, libraries):
    importable(spark)
    rows = X.alignments(docs(spark, MORE)).collect()
    for r, (i, t, _) in zip(sorted(rows, key=lambda r: r.doc_id), MORE):
        a, b = brute_tokens(pair, libraries, t)
        assert (r.ids_a, r.ids_b) == (a, b)
        assert [(g.n_a, g.n_b) for g in r.groups] == [(len(x), len(y)) for x, y in brute_groups(pair, a, b)]


def test_empty_table(spark):
    importable(spark)
    empty = docs(spark, [])
    assert X.alignment_counts(empty).collect() == [] and X.alignments(empty).collect() == []
    assert [tuple(r) for r in X.alignment_counts(docs(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_shared_cuts(data):
    bounds, ends, want = [[0], [0]], [[], []], []
    base = 0
    for _ in range(data.draw(st.integers(0, 4))):
        n = data.draw(st.integers(0, 40))
        if n:
            sides = [sorted({*data.draw(st.sets(st.integers(1, n))), n}) for _ in range(2)]
            for s in (0, 1):
                ends[s] += [base + e for e in sides[s]]
            want += [e in set(sides[1]) for e in sides[0]]
            base += n
        for s in (0, 1):
            bounds[s].append(len(ends[s]))
    got = X.shared_cuts(*(np.array(x, np.int64) for x in (*ends, *bounds)))
    assert got.tolist() == want


def test_long_runs_and_long_texts(pair, libraries, monkeypatch):
    run = " " * 2_000_000 + "x" + "\n" * 1_200_000
    a, b, n_a, n_b = pair.encode([run])
    assert a.tolist() == libraries[0].encode(" " + run, add_special_tokens=False).ids
    assert b.tolist() == libraries[1].encode(run) and n_a[0] == len(a)
    rng = random.Random(4)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "don't", ".", "▂", "7"]) for _ in range(4000))
    whole = pair.encode([text])
    monkeypatch.setattr(X, "CUT", 50)
    assert len(pair.parts(text)) > 20 and all((x == y).all() for x, y in zip(whole, pair.encode([text])))
