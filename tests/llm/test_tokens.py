"""Piece lattices, packing and the language model: brute force and invariants."""

import itertools
import random
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import TEXTS, by_rows, docs, lower, spaced
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm import packed_ids as K
from jobsift.llm import pitman_yor as Y
from jobsift.llm import sentence_pieces as S


@pytest.fixture(scope="module")
def model():
    return S.Model.read()


def brute_segmentations(model, text):
    out = []

    def go(at, score, labels):
        if at == len(text):
            out.append((score, labels))
            return
        for b in range(at + 1, len(text) + 1):
            i = model.ids.get(text[at:b])
            if i is not None:
                go(b, score + model.scores[i], labels + [i])
            elif b == at + 1:
                go(b, score + model.unknown, labels + [len(model.scores) + ord(text[at])])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: (-x[0], x[1][::-1]))


@pytest.mark.parametrize("unit", [" the", " hating", "  x", " 梦a", "\n", " aaaaaa", " éèé", "▁"])
def test_unit_lattice_equals_brute_force(model, unit):
    want = brute_segmentations(model, unit)
    assert S.n_best(S.edges(model, unit), 5) == [(s, x) for s, x in want[:5]]
    score, second, labels = S.two_best(model, unit)
    assert (score, labels) == want[0] and second == (want[1][0] if len(want) > 1 else float("-inf"))


def test_units_walked_together_equal_units_walked_alone(model):
    rng = random.Random(2)
    units = [" " * rng.randint(0, 2) + "".join(rng.choice("thesangé梦▁.\U0001F600") for _ in range(rng.randint(1, 30)))
             for _ in range(300)] + ["\n", " ", "x", "\x00"]
    one, two, ids, n = S.Trie(model).two_best(units)
    ends = np.cumsum(n)
    for i, u in enumerate(units):
        score, second, labels = S.two_best(model, u)
        assert (one[i], two[i], ids[ends[i] - n[i]:ends[i]].tolist()) == (score, second, model.expand(labels))


@pytest.mark.parametrize("text", ["the cat", "aa aa", "a b c", "x\ny  z", " ▁q é", " ", "a a a a"])
@pytest.mark.parametrize("k", [1, 2, 4])
def test_text_n_best_equals_brute_force(model, text, k):
    flat, _, best = S._encoded(S.Units(model), [text], k)
    want = brute_segmentations(model, " " + text)[:k]
    assert [x["score"] for x in best[0]] == [s for s, _ in want]
    seen = set()
    for x in best[0]:
        ids = flat.tolist()
        for e in reversed(x["edits"]):
            ids[e["start"]:e["end"]] = e["ids"]
        assert b"".join(model.texts[i] for i in ids) == (" " + text).encode()
        seen.add(tuple(ids))
    assert len(seen) == len(best[0])


def test_texts_are_restored(spark, model):
    df = S.decode(S.encode(docs(spark)).withColumn("third", F.when(F.size("nbest") > 2, S.segmentation(2))))
    rows = df.collect()
    assert by_rows((r.doc_id, r.decoded) for r in rows) == by_rows((i, t) for i, t, _ in TEXTS)
    same = S.encode(docs(spark), restored="again").select("doc_id", "again").collect()
    assert by_rows(map(tuple, same)) == by_rows((i, t) for i, t, _ in TEXTS)
    for r in rows:
        if r.text is None:
            assert r["ids"] is None and r.nbest is None
            continue
        assert r.nbest[0].edits == [] and [x.score for x in r.nbest] == sorted((x.score for x in r.nbest), reverse=True)
        if r.third:
            assert b"".join(model.texts[i] for i in r.third)[1:].decode() == r.text and r.third != r["ids"]
    assert S.encode(docs(spark, [])).count() == 0


def test_units_forget_without_changing_results(model, monkeypatch):
    texts = [t for _, t, _ in TEXTS]
    want = [x[0]["score"] if x else None for x in S._encoded(S.Units(model), texts, 2)[2]]
    monkeypatch.setattr(S, "UNIT_LIMIT", 3)
    units = S.Units(model)
    assert [S._encoded(units, [t], 2)[2][0][0]["score"] for t in texts] == want


def test_paths_order_as_the_tuples_of_their_labels():
    rng = random.Random(4)
    paths = [((), S.Path())]
    for _ in range(400):
        labels, path = rng.choice(paths[-30:])
        x = rng.randint(0, 3)
        if (*labels, x) not in dict(paths):
            paths.append(((*labels, x), S.Path(path, x)))
    for _ in range(5000):
        (a, p), (b, q) = rng.choice(paths), rng.choice(paths)
        assert (p < q) == (a < b) and tuple(p.labels()[::-1]) == a


def test_a_long_unit_costs_memory_by_its_length(model):
    rng = random.Random(6)
    for size, mb in ((10_000, 40), (200_000, 400)):  # the short one first: it fails where the long one would not end
        unit = " " + "".join(rng.choice("ABCDefgh0123+/") for _ in range(size))
        tracemalloc.start()
        best = S.n_best(S.edges(model, unit), 4)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < mb << 20
        score, second, labels = S.two_best(model, unit)
        assert best[0] == (score, labels) and best[1][0] == second
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
        assert len({tuple(x) for _, x in best}) == 4
        assert all(b"".join(model.texts[i] for i in model.expand(x)) == unit.encode() for _, x in best)
    flat, _, found = S._encoded(S.Units(model), [unit[1:]], 4)
    assert [x["score"] for x in found[0]] == [s for s, _ in best] and flat.tolist() == model.expand(best[0][1])


def test_best_fit_takes_the_least_room():
    rng = random.Random(3)
    for length in (1, 7, 64, 100):
        lengths = [rng.randint(1, length) for _ in range(300)]
        rows = K.best_fit(lengths, length)
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fit = min((r for r in room if r >= lengths[i]), default=None)
            if fit is None:
                room.append(length - lengths[i])
            else:
                room[room.index(fit)] = fit - lengths[i]
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(length - sum(lengths[i] for i in r) for r in rows) == sorted(room) and want == []


@pytest.mark.parametrize("length", [8, 2048])
def test_packing_is_lossless(spark, length):
    texts = [(n, t, x) for n, (_, t, x) in enumerate(TEXTS)]
    packed = K.pack_ids(docs(spark, texts), length=length, group=500).withColumn("positions", K.position_ids())
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == length and r.cu_seqlens[-1] == r.n_tokens == len(r.positions) <= length
        assert r.resets == r.cu_seqlens[:-1] and all(r.positions[a] == 0 for a in r.resets)
        assert [s.length for s in r.segments] == np.diff(r.cu_seqlens).tolist() and (ids[r.n_tokens:] == K.END).all()
    assert dict(map(tuple, K.decoded(packed).collect())) == {i: t or "" for i, t, _ in texts}
    assert K.pack_ids(docs(spark, [])).count() == 0
    assert K.pack_ids(docs(spark)).agg(F.sum(F.size("segments"))).first()[0] >= len(TEXTS)


def training(text, i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def trains():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1


def test_counts_and_base_equal_brute_force(spark):
    tokens = [[w.encode() for w in spaced(lower(t))] + [b""] for _, t, _ in TEXTS]
    train = [training(t, i) for i, t, _ in TEXTS]
    c = Counter(w for ws, on in zip(tokens, train) if on for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, on, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws), 6))
            for (i, _, _), ws, on in zip(TEXTS, tokens, train)]
    rows = Y.score_texts(docs(spark), trains()).collect()
    assert by_rows((r.doc_id, r["__train"], r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in rows) == by_rows(want)
    assert all(r.score < 0 for r in rows)


def test_empty_and_untrained_models(spark):
    assert Y.score_texts(docs(spark, []), trains()).count() == 0
    rows = Y.score_texts(docs(spark), F.lit(False)).collect()
    assert len(rows) == len(TEXTS) and all(r.train_tokens == 0 and abs(r.score) < 1e-6 for r in rows)


def gathered(rng, words=200, contexts=7, tokens=5000):
    w = (rng.zipf(1.4, tokens) - 1) % words
    key, n = np.unique(w * contexts + rng.integers(0, contexts, tokens), return_counts=True)
    h = np.sort(rng.integers(0, 1 << 63, words, dtype=np.uint64))
    here, each = np.unique(key // contexts, return_counts=True)
    return Y.Part.gathered([(h[here], each, key % contexts, n)], contexts), contexts


def test_seating_is_possible_and_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    part, contexts = gathered(rng)
    customers = np.bincount(part.context, part.customers, contexts)
    model = {"customers": customers, "types": len(part.words), "discount": 0.7, "top_discount": 0.6}
    for turn in range(4):
        v = part.sums(contexts)
        model |= {"tables": v[:-1], "top_customers": v[:-1].sum(), "top_tables": v[-1]}
        part.sweep(rng, model)
        m = np.add.reduceat(part.tables, part.ends[:-1])
        assert (1 <= part.tables).all() and (part.tables <= part.customers).all()
        assert (1 <= part.top).all() and (part.top <= m).all()
        if turn > 1:
            part.seats.append((part.tables.copy(), part.top.copy()))
    part = Y.Part.load(part.dump())
    v = part.sums(contexts).reshape(-1, contexts + 1)
    model["samples"] = [{"tables": x[:-1], "top_customers": x[:-1].sum(), "top_tables": x[-1]} for x in v]
    unknown = np.array([(1 << 64) - 1], np.uint64)
    words = np.append(part.words, unknown)
    for context in range(contexts):
        p, c = part.probabilities(words, np.ones(len(words), np.int64), np.full(len(words), context), model)
        assert (p > 0).all() and abs(p.sum() - 1) < 1e-9 and c[-1] == 0
        assert c[:-1].sum() == customers.sum()


def test_seating_follows_the_restaurant():
    """Mean number of tables of one dish that everyone eats, base 1: the
    Pitman-Yor process's own expectation."""
    d, strength, n = 0.5, 1.0, 50
    expected = 1.0
    for i in range(1, n):
        expected += (strength + d * expected) / (strength + i)
    tables, _ = Y.seat(np.random.default_rng(1), np.full(4000, n), 1.0, 0.0, np.zeros(4000), strength, d)
    assert abs(tables.mean() - expected) < 0.2


def test_held_out_texts_are_predicted_better_than_by_the_base(spark):
    rows = Y.op2_pitman_yor(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def stirling(n, d):
    s = np.zeros((n + 2, n + 2))
    s[0, 0] = 1
    for i in range(n):
        for k in range(n + 1):
            s[i + 1, k] += s[i, k] * (i - d * k)
            s[i + 1, k + 1] += s[i, k]
    return s

def exact(c, d, d0, S):
    words, contexts = c.shape
    s, s0 = stirling(c.max(), d), stirling(c.sum(), d0)
    rising = lambda n, step: np.prod(S + step * np.arange(n))
    at = np.argwhere(c)
    out, total, H = 0, 0, 1 / (words + 1)
    for t in itertools.product(*[range(1, c[i, j] + 1) for i, j in at]):
        T = np.zeros(c.shape, int)
        T[tuple(at.T)] = t
        m = T.sum(axis=1)
        a = np.prod([s[c[i, j], T[i, j]] for i, j in at]) * np.prod([rising(x, d) for x in T.sum(axis=0)]) / rising(m.sum(), 1)
        for top in itertools.product(*[range(1, x + 1) for x in m]):
            top = np.array(top)
            weight = a * np.prod([s0[m[i], top[i]] for i in range(words)]) * rising(top.sum(), d0) * H ** top.sum()
            parent = (np.append(m - d0 * top, 0) + (S + d0 * top.sum()) * H) / (S + m.sum())
            p = (np.vstack((c - d * T, np.zeros(contexts))) + (S + d * T.sum(axis=0)) * parent[:, None]) / (S + c.sum(axis=0))
            out, total = out + weight * p, total + weight
    return out / total


def sampled(c, d, d0, sweeps, seed=3):
    words, contexts = c.shape
    w, u = np.nonzero(c)
    part = Y.Part.gathered([(np.arange(words), np.bincount(w), u, c[w, u])], contexts)
    model = {"customers": c.sum(axis=0), "types": words, "discount": d, "top_discount": d0,
             "tables": np.bincount(part.context, part.tables, contexts), "top_customers": part.tables.sum(), "top_tables": words}
    rng, samples = np.random.default_rng(seed), []
    for i in range(sweeps):
        part.sweep(rng, model)
        if i >= 20:
            part.seats.append((part.tables.copy(), part.top.copy()))
            samples.append({k: model[k] for k in ("tables", "top_customers", "top_tables")})
    model["samples"] = samples
    n = words + 1
    p, _ = part.probabilities(np.arange(n), np.full(n, contexts), np.tile(np.arange(contexts), n), model)
    return p.reshape(n, contexts)


@pytest.mark.parametrize("customers", [[[2, 1], [1, 2], [0, 1]], [[3, 2], [0, 2]], [[1, 1, 1], [1, 0, 1], [0, 2, 0]]])
def test_probabilities_equal_enumeration(customers):
    c = np.array(customers)
    assert abs(exact(c, 0.5, 0.5, Y.STRENGTH) - sampled(c, 0.5, 0.5, 1000)).max() < 0.02


def test_every_word_is_a_context_of_its_own(spark):
    """600 rare words with one and the same ending, each followed by a word of
    its own: the right word must be far more probable than another's."""
    train = [(2, f"{i}xx y{i}zz", None) for i in range(600) for _ in range(3)]
    asked = [(1, f"{i}xx y{i}zz", "right") for i in range(0, 600, 60)] + [(3, f"{i}xx y{i + 1}zz", "wrong") for i in range(0, 600, 60)]
    rows = Y.score_texts(docs(spark, train + asked), F.col("doc_id") == 2).filter("doc_id <> 2").collect()
    right, wrong = ([r.score for r in rows if r.doc_id == i] for i in (1, 3))
    assert len(right) == len(wrong) == 10 and min(right) > max(wrong) + 1


def seat_plainly(rng, customers, base, step, others, strength, d):
    """``seat`` with every step of every dish taken as it comes."""
    order = np.argsort(-customers, kind="stable")
    t, weight, n = np.ones(len(order)), np.zeros(len(order)), np.ones(len(order))
    c, b, s, room = customers[order], base[order], step[order], strength + d * others[order]
    for at in range(1, Y.ONE_BY_ONE):
        k = np.flatnonzero(c > at)
        opens = (room[k] + d * t[k]) * (b[k] + s[k] * t[k])
        total = opens + at - d * t[k]
        weight[k] += np.log(total)
        t[k] += rng.random(len(k)) * total < opens
        n[k] = at + 1
    while len(k := np.flatnonzero(c > n)):
        opens, joins = (room[k] + d * t[k]) * (b[k] + s[k] * t[k]), n[k] - d * t[k]
        with np.errstate(divide="ignore", over="ignore"):
            wait = np.log(rng.random(len(k))) / np.log1p(-rng.beta(opens, joins))
        more = np.minimum(np.floor(wait), c[k] - n[k])
        new = more < c[k] - n[k]
        more += new
        weight[k] += Y._log_gamma(joins + opens + more) - Y._log_gamma(joins + opens)
        t[k], n[k] = t[k] + new, n[k] + more
    out, log = np.empty(len(order), np.int64), np.empty(len(order))
    out[order], log[order] = t, weight
    return out, log


@pytest.mark.parametrize("most", [1, 3, 16, 17, 40, 3000])
def test_dishes_seated_together_equal_dishes_seated_plainly(most):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 40))
        customers = np.minimum(rng.zipf(1.3, n), most)
        base, step, others = rng.random(n) ** 8, rng.random(n) / 1000, rng.integers(0, 5000, n)
        got = Y.seat(np.random.default_rng(seed), customers, base, step, others, 1.0, 0.75)
        want = seat_plainly(np.random.default_rng(seed), customers, base, step, others, 1.0, 0.75)
        assert (got[0] == want[0]).all() and np.allclose(got[1], want[1], rtol=1e-9)


def test_weights_of_many_tables_are_taken_together(monkeypatch):
    """Tables of a frequent dish once cost a call each."""
    calls, plain = [], Y._log_gamma
    monkeypatch.setattr(Y, "_log_gamma", lambda x: calls.append(len(x)) or plain(x))
    one = np.ones(50)
    tables, _ = Y.seat(np.random.default_rng(5), np.full(50, 5000), 0.05 * one, 0 * one, 2000 * one, 1.0, 0.75)
    assert tables.max() > 100
    assert len(calls) <= 2 + sum(calls) // (1 << 15)


def test_lookups_do_not_walk_the_part_again(monkeypatch):
    """A block's question once cost as much as the part is large."""
    rng, n = np.random.default_rng(1), 400
    word, context = np.divmod(np.sort(rng.choice(100 * 50, n, False)), 50)
    words = np.unique(word)
    part = Y.Part.gathered([(words * 3, np.bincount(word)[words], context, rng.integers(1, 9, n))], 50)
    part.seats = [(rng.integers(1, 5, n), rng.integers(1, 5, len(words))) for _ in range(2)]
    counted = part.counter(part.context, 50)
    for name in ("word_of", "by_word"):
        monkeypatch.delattr(Y.Part, name)
    held = {(3 * w, c): i for i, (w, c) in enumerate(zip(word, context))}
    asked = np.unique(rng.integers(0, 300, 40))
    per_word = rng.integers(0, 20, len(asked))
    contexts = rng.integers(-1, 50, per_word.sum())
    total, parent, customers, own = counted(asked, per_word, contexts)
    for i, w in enumerate(asked):
        mine = [x for (v, _), x in held.items() if v == w]
        assert total[i] == part.customers[mine].sum()
        for (m, top), (t, u) in zip(parent, part.seats):
            assert (m[i], top[i]) == (t[mine].sum(), u[words * 3 == w].sum())
    for key, k, t in zip(zip(np.repeat(asked, per_word), contexts), customers, own):
        x = held.get(key)
        assert (k, t) == ((0, 0) if x is None else (part.customers[x], sum(s[0][x] for s in part.seats)))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
def test_blocks_of_tokens_equal_plain_splits(kind):
    rng = random.Random(4)
    texts = [None, "", " ", "a", "\x1ca\x85 \xa0É  A"] + [
        "".join(rng.choice("aAbÉ  \n\t\x0b\x1c\x85") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "__train": pa.array([True] * len(texts)),
                            "text": pa.array([t and t.encode() for t in texts], pa.binary()).cast(kind)})
    table = B.load(Y.tokenised([rows.slice(0, 7), rows.slice(7)], "doc_id", "text"))
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    hashes = [xxhash.xxh64_intdigest(w) for w in sorted({w for ws in want for w in ws}, key=xxhash.xxh64_intdigest)]
    assert "text" not in table.column_names
    got, word = Y._held(table)
    assert got.astype(np.uint64).tolist() == hashes
    assert table.column("n_tokens").to_pylist() == [len(ws) for ws in want]
    assert [hashes[i] for i in word] == [xxhash.xxh64_intdigest(w) for ws in want for w in ws]


def test_distinct_equals_unique():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 500):
        keys = rng.integers(0, 60, n)
        for bound in (60, 1 << 62):
            assert all((a == b).all() for a, b in zip(Y._distinct(keys, bound), np.unique(keys, return_inverse=True)))
