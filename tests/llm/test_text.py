"""Quality rules, license scan, language spans and sharding: brute force."""

from collections import Counter

import pytest
import zlib
from cases import TEXTS, by_rows, docs, plain, spaced
from pyspark.sql import functions as F

from jobsift.llm import language_spans as G
from jobsift.llm import license_scan as L
from jobsift.llm import quality_rules as Q
from jobsift.llm import shard_hash as H

import numpy as np


def brute_statistics(text):
    w = spaced(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {x for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for x in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_statistics_equal_brute_force(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (8, None)], "doc_id long, quality int")
    got = Q.quality_rules(docs(spark), labels).collect()
    rows = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    want = []
    for i, t, _ in TEXTS:
        s = brute_statistics(t)
        want.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert by_rows(rows) == by_rows(want)
    assert all(r.kept == (not r.base_failed) for r in got)  # no usable bad label, no rule


def planted(spark, n=1500):
    texts = []
    for i in range(n):
        words = [f"w{(i * 31 + j * j) % 977}" for j in range(40)]
        bad = i % 5 == 0
        texts.append((i, " ".join(w + "$$$" if bad and j % 2 else w for j, w in enumerate(words)), "en"))
    return docs(spark, texts), spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(n)], "doc_id long, quality int")


def test_rules_find_the_planted_defect(spark):
    table, labels = planted(spark)
    rows = {r.doc_id: r for r in Q.quality_rules(table, labels).collect()}
    assert all(r.kept == (i % 5 != 0) for i, r in rows.items())
    kept = Q.kept_documents(table, labels)
    assert kept.columns == table.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i in rows if i % 5}


def test_rules_are_an_ordered_conditional(spark):
    rules = [[Q.Test("f_words", True, 10.0), Q.Test("f_words", False, 20.0)], [Q.Test("f_words", True, 5.0)]]
    got = spark.createDataFrame([(4.0,), (5.0,), (10.0,), (25.0,)], "f_words double").select(Q.rule_column(rules).alias("r"))
    assert [r.r for r in got.collect()] == [None, 2, 1, 2]


def test_quality_of_empty_tables(spark):
    table, labels = planted(spark, 20)
    assert Q.quality_rules(table.limit(0), labels).count() == 0
    assert Q.quality_rules(table, labels.limit(0)).count() == 20


def test_license_base_places_equal_brute_force(spark):
    want = []
    for i, t, _ in TEXTS:
        w = plain(t)
        places = [(a, label) for label, p in L.PHRASES for a in range(len(w)) if w[a:a + len(p.split())] == p.split()]
        want.append((i, len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                     ",".join(sorted({x for _, x in places}))))
    rows = L.license_scan(docs(spark)).collect()
    assert by_rows((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == by_rows(want)
    assert any(r.labels == "cc-by,cc-by-nc" for r in rows) and all(0 <= r.score <= 1 for r in rows)


def test_a_drifted_notice_is_one_span(spark):
    notice = dict((x, t) for x, t in L.NOTICES)["bsd"].split()
    drifted = notice[:7] + ["added"] + notice[7:]
    texts = [(1, "before " + " ".join(drifted) + " after", "en"), (2, " ".join(notice[::-1]), "en"),
             (3, " ".join(notice[:6]), "en")]
    rows = {r.doc_id: r for r in L.license_scan(docs(spark, texts)).collect()}
    assert [(s.label, s.start, s.end) for s in rows[1].spans] == [("bsd", 1, 1 + len(drifted))]
    assert rows[1].labels == "bsd" and rows[2].labels == "" and rows[3].labels == "" and 0 < rows[3].score < 0.9
    assert L.license_scan(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        L.template_positions(spark, [("x", "one", False)], 2)


def brute_viterbi(scores, switch):
    k, n = scores.shape[1], len(scores)
    best, back = scores[0].copy(), []
    for t in range(1, n):
        top = best.argmax()
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(k), top))
        best = np.where(stay, best, best[top] - switch) + scores[t]
    return best.max()


def path_score(scores, labels, switch):
    return scores[np.arange(len(labels)), labels].sum() - switch * (np.diff(labels) != 0).sum()


@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_is_optimal_across_blocks(k):
    rng = np.random.default_rng(k)
    counts = np.array([0, 1, 3, 31, 32, 33, 64, 100, 0, 7])
    scores = rng.normal(size=(counts.sum(), k)) * 2
    labels = G.viterbi(scores, counts, 1.5, block=8)
    for a, n in zip(np.cumsum(counts) - counts, counts):
        if n:
            assert np.isclose(path_score(scores[a:a + n], labels[a:a + n], 1.5), brute_viterbi(scores[a:a + n], 1.5))


def test_languages_and_spans(spark):
    en, de, ru = "the cat and the dog with this", "der hund und die katze mit dem", "это просто русский текст для проверки"
    train = docs(spark, [(i, t, x) for i in range(5) for t, x in ((en, "en"), (de, "de"), (ru, "ru"))] + [(99, None, "fr")])
    model = G.learn(train)
    assert model.languages == ["de", "en", "ru"]
    texts = [(1, f"{en} {en} {de} {de}", None), (2, "текст", "en"), (3, "123 ... !", "en"), (4, None, "en"), (5, "", "de")]
    rows = {r.doc_id: r for r in G.language_spans(docs(spark, texts), model).collect()}
    assert [(s.lang, s.start, s.end) for s in rows[1].spans] == [("en", 0, 14), ("de", 14, 28)]
    assert rows[2].lang_pred == "ru" and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5))
    whole = G.language_spans(docs(spark), model)
    assert whole.count() == len(TEXTS) and len(set(whole.columns)) == len(whole.columns)


def test_languages_without_training_rows(spark):
    model = G.learn(docs(spark, [(1, "text", None)]))
    assert {r.lang_pred for r in G.language_spans(docs(spark), model).collect()} == {"und"}
    assert G.language_spans(docs(spark, []), model).count() == 0


def test_held_out_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = G.op6_language_spans(spark, "/root/testdata/sf0.001").join(d.select("doc_id", "lang"), "doc_id").filter(
        "held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows) > 0


def brute_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, 2, -1, 2 ** 63 - 1, -2 ** 63, 10 ** 12, 12345, None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 40, 300):
        rows = df.select("k", H.jump(F.col("k"), n, n + 1).alias("j")).collect()
        assert all((r.j.shard, r.j.grown) == (brute_jump(r.k or 0, n), brute_jump(r.k or 0, n + 1)) for r in rows)


def test_slots_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark):
    texts = TEXTS + [(i, f"text {i}", "en") for i in range(100, 600)] + [(7, "one two", "en")] * 50
    rows = H.jump_shards(docs(spark, texts)).collect()
    assert by_rows((r.doc_id, r.size, r.text_crc32) for r in rows) == by_rows(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 40) for r in rows)
    assert H.jump_shards(docs(spark, [])).count() == 0
