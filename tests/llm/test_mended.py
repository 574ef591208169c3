"""Scripts, caps and long runs: quoted texts, many languages, rules and templates of any number and length."""

import random

import numpy as np
import pytest
from cases import TEXTS, docs, plain
from pyspark.sql import functions as F

from jobsift.llm import language_spans as G
from jobsift.llm import license_scan as L
from jobsift.llm import packed_ids as K
from jobsift.llm import quality_rules as Q

FR, AR = "le chat dort dans la rue avec les autres chats", "القط ينام في الشارع مع القطط الأخرى"


def spans(spark, model, text):
    row = G.language_spans(docs(spark, [(1, text, None)]), model).first()
    return [(s.lang, s.start, s.end) for s in row.spans], row.lang_pred


@pytest.mark.parametrize("text", [
    "«le chat» «dort» «dans» «la rue»", "¿le chat dort dans la rue?", "“le” … chat—dort ‘dans’ la　rue。",
    "le chat dort dans la rue"])
def test_punctuation_of_every_script_parts_words(spark, text):
    model = G.learn(docs(spark, [(i, t, x) for i in range(5) for t, x in ((FR, "fr"), (AR, "ar"))]))
    assert spans(spark, model, text) == ([("fr", 0, 6)], "fr")


def test_scripts_narrow_quoted_mixed_text(spark):
    model = G.learn(docs(spark, [(i, t, x) for i in range(5) for t, x in ((FR, "fr"), (AR, "ar"))]))
    got, _ = spans(spark, model, f"«{FR}» … «{AR}»!")
    assert [s[0] for s in got] == ["fr", "ar"] and got[1][1] == len(FR.split())
    assert G.SCRIPT_OF[ord("a")] != G.SCRIPT_OF[0xC0] == G.NAMES.index("unlisted")


def test_more_languages_than_a_byte_counts(spark):
    rng = random.Random(3)
    words = {f"l{n:03d}": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for n in range(300)}
    model = G.learn(docs(spark, [(n, f"{w} {w}", x) for n, (x, w) in enumerate(words.items())]))
    assert len(model.languages) == 300 and model.features * 300 <= G.ENTRIES
    asked = [(n, f"{w} {w} {w}", x) for n, (x, w) in enumerate(words.items()) if n % 7 == 0]
    rows = G.language_spans(docs(spark, asked), model).collect()
    assert all(r.lang_pred == r.lang for r in rows)


def test_viterbi_along_texts_equals_viterbi_over_blocks():
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 3, 40, 0, 77, 5])
    scores = rng.normal(size=(counts.sum(), 6)) * 3
    assert (G._along(scores, counts, 2.0) == G.viterbi(scores, counts, 2.0, block=8)).all()
    assert len(G.viterbi(np.zeros((0, 40)), np.array([0, 0]))) == 0


def test_white_space_runs_of_millions_are_packed(spark):
    texts = [(1, " " * 2_000_000 + "word", "en"), (2, "a" + "\n" * 1_000_000, "en"), (3, "x \t" * 30_000 + " " * 40_000, "en")]
    packed = K.pack_ids(docs(spark, texts))
    assert dict(map(tuple, K.decoded(packed).collect())) == {i: t for i, t, _ in texts}


def test_runs_cut_out_keep_the_ids(monkeypatch):
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=K.PATTERN, mergeable_ranks=K.read_vocabulary(K.VOCABULARY), special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", ".", "7", " ", "  ", "\n", "\t", " ", " \n "]) * rng.randint(1, 4) for _ in range(60))
             for _ in range(300)]
    want = [encoding.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(K, "RUN", 2)
    monkeypatch.setattr(K, "_LONG_RUN", K.re.compile(K.SPACES + "{2,}"))
    assert [K.encode(encoding, t) for t in texts] == want


def test_repeated_ids_are_not_decoded_into_one(spark):
    packed = K.pack_ids(docs(spark, [(1, "one", "en"), (1, "two", "en")]))
    with pytest.raises(Exception, match="same id"):
        K.decoded(packed).collect()


def test_as_many_rules_as_there_are_defects(spark):
    """Fourteen kinds of bad rows, each told by an own narrow range."""
    kinds, rows = 14, []
    for i in range(9000):
        kind = i % (2 * kinds)
        bad = kind % 2 == 0
        rows.append((i, 100 + 10 * kind, 0 if bad else 1))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, quality int")
    for c in ("word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct", "n_capitals", "n_marks", "n_digits"):
        stats = stats.withColumn(c, F.lit(1).cast("long"))
    rules = Q.learn(stats.select("*"))
    judged = Q.judged(stats, rules)
    assert len(rules) > 12
    assert judged.filter((F.col("quality") == 0) & F.col("rule").isNull()).count() < 400
    assert judged.filter((F.col("quality") == 1) & F.col("rule").isNotNull()).count() == 0


def brute_license(text, templates, k=L.GRAM, drift=L.DRIFT):
    """Labels and best score by the contract of ``license_scan``, word by word."""
    words, labels, best = plain(text), set(), 0.0
    for label, t, base in templates:
        raw = t.split()
        want, must = plain(t), {i for i, w in enumerate(raw) if w != w.lower()}
        n = L.run_length(len(want), k)
        by = {}
        for a in range(len(words) - n + 1):
            for b in range(len(want) - n + 1):
                if words[a:a + n] == want[b:b + n]:
                    by.setdefault(a - b, set()).update(range(b, b + n))
        spans_, last = [], None
        for d in sorted(by):
            if base or last is None or d - last > drift:
                spans_.append(set())
            spans_[-1] |= by[d]
            last = d
        for c in spans_:
            best = max(best, len(c) / len(want))
            lacking = len(want) - len(c)
            if lacking == 0 if base else lacking <= max(1, int(0.1 * len(want) + 1e-9)) and must <= c:
                labels.add(label)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_equal_brute_force(spark):
    notices = dict((x, t.lower()) for x, t in L.NOTICES if len(t.split()) < L.LONG)
    whole = {x: t for x, t in L.NOTICES if len(t.split()) >= L.LONG}
    mit = whole["mit"].split()
    rng = random.Random(2)
    texts = [t for _, t, _ in TEXTS if t and len(t) < 3000]
    texts += ["Released under the MIT license.", "released under the apache license", "licensed under cc by nd 4.0",
              "Licensed under CC BY SA 3 0", "licensed under the gnu general public license version 2",
              "distributed under the gnu general public license version 3", " ".join(mit), " ".join(mit[:60] + ["changed"] + mit[61:]),
              " ".join(mit[:40]), " ".join(mit[:80] + ["put", "in"] + mit[80:]), "x " + notices["bsd"].replace("binary", "object") + " y"]
    for t in notices.values():
        w = t.split()
        w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    templates = [(x, t, True) for x, t in L.PHRASES] + [(x, t, False) for x, t in L.NOTICES]
    rows = {r.doc_id: r for r in L.license_scan(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_license(t, templates)
        assert rows[i].labels == labels, t
        assert rows[i].score == pytest.approx(score)
    found = [r.labels for r in rows.values()]
    assert "mit" in found and any("cc-by-nd" in x and "cc-by-nc" not in x for x in found)


def test_a_template_of_thousands_of_words(spark):
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(4000))
    texts = [(1, "lead " + long + " tail", "en"), (2, long[:8000], "en"), (3, long.replace("w7919 ", "x ", 1), "en")]
    rows = {r.doc_id: r for r in L.license_scan(docs(spark, texts), [("big", long)]).collect()}
    assert rows[1].labels == "big" and rows[1].score == 1 and (rows[1].spans[0].start, rows[1].spans[0].end) == (1, 4001)
    assert rows[2].labels == "" and 0.2 < rows[2].score < 0.6 and rows[3].labels == "big"
