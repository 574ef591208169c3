"""Hand-made cases: the reference's inline examples and one case per quirk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.functions import codes, resume, text, titles
from jobsift.operators import cleaning, encoders, sequences, tfidf, titles as title_ops
from jobsift.plans import evaluate as ev


def test_clean_title_examples(spark):
    rows = [("Менеджер (удаленно) / Manager",), ("  Java  developer \\ Backend",), ("(только) ",),
            ("Повар/Кондитер/Пекарь",), ("Водитель (кат. B) (вахта)",)]
    df = spark.createDataFrame(rows, "t string")
    out = [r[0] for r in df.select(titles.clean_title("t")).collect()]
    assert out == ["Менеджер", "Java developer", None, "Повар", "Водитель"]
    par = df.select(F.array_join(titles.parentheses("t"), "|")).collect()
    assert par[4][0] == "кат. B|вахта"


def test_capitalize_and_strip(spark):
    df = spark.createDataFrame([("\tпРОДАЖИ и маркетинг ",)], "t string")
    r = df.select(text.capitalize(text.strip("t"))).first()[0]
    assert r == "Продажи и маркетинг"


def test_skill_list_normalise_empty_is_null(spark):
    df = spark.createDataFrame([("[]",), ("['python', ' SQL' , ]",), (None,)], "t string")
    out = [r[0] for r in df.select(resume.normalise_skill_list("t")).collect()]
    assert out == [None, ["Python", " sql"], None]  # strip() then strip("'") keeps the inner space


def test_experience_months_and_codes(spark):
    df = spark.createDataFrame([("Опыт работы 16 лет 10 месяцев",), ("Опыт работы 2 года",),
                                ("Опыт работы 3 года и 2 месяца",)], "t string")
    months = [r[0] for r in df.select(resume.experience_months("t")).collect()]
    assert months == [16 * 12 + 10, 24, None]
    cats = [r[0] for r in df.select(codes.experience_from_months(resume.experience_months("t"))).collect()]
    assert cats == ["moreThan6", "between1And3", None]


def test_experience_block_takes_second(spark):
    t = "Опыт работы 5 лет 1 месяц Компания Опыт работы 2 года Другая"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(resume.experience_block("t")).first()[0] == "Опыт работы 2 года Другая"


def test_drop_durations(spark):
    df = spark.createDataFrame([("Инженер 3 года 5 месяцев в компании",)], "t string")
    assert df.select(resume.drop_durations("t")).first()[0] == "Инженер   в компании"


def test_currency_filters_null_semantics(spark):
    df = spark.createDataFrame([("RUR",), ("USD",), (None,)], "compensation_currencyCode string")
    assert cleaning.keep_currency(df).count() == 1
    assert cleaning.drop_currency(df).count() == 2  # Q32: null counts as foreign


def test_minmax_constant_group_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, x double")
    out = sorted(tuple(r) for r in df.select("g", encoders.minmax_over("x", ["g"]).alias("s")).collect())
    assert out == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]


def test_name_swap_fact(spark):
    df = spark.createDataFrame([(1, "m / a / b"), (2, "a / b"), (3, "a / b"), (4, "a / b"), (5, "a / b"),
                                (6, "b / a")], "id int, t string")
    out = {r["id"]: (r["clean_name"], r["slash_names"]) for r in
           title_ops.promote_popular_parts(df, "id", "t").collect()}
    # counts: m 1, a 6, b 6 -> head m swaps with a (1 < 6), a vs b ties, no swap
    assert out[1] == ("a", ["m", "b"])


def _sk_tfidf(docs):
    """Reference TF-IDF (smooth idf, l2) in numpy for brute-force checks."""
    import re
    toks = [re.findall(r"(?u)\b\w\w+\b", d.lower()) for d in docs]
    vocab = sorted({t for ts in toks for t in ts})
    n = len(docs)
    df = np.array([sum(1 for ts in toks if v in ts) for v in vocab])
    idf = np.log((1 + n) / (1 + df)) + 1
    m = np.array([[ts.count(v) for v in vocab] for ts in toks], dtype=float) * idf
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def test_pair_cosine_matches_brute_force(spark):
    pairs = [(1, "python sql", "sql java"), (2, "ab cd", "ef gh"), (3, "python python sql", "python sql"),
             (4, "x", "y")]
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    got = {r["k"]: r["cos"] for r in tfidf.pair_cosine(df, "a", "b", ["k"]).collect()}
    for k, a, b in pairs[:3]:
        m = _sk_tfidf([a, b])
        assert got[k] == pytest.approx(float(m[0] @ m[1]), abs=1e-12)
    assert got[4] is None  # no token of two letters: empty vocabulary


def test_top_k_matches_brute_force_with_padding(spark):
    docs = ["python sql", "sql java", "java scala", "cooking", "python", "baking bread", "sql"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "vacancy_id long, text string")
    q = spark.createDataFrame([(100, "python sql"), (101, "unknownword")], "query_id long, text string")
    out = tfidf.tfidf_top_k(q, df, 4).collect()
    m = _sk_tfidf(docs)
    # query vectors in the corpus vocabulary
    import re
    vocab = sorted({t for d in docs for t in re.findall(r"(?u)\b\w\w+\b", d.lower())})
    n = len(docs)
    dfc = np.array([sum(1 for d in docs if v in re.findall(r"(?u)\b\w\w+\b", d.lower())) for v in vocab])
    idf = np.log((1 + n) / (1 + dfc)) + 1
    qv = np.array([1.0 if v in ("python", "sql") else 0.0 for v in vocab]) * idf
    qv /= np.linalg.norm(qv)
    sims = m @ qv
    expect = sorted(range(n), key=lambda i: (-round(sims[i], 9), i))[:4]
    got = [r["vacancy_id"] for r in sorted((r for r in out if r["query_id"] == 100), key=lambda r: r["rank"])]
    assert got == expect
    pad = [r["vacancy_id"] for r in sorted((r for r in out if r["query_id"] == 101), key=lambda r: r["rank"])]
    assert pad == [0, 1, 2, 3]  # no overlap: zero scores in id order


def test_explode_parallel_rejects_unequal(spark):
    df = spark.createDataFrame([(1, [1, 2], [1])], "k int, a array<int>, b array<int>")
    with pytest.raises(Exception):
        sequences.explode_parallel(df, "a", "b", ["k"]).collect()


def test_salary_and_experience_similarity(spark):
    df = spark.createDataFrame([(0.0, 0.0, "noExperience", "moreThan6"), (100.0, 40.0, "between1And3", "x"),
                                (100.0, 80.0, None, None)], "a double, b double, ea string, eb string")
    r = df.select(ev.salary_similarity("a", "b"), ev.experience_similarity("ea", "eb")).collect()
    assert r[0][0] == 1.0 and r[0][1] == 0.0  # Q30, distance 3
    assert r[1][0] == 0.0 and r[1][1] == 0.0  # gap > half; Q25 unknown
    assert r[2][0] == pytest.approx(0.6)


def test_label_encoding_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "x string")
    out = sorted(tuple(r) for r in encoders.label_encode(df, "x").collect())
    assert out == [("a", 0), ("a", 0), ("b", 1), ("c", 2)]


def test_impute_row_mean(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],)], "a array<double>")
    assert df.select(sequences.impute_row_mean("a")).first()[0] == [1.0, 2.0, 3.0]


def test_split_jobs_hand_made(spark):
    t = ("Опыт работы 5 лет 2 месяца Январь 2015 — Март 2018 Повар 3 года 2 месяца кафе "
         "Апрель 2018 — по настоящее время Шеф-повар ресторан")
    df = spark.createDataFrame([(t,), ("без периодов",)], "t string")
    out = [r[0] for r in df.select(resume.split_jobs("t")).collect()]
    assert out[0] == ["Повар   кафе", "Шеф-повар ресторан"]
    assert out[1] is None


@pytest.mark.parametrize("largest,exclude_self", [(True, False), (False, True)])
def test_cell_top_k_chunked_matches_brute_force(largest, exclude_self):
    import pandas as pd
    from jobsift.operators.vectors import _cell_top_k
    rng = np.random.default_rng(7)
    m = np.round(rng.normal(size=(23, 4)), 1)  # rounding creates ties
    ids = np.arange(100, 123)
    pdf = pd.concat([pd.DataFrame({"__id": ids, "__v": list(m), "__role": 0}),
                     pd.DataFrame({"__id": ids, "__v": list(m), "__role": 1})])
    out = _cell_top_k(4, largest, exclude_self, q_chunk=3, c_chunk=5)(pdf)
    s = m @ m.T
    for qi, q in enumerate(ids):
        cand = [j for j in range(len(ids)) if not (exclude_self and j == qi)]
        sign = -1 if largest else 1
        expect = sorted(cand, key=lambda j: (sign * round(s[qi, j], 9), ids[j]))[:4]
        got = out[out["qid"] == q].reset_index(drop=True)
        assert list(got["cid"]) == [int(ids[j]) for j in expect]


def test_pair_rate_quirks(spark):
    """Q1: 'distance' counts 1 - sim > t, 'match' counts sim > t; unknown
    vacancies count 0; Q26: a token-less text makes the user's rate null."""
    feats = spark.createDataFrame(
        [(1, 10, True, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),     # sim 0 -> distant
         (1, 11, True, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),     # sim 1 -> match
         (1, 12, False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),    # unknown vacancy
         (2, 10, True, None, 1.0, 1.0, 1.0, 1.0, 1.0)],   # no tokens -> null
        "a long, b long, found boolean, sim_skills double, sim_name double, sim_experience double, "
        "sim_salary double, sim_employment double, sim_schedule double")
    pairs = spark.createDataFrame([(7, 1, 10), (7, 1, 11), (7, 1, 12), (8, 2, 10)], "user_id long, a long, b long")
    dist = {r["user_id"]: r["rate"] for r in ev.pair_rate(pairs, feats, 0.72).collect()}
    match = {r["user_id"]: r["rate"] for r in ev.pair_rate(pairs, feats, 0.72, direction="match").collect()}
    assert dist[7] == pytest.approx(1 / 3) and match[7] == pytest.approx(1 / 3)
    assert dist[8] is None and match[8] is None


def test_every_character_reference_is_decoded_once(spark):
    rows = [("<p>&copy; 2024 &middot; A&amp;B</p>", "© 2024 · A&B"), ("&#39;x&#x41;&#8364;", "'xA€"),
            ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("&nosuch; a & b &lt", "&nosuch; a & b &lt"), ("&#0;&#xD800;", "\ufffd\ufffd"),
            ("&NotEqualTilde;", "\u2242\u0338"), ("a&nbsp;b", "a b"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "html string, want string")
    assert [r[0] for r in df.select(text.html_to_text("html")).collect()] == [w for _, w in rows]


def test_dictionary_entries_of_several_words(spark):
    from jobsift.operators import phrases
    docs = spark.createDataFrame([(1, "Живу в Нижний Новгород, рядом Санкт-Петербург"), (2, "Санкт-Петербург и Москва"),
                                  (3, "Новгород"), (4, "нет"), (5, None)], "id int, t string")
    cities = spark.createDataFrame([("Нижний Новгород",), ("Новгород",), ("Санкт-Петербург",), ("Москва",)], "c string")
    got = {r.id: r.match for r in phrases.first_match(docs, ["id"], "t", cities, "c").collect()}
    assert got == {1: "Нижний Новгород", 2: "Санкт-Петербург", 3: "Новгород"}


def test_long_phrases_and_stop_words(spark):
    from jobsift.operators import phrases
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "skill of data and science")], "id int, t string")
    vocab = spark.createDataFrame([("two three four five six",), ("two three",), ("five",), ("data science",)], "p string")
    found = {r.id: r.phrases for r in phrases.extract_phrases(docs, ["id"], "t", vocab, "p").collect()}
    assert found == {1: ["two three four five six"]}
    grams = phrases.extract_ngrams(docs, ["id"], "t", vocab, "p", stop_words=["OF", "and"]).filter("id = 2")
    assert [r.gram for r in grams.collect()] == ["data science"]


def test_region_tree_of_any_depth(spark):
    from jobsift.operators import trees
    tree = ('{"id": 0, "name": "World", "areas": [{"id": 1, "name": "A", "areas": []}, {"id": 2, "name": "B", "areas": '
            '[{"id": 3, "name": "C", "areas": [{"id": 4, "name": "D", "areas": [{"id": 6, "name": "A"}]}]}, {"id": 5, "name": "E"}]}]}')
    docs = spark.createDataFrame([(tree,)], "j string")
    leaves = trees.tree_leaves(docs, "j")
    assert {(r.leaf_id, r.name) for r in leaves.collect()} == {(1, "A"), (6, "A"), (5, "E")}
    assert {r.name: r.leaf_id for r in trees.ids_by_name(leaves).collect()} == {"A": 6, "E": 5}
    assert [tuple(r) for r in trees.tree_roots(docs, "j").collect()] == [(0, "World")]


def test_history_similarity_counts_rows(spark):
    from jobsift.operators import vectors
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vacancy_id int, vec array<double>")
    h = spark.createDataFrame([(7, 1), (7, 1), (7, 2), (8, 3)], "user_id int, vacancy_id int")
    c = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 1)], "user_id int, vacancy_id int")
    got = {(r.user_id, r.vacancy_id): r.mean_sim for r in vectors.mean_similarity_to_history(c, h, v).collect()}
    assert got == {(7, 1): 0.5, (7, 2): 0.0, (8, 3): 0.0, (9, 1): 0.0}


def test_resume_without_headers_or_with_several(spark):
    rows = [("Опыт работы 3 года", "Опыт работы 3 года", 36), ("без опыта", None, None), (None, None, None), ("", None, None),
            ("Опыт работы 1 год Опыт работы 2 года Опыт работы 3 года", "Опыт работы 2 года", 24),
            ("Опыт работы есть", None, None), ("Опыт работы лет 5", "Опыт работы лет 5", None)]
    df = spark.createDataFrame(rows, "t string, b string, m long")
    block = resume.experience_block("t")
    assert [tuple(r) for r in df.select(block, resume.experience_months(block)).collect()] == [(b, m) for _, b, m in rows]


def test_periods_with_touching_dashes(spark):
    t = "Май 2010—Июнь 2011 Кузнец Июль 2012 - настоящее время Пекарь 2 года Январь 2020"
    df = spark.createDataFrame([(t,)], "t string")
    assert df.select(resume.split_jobs("t")).first()[0] == ["Кузнец", "Пекарь  Январь 2020"]


def test_digest_ranks_are_dense(spark):
    from jobsift.plans import training
    from pyspark.sql import functions as F
    df = spark.range(500).select(F.col("id").alias("cand_id"), F.md5(F.col("id").cast("string")).alias("o"))
    rows = training.ranked(df, "o", "cand_id", digits=1).collect()
    want = sorted((r.o, r.cand_id) for r in rows)
    assert [(r.o, r.cand_id) for r in sorted(rows, key=lambda r: r["__rank"])] == want
    assert sorted(r["__rank"] for r in rows) == list(range(1, 501))


def test_grouped_median_equals_numpy(spark):
    import numpy as np
    from jobsift.operators import aggregates
    rng = np.random.default_rng(4)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 30000)) for x in np.round(rng.normal(size=n), 3)]
    df = spark.createDataFrame(rows + [("a", None), ("e", None)], "g string, x double")
    got = {r.g: r.median for r in aggregates.grouped_median(df, ["g"], "x").collect()}
    assert got == {g: float(np.median([x for h, x in rows if h == g])) for g in "abcd"}
    assert aggregates.grouped_median(df, [], "x").first()[0] == float(np.median([x for _, x in rows]))


def test_one_text_on_many_ids_and_one_token_everywhere(spark):
    """50,000 ids share one text and every text has one token in common: ranks
    stay right, and the common token's pairs are split into bounded tasks."""
    from jobsift.operators import tfidf
    from pyspark.sql import functions as F
    many = spark.range(50000).select(F.col("id").alias("vacancy_id"), F.lit("common text here").alias("text"))
    rest = spark.range(50000, 50300).select(F.col("id").alias("vacancy_id"), F.concat(
        F.lit("common word"), F.col("id").cast("string")).alias("text"))
    queries = spark.createDataFrame([(1, "common text here"), (2, "common word50007"), (3, "nothing")], "query_id long, text string")
    got = {}
    for r in tfidf.tfidf_top_k(queries, many.unionByName(rest), 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vacancy_id))
    assert sorted(got[1]) == [(1, 0), (2, 1), (3, 2)] and min(got[2]) == (1, 50007)
    assert sorted(got[3]) == [(1, 0), (2, 1), (3, 2)]
    one = spark.range(3000).select(F.col("id").alias("i"), F.lit("t").alias("token"), F.lit(0.5).alias("w"))
    pairs = tfidf.cosine_pairs(one.select(F.lit(0).alias("s"), F.col("i").alias("q"), "token", "w"),
                               one.select(F.lit(0).alias("s"), F.col("i").alias("c"), "token", "w"), "q", "c", ["s"],
                               pairs_per_task=100_000)
    assert pairs.count() == 9_000_000 and pairs.agg(F.sum("score")).first()[0] == 0.25 * 9_000_000


def test_json_files_that_hold_one_array(spark, tmp_path):
    from jobsift.sources import io
    (tmp_path / "a.json").write_text('[{"id": 1, "name": "x"},\n {"id": 2, "name": "ы"}]', encoding="utf-8")
    (tmp_path / "b.json").write_text('[]', encoding="utf-8")
    (tmp_path / "c.json").write_text('[{"id": 3}]', encoding="utf-8")
    rows = io.read_json(spark, str(tmp_path), "id BIGINT, name STRING", multiline=True).collect()
    assert sorted((r.id, r.name) for r in rows) == [(1, "x"), (2, "ы"), (3, None)]


def test_upsert_is_written_back(spark, tmp_path):
    from jobsift.sources import io
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    after = io.upsert_table(spark, path, new, ["k"])
    assert sorted(map(tuple, spark.read.parquet(after).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b")]
