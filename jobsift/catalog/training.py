"""Training-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.catalog.vectors import NV
from jobsift.functions.titles import clean_title
from jobsift.operators import joins
from jobsift.operators import vectors as vx
from jobsift.plans import training as tr
from jobsift.sources import fixtures as fx
from jobsift.sources import io
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


_M2 = {
    "hist": """SELECT user_id, vacancy_id, action_type,
        row_number() OVER (PARTITION BY user_id ORDER BY action_dt, event_id) AS pos FROM interaction WHERE is_train""",
    "pairs": "SELECT DISTINCT user_id, vacancy_id FROM interaction WHERE NOT is_train",
    "firstocc": "SELECT user_id, vacancy_id, min(pos) AS fpos FROM hist GROUP BY user_id, vacancy_id",
    "rem": """SELECT p.user_id, p.vacancy_id AS cand, h.vacancy_id AS hv FROM pairs p JOIN hist h ON h.user_id = p.user_id
        LEFT JOIN firstocc f ON f.user_id = p.user_id AND f.vacancy_id = p.vacancy_id
        WHERE h.action_type <> 2 AND (f.fpos IS NULL OR h.pos <> f.fpos)""",
    "sal": """SELECT r.user_id, r.cand,
        CASE WHEN count(v.compensation_from) > 0 THEN CAST(sum(CAST(v.compensation_from AS DECIMAL(18,2))) AS DOUBLE)
             / count(v.compensation_from) ELSE 0.0 END AS usf,
        CASE WHEN count(v.compensation_to) > 0 THEN CAST(sum(CAST(v.compensation_to AS DECIMAL(18,2))) AS DOUBLE)
             / count(v.compensation_to) ELSE 0.0 END AS ust
        FROM rem r JOIN vacancy v ON v.vacancy_id = r.hv GROUP BY r.user_id, r.cand""",
    "usk": """SELECT DISTINCT r.user_id, r.cand, unnest(v.keySkills) AS skill FROM rem r
        JOIN vacancy v ON v.vacancy_id = r.hv WHERE v.keySkills IS NOT NULL""",
    "csk": """SELECT DISTINCT p.user_id, p.vacancy_id AS cand, unnest(v.keySkills) AS skill FROM pairs p
        JOIN vacancy v ON v.vacancy_id = p.vacancy_id WHERE v.keySkills IS NOT NULL""",
    "com": """SELECT c.user_id, c.cand, count(*) AS common FROM csk c JOIN usk u
        ON u.user_id = c.user_id AND u.cand = c.cand AND u.skill = c.skill GROUP BY c.user_id, c.cand""",
}


@register("m2_m4_ranking_features", W("""SELECT p.user_id, p.vacancy_id,
  round(coalesce(s.usf, 0.0), 6) AS user_salary_from, round(coalesce(s.ust, 0.0), 6) AS user_salary_to,
  round(v.compensation_from, 6) AS vacancy_salary_from, round(v.compensation_to, 6) AS vacancy_salary_to,
  round(CASE WHEN coalesce(c.common, 0) > 0 THEN len(list_distinct(v.keySkills)) / c.common ELSE 0.0 END, 6)
    AS intersection_keyskill,
  round((2 * l.quality + 1 - l.toxic) / 3.0, 6) AS relevance_score,
  CAST(trunc((2 * l.quality + 1 - l.toxic) / 3.0 * 10) AS INTEGER) AS grade
FROM pairs p JOIN vacancy v ON v.vacancy_id = p.vacancy_id
LEFT JOIN sal s ON s.user_id = p.user_id AND s.cand = p.vacancy_id
LEFT JOIN com c ON c.user_id = p.user_id AND c.cand = p.vacancy_id
LEFT JOIN labels l ON l.doc_id = p.vacancy_id""", "vacancy", "interaction", extra=_M2))
def m2_m4_ranking_features(spark, d):
    """M2 ranking features for the test-period (user, vacancy) pairs from the
    train history, with the M4 relevance grade from the labels."""
    i = fx.interaction(spark, d)
    pairs = i.filter(~F.col("is_train")).select("user_id", "vacancy_id").distinct()
    feats = tr.ranking_features(pairs, i.filter("is_train"), fx.vacancy(spark, d))
    lab = table(spark, d, "labels").select(
        F.col("doc_id").alias("vacancy_id"),
        ((2 * F.col("quality") + 1 - F.col("toxic")) / 3.0).alias("relevance_score"))
    out = feats.join(lab, "vacancy_id", "left")
    return out.select("user_id", "vacancy_id",
                      *[r6(c).alias(c) for c in ["user_salary_from", "user_salary_to", "vacancy_salary_from",
                                                 "vacancy_salary_to", "intersection_keyskill", "relevance_score"]],
                      tr.relevance_grade("relevance_score").alias("grade"))


# ------------------------------------------------------------- M7, M8, M10
_M7 = dict(NV)
_M7.update({
    "top": """SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id AS cand_id,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS rank
        FROM nv a, nv b) WHERE rank <= 210""",
    "rk": "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM nv",
    "fl": """SELECT label, min(vec_id) FILTER (WHERE r = 1) AS first_id, min(vec_id) FILTER (WHERE r = 2) AS second_id
        FROM rk GROUP BY label""",
    "pos": """SELECT q.vec_id AS query_id, CASE WHEN q.vec_id = f.first_id THEN f.second_id ELSE f.first_id END AS cand_id
        FROM nv q JOIN fl f ON f.label = q.label""",
    "pool": """SELECT t.query_id, t.cand_id FROM top t WHERE t.rank > 10 AND t.cand_id <> t.query_id
        AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.query_id = t.query_id AND p.cand_id = t.cand_id)""",
    "picked": """SELECT query_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY md5(concat_ws('_', '42', CAST(query_id AS VARCHAR), CAST(cand_id AS VARCHAR))), cand_id) AS r FROM pool)
        WHERE r <= 15""",
    "npick": """SELECT q.vec_id AS query_id, count(p.cand_id) AS n FROM nv q LEFT JOIN picked p ON p.query_id = q.vec_id
        GROUP BY q.vec_id""",
    "pads": """SELECT vec_id AS cand_id, row_number() OVER (ORDER BY md5(concat_ws('_', '42', CAST(vec_id AS VARCHAR))), vec_id) AS pr
        FROM nv ORDER BY md5(concat_ws('_', '42', CAST(vec_id AS VARCHAR))), vec_id LIMIT 32""",
    "filler": """SELECT query_id, cand_id FROM (SELECT n.query_id, d.cand_id, n.n,
        row_number() OVER (PARTITION BY n.query_id ORDER BY d.pr) AS f FROM npick n, pads d
        WHERE n.n < 15 AND d.cand_id <> n.query_id
        AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.query_id = n.query_id AND p.cand_id = d.cand_id)
        AND NOT EXISTS (SELECT 1 FROM picked k WHERE k.query_id = n.query_id AND k.cand_id = d.cand_id)) WHERE f <= 15 - n""",
    "negs": "SELECT query_id, cand_id, 'mined' AS source FROM picked UNION ALL SELECT query_id, cand_id, 'padded' FROM filler",
})


def _m7_parts(spark, d):
    v = fx.vectors(spark, d)
    top = vx.dense_top_k(v.withColumnRenamed("vacancy_id", "query_id"), v, 210) \
        .withColumnRenamed("vacancy_id", "cand_id")
    first = v.groupBy("label").agg(F.min("vacancy_id").alias("first_id"))
    second = v.join(first, "label").filter(F.col("vacancy_id") > F.col("first_id")) \
        .groupBy("label").agg(F.min("vacancy_id").alias("second_id"))
    pos = v.join(first.join(second, "label", "left"), "label").select(
        F.col("vacancy_id").alias("query_id"),
        F.when(F.col("vacancy_id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
        .alias("cand_id")).filter(F.col("cand_id").isNotNull())
    corpus = v.select(F.col("vacancy_id").alias("cand_id"))
    negs = tr.hard_negatives(top, pos, corpus, queries=corpus.withColumnRenamed("cand_id", "query_id"))
    return pos, negs


@register("m7_hard_negatives", W("SELECT query_id, cand_id, source FROM negs", extra=_M7))
def m7_hard_negatives(spark, d):
    """M7: positives = the lowest other id of the same label; negatives mined
    from search ranks 10..209 (sample of 15, padded when short)."""
    _, negs = _m7_parts(spark, d)
    return negs


@register("m8_candidate_corpus", W("SELECT DISTINCT cand_id FROM (SELECT cand_id FROM pos UNION ALL SELECT cand_id FROM negs)",
                                   extra=_M7))
def m8_candidate_corpus(spark, d):
    pos, negs = _m7_parts(spark, d)
    return pos.select("cand_id").unionByName(negs.select("cand_id")).distinct()


@register("m10_training_groups", W("""SELECT query_id, CAST(slot AS INTEGER) AS slot, cand_id FROM (
  SELECT query_id, 0 AS slot, cand_id FROM pos
  UNION ALL SELECT s.query_id, s.slot, n.cand_id FROM (
    SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id
      ORDER BY md5(concat_ws('_', '42', CAST(query_id AS VARCHAR), CAST(cand_id AS VARCHAR))), cand_id) AS r,
      count(*) OVER (PARTITION BY query_id) AS m FROM negs) n
  JOIN (SELECT DISTINCT query_id, unnest(range(1, 8)) AS slot FROM negs) s
    ON s.query_id = n.query_id AND ((s.slot - 1) % n.m) + 1 = n.r)""", extra=_M7))
def m10_training_groups(spark, d):
    """One positive and seven negatives per query (group size 8)."""
    pos, negs = _m7_parts(spark, d)
    return tr.training_groups(pos, negs.select("query_id", "cand_id"), 8) \
        .select("query_id", F.col("slot").cast("int").alias("slot"), "cand_id")


# ------------------------------------------------------------ M9, M11
_M9 = {
    "docs": """SELECT v.vacancy_id, v.name AS title, d.description,
        regexp_extract(d.description, '^\\s*(\\S+)', 1) AS first_word
        FROM vacancy v JOIN descriptions d ON d.vacancy_id = v.vacancy_id
        WHERE v.name IS NOT NULL AND d.description IS NOT NULL""",
    "kept": """SELECT * FROM docs d WHERE (SELECT count(*) FROM docs x WHERE x.title = d.title
        AND x.first_word = d.first_word) = 1""",
    "grp": "SELECT title, min(vacancy_id) AS query_id FROM kept GROUP BY title HAVING count(*) > 1",
}


@register("m9_same_title_positives", W("""SELECT k.title, k.vacancy_id, CAST(k.vacancy_id = g.query_id AS INTEGER) AS is_query
FROM kept k JOIN grp g ON g.title = k.title""", "vacancy", "descriptions", extra=_M9))
def m9_same_title_positives(spark, d):
    docs = fx.vacancy(spark, d).select("vacancy_id", clean_title("name_raw").alias("title")) \
        .join(fx.descriptions(spark, d), "vacancy_id")
    g = tr.same_title_groups(docs)
    return g.select("title", "vacancy_id", F.col("is_query").cast("int").alias("is_query"))


@register("m11_id_to_text", W("""SELECT k.vacancy_id, CAST(k.vacancy_id = g.query_id AS INTEGER) AS is_query,
  md5(k.description) AS text_md5, CAST(length(k.description) AS BIGINT) AS n_chars
FROM kept k JOIN grp g ON g.title = k.title""", "vacancy", "descriptions", extra=_M9))
def m11_id_to_text(spark, d):
    """Query / positive ids replaced by their texts (digest + length)."""
    docs = fx.vacancy(spark, d).select("vacancy_id", clean_title("name_raw").alias("title")) \
        .join(fx.descriptions(spark, d), "vacancy_id")
    g = tr.same_title_groups(docs).join(fx.descriptions(spark, d), "vacancy_id")
    return g.select("vacancy_id", F.col("is_query").cast("int").alias("is_query"),
                    F.md5("description").alias("text_md5"), F.length("description").cast("bigint").alias("n_chars"))


# -------------------------------------------------------- M12-M14
@register("m12_like_response_singletons", W("""SELECT user_id, session_id, min(vacancy_id) FILTER (WHERE action_type = 3) AS like_id,
  min(vacancy_id) FILTER (WHERE action_type = 1) AS response_id FROM interaction GROUP BY user_id, session_id
HAVING count(DISTINCT vacancy_id) FILTER (WHERE action_type = 3) = 1
   AND count(DISTINCT vacancy_id) FILTER (WHERE action_type = 1) = 1""", "interaction"))
def m12_like_response_singletons(spark, d):
    """Sessions with exactly one distinct favourite and one distinct
    response."""
    i = fx.interaction(spark, d)
    agg = i.groupBy("user_id", "session_id").agg(
        F.count_distinct(F.when(F.col("action_type") == 3, F.col("vacancy_id"))).alias("n_like"),
        F.count_distinct(F.when(F.col("action_type") == 1, F.col("vacancy_id"))).alias("n_resp"),
        F.min(F.when(F.col("action_type") == 3, F.col("vacancy_id"))).alias("like_id"),
        F.min(F.when(F.col("action_type") == 1, F.col("vacancy_id"))).alias("response_id"))
    return agg.filter((F.col("n_like") == 1) & (F.col("n_resp") == 1)).select("user_id", "session_id", "like_id",
                                                                              "response_id")


@register("m12b_like_response_split", W("""SELECT user_id, CAST(count(DISTINCT vacancy_id) FILTER (WHERE action_type = 3) AS BIGINT) AS n_likes,
  CAST(count(DISTINCT vacancy_id) FILTER (WHERE action_type = 1) AS BIGINT) AS n_responses FROM interaction
WHERE NOT is_train GROUP BY user_id
HAVING count(*) FILTER (WHERE action_type = 3) > 0 AND count(*) FILTER (WHERE action_type = 1) > 0""", "interaction"))
def m12b_like_response_split(spark, d):
    """Distinct favourites and responses of users having both (test period)."""
    i = fx.interaction(spark, d).filter(~F.col("is_train"))
    agg = i.groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("action_type") == 3, F.col("vacancy_id"))).alias("n_likes"),
        F.count_distinct(F.when(F.col("action_type") == 1, F.col("vacancy_id"))).alias("n_responses"))
    return agg.filter((F.col("n_likes") > 0) & (F.col("n_responses") > 0))


@register("m13_validation_table", W("""
, fi AS (SELECT user_id, vacancy_id, min(action_dt) AS t, arg_min(event_id, (action_dt, event_id)) AS e
         FROM interaction WHERE action_type IN (1, 3) GROUP BY user_id, vacancy_id),
big AS (SELECT user_id, count(*) AS n FROM fi GROUP BY user_id HAVING count(*) > 10),
pr AS (SELECT fi.user_id, arg_min(vacancy_id, (t, e)) AS probe, any_value(big.n) AS n
       FROM fi JOIN big USING (user_id) GROUP BY fi.user_id)
SELECT pr.user_id, pr.probe AS probe_id, round(v.compensation_from, 6) AS salary, CAST(pr.n - 1 AS BIGINT) AS n_truth
FROM pr JOIN vacancy v ON v.vacancy_id = pr.probe WHERE v.compensation_from IS NOT NULL""", "interaction", "vacancy").replace(
    "\n\n, fi AS", ", fi AS", 1))
def m13_validation_table(spark, d):
    """The W7 probe joined to the catalogue, rows without salary
    dropped, with the size of the truth list."""
    i = fx.interaction(spark, d).filter(F.col("action_type").isin(1, 3))
    pt = joins.probe_and_truth(i, min_distinct=10)
    per_user = pt.groupBy("user_id").agg(F.max(F.when(F.col("is_probe"), F.col("vacancy_id"))).alias("probe_id"),
                                         (F.count("*") - 1).alias("n_truth"))
    v = fx.vacancy(spark, d).select(F.col("vacancy_id").alias("probe_id"), "compensation_from")
    return per_user.join(v, "probe_id").filter(F.col("compensation_from").isNotNull()) \
        .select("user_id", "probe_id", r6("compensation_from").alias("salary"), F.col("n_truth").cast("bigint"))


@register("m13b_train_test_pairs", W("""
, lists AS (SELECT is_train, user_id, session_id, max((action_dt, event_id)) AS ended,
    list_sort(list(DISTINCT vacancy_id) FILTER (WHERE action_type = 3)) AS likes,
    list_sort(list(DISTINCT vacancy_id) FILTER (WHERE action_type = 1)) AS responses
  FROM interaction GROUP BY ALL HAVING count(*) FILTER (WHERE action_type = 3) > 0 AND count(*) FILTER (WHERE action_type = 1) > 0),
last AS (SELECT user_id, arg_max(likes, ended) AS l, arg_max(responses, ended) AS r FROM lists WHERE is_train GROUP BY user_id)
SELECT t.user_id, t.session_id, l[1] AS like_for_predict, r[1] AS response_for_predict,
  array_to_string(t.likes, ',') AS likes_true, array_to_string(t.responses, ',') AS responses_true
FROM last JOIN lists t ON t.user_id = last.user_id AND NOT t.is_train
WHERE len(l) = 1 AND len(r) = 1 AND l[1] IN (SELECT vacancy_id FROM vacancy WHERE compensation_from IS NOT NULL)""",
                                    "interaction", "vacancy").replace("\n\n, lists AS", ", lists AS", 1))
def m13b_train_test_pairs(spark, d):
    """The last train session's lists paired with the test sessions'."""
    i = fx.interaction(spark, d)
    out = tr.train_test_pairs(i.filter("is_train"), i.filter("NOT is_train"), fx.vacancy(spark, d))
    return out.select("user_id", "session_id", "like_for_predict", "response_for_predict",
                      F.array_join("likes_true", ",").alias("likes_true"),
                      F.array_join("responses_true", ",").alias("responses_true"))


_PREFIX_SQL = """CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'query: ' WHEN 1 THEN 'passage: ' ELSE '' END"""


@register("m14_prefix_stratification", f"""SELECT prefix, CAST(count(*) AS BIGINT) AS n_docs,
  CAST(count(DISTINCT source) AS BIGINT) AS n_sources, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars
FROM (SELECT *, {_PREFIX_SQL} AS prefix, row_number() OVER (PARTITION BY source
  ORDER BY md5(concat('42', CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents) WHERE r <= 1000 GROUP BY 1""")
def m14_prefix_stratification(spark, d):
    """Dataset folders and a file that maps them to prefixes, both read
    back; examples (at most 1000 a dataset, S12) grouped by prefix."""
    docs = table(spark, d, "documents")
    path, prefixes = io.scratch_path(spark, "m14"), io.scratch_path(spark, "m14-prefixes")
    docs.select("doc_id", "source", "text").write.partitionBy("source").json(path)
    entry = F.struct(F.col("source"), F.expr(_PREFIX_SQL.replace("INTEGER", "INT")).alias("prefix"))
    docs.select("source").distinct().agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(prefixes)
    rows = io.read_by_prefix(spark, path, prefixes, 1000, "doc_id", "doc_id BIGINT, text STRING")
    return rows.groupBy("prefix").agg(F.count("*").alias("n_docs"), F.count_distinct("name").alias("n_sources"),
                                      F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))


@register("m10b_prefixed_groups", W(f"""SELECT query_id, CAST(slot AS INTEGER) AS slot, cand_id,
  CASE WHEN substr(md5(concat_ws('_', '42', 'q', CAST(query_id AS VARCHAR))), 1, 8) < '80000000' THEN 'query: ' ELSE '' END
    AS query_prefix,
  CASE WHEN substr(md5(concat_ws('_', '42', 'p', CAST(query_id AS VARCHAR), CAST(slot AS VARCHAR))), 1, 8) < '80000000'
    THEN 'passage: ' ELSE '' END AS passage_prefix
FROM (SELECT query_id, 0 AS slot, cand_id FROM pos
  UNION ALL SELECT s.query_id, s.slot, n.cand_id FROM (
    SELECT query_id, cand_id, row_number() OVER (PARTITION BY query_id
      ORDER BY md5(concat_ws('_', '42', CAST(query_id AS VARCHAR), CAST(cand_id AS VARCHAR))), cand_id) AS r,
      count(*) OVER (PARTITION BY query_id) AS m FROM negs) n
  JOIN (SELECT DISTINCT query_id, unnest(range(1, 8)) AS slot FROM negs) s
    ON s.query_id = n.query_id AND ((s.slot - 1) % n.m) + 1 = n.r)""", extra=_M7))
def m10b_prefixed_groups(spark, d):
    """M10 with dataset prefixes ('query: ' / 'passage: ') applied with
    probability 0.5 per text (the "text" strategy)."""
    pos, negs = _m7_parts(spark, d)
    g = tr.training_groups(pos, negs.select("query_id", "cand_id"), 8)
    out = tr.with_prefixes(g, "query: ", "passage: ", 0.5, strategy="text")
    return out.select("query_id", F.col("slot").cast("int").alias("slot"), "cand_id", "query_prefix", "passage_prefix")
