"""Text similarity: TF-IDF top-k (K2, N4, N7, R7) and pair cosine (K3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.operators import tfidf
from jobsift.sources import fixtures as fx


def r6(c):
    return F.round(c, 6)


TOK_SQL = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def tok(t: str) -> str:
    return TOK_SQL.format(t=t)


def topk_sql(docs_sql: str, queries_sql: str, k: int, exclude_self: bool = False) -> dict[str, str]:
    """DuckDB CTEs for a scoped TF-IDF top-k.  ``docs_sql`` yields
    (scope, cid, text) and ``queries_sql`` (scope, qid, text); result CTE
    ``topk`` has (scope, qid, cid, score, rank)."""
    pad_n = k + (1 if exclude_self else 0)
    self_cond = "AND q.qid <> c.cid" if exclude_self else ""
    return {
        "docs": docs_sql,
        "qs": queries_sql,
        "nd": "SELECT scope, count(*) AS n FROM docs GROUP BY scope",
        "dtok": f"SELECT scope, cid, unnest({tok('text')}) AS token FROM docs",
        "dfq": "SELECT scope, token, count(DISTINCT cid) AS df FROM dtok GROUP BY scope, token",
        "idf": "SELECT scope, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfq JOIN nd USING (scope)",
        "cw0": """SELECT scope, cid, token, count(*) * any_value(idf) AS w
                  FROM dtok JOIN idf USING (scope, token) GROUP BY scope, cid, token""",
        "cw": "SELECT scope, cid, token, w / sqrt(sum(w * w) OVER (PARTITION BY scope, cid)) AS w FROM cw0",
        "qtok": f"SELECT scope, qid, unnest({tok('text')}) AS token FROM qs WHERE text IS NOT NULL",
        "qw0": """SELECT scope, qid, token, count(*) * any_value(idf) AS w
                  FROM qtok JOIN idf USING (scope, token) GROUP BY scope, qid, token""",
        "qw": "SELECT scope, qid, token, w / sqrt(sum(w * w) OVER (PARTITION BY scope, qid)) AS w FROM qw0",
        "sc": f"""SELECT q.scope, q.qid, c.cid, sum(q.w * c.w) AS score FROM qw q JOIN cw c
                  ON c.scope = q.scope AND c.token = q.token WHERE TRUE {self_cond} GROUP BY q.scope, q.qid, c.cid""",
        "padids": f"""SELECT scope, cid FROM (SELECT scope, cid, row_number() OVER (PARTITION BY scope ORDER BY cid) AS r
                      FROM docs) WHERE r <= {pad_n}""",
        "allc": f"""SELECT scope, qid, cid, score FROM sc UNION ALL
                    SELECT q.scope, q.qid, c.cid, 0.0 FROM qs q JOIN padids c ON c.scope = q.scope
                    WHERE TRUE {self_cond} AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.scope = q.scope AND sc.qid = q.qid AND sc.cid = c.cid)""",
        "topk": f"""SELECT * FROM (SELECT scope, qid, cid, score, row_number() OVER (PARTITION BY scope, qid
                    ORDER BY round(score, 9) DESC, cid) AS rank FROM allc) WHERE rank <= {k}""",
    }


_SKILL_DOCS = "SELECT area_id AS scope, vacancy_id AS cid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL"
_SKILL_QS = "SELECT area_id AS scope, vacancy_id AS qid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL"


@register("k2_skill_neighbours", W("""SELECT qid AS query_id, cid AS vacancy_id, round(score, 6) AS score,
  CAST(rank AS BIGINT) AS rank FROM topk""", "vacancy", extra=topk_sql(_SKILL_DOCS, _SKILL_QS, 10)))
def k2_skill_neighbours(spark, d):
    """Minimum slice: top 10 skill-string neighbours inside the same area."""
    v = fx.vacancy(spark, d).filter(F.col("keySkills_str").isNotNull())
    docs = v.select("area_id", "vacancy_id", F.col("keySkills_str").alias("text"))
    out = tfidf.tfidf_top_k(None, docs, 10, scope=["area_id"])
    return out.select("query_id", "vacancy_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


_TITLE_DOCS = "SELECT 0 AS scope, vacancy_id AS cid, name_raw AS text FROM vacancy WHERE keySkills_str IS NOT NULL"
_TITLE_QS = "SELECT 0 AS scope, vacancy_id AS qid, name_raw AS text FROM vacancy WHERE keySkills_str IS NULL"


@register("n7_fill_missing_skills", W("""SELECT t.qid AS vacancy_id, t.cid AS source_id, v.keySkills_str
FROM topk t JOIN vacancy v ON v.vacancy_id = t.cid""", "vacancy", extra=topk_sql(_TITLE_DOCS, _TITLE_QS, 1)))
def n7_fill_missing_skills(spark, d):
    """Rows without skills borrow the skills of the nearest title (k=1)
    among rows with skills."""
    v = fx.vacancy(spark, d)
    have = v.filter(F.col("keySkills_str").isNotNull()).select("vacancy_id", F.col("name_raw").alias("text"))
    need = v.filter(F.col("keySkills_str").isNull()).select(F.col("vacancy_id").alias("query_id"),
                                                             F.col("name_raw").alias("text"))
    best = tfidf.tfidf_top_k(need, have, 1)
    return best.join(v.select(F.col("vacancy_id").alias("source_id"), "keySkills_str"),
                     best["vacancy_id"] == F.col("source_id")) \
        .select(F.col("query_id").alias("vacancy_id"), "source_id", "keySkills_str")


_PAIRS_SQL = {
    "pairs": """SELECT DISTINCT a, b FROM (SELECT vacancy_id AS a,
       lead(vacancy_id) OVER (PARTITION BY user_id, session_id ORDER BY action_dt, event_id) AS b FROM interaction)
     WHERE b IS NOT NULL AND a <> b""",
    "pt": """SELECT p.a, p.b, va.keySkills_str AS ta, vb.keySkills_str AS tb FROM pairs p
     JOIN vacancy va ON va.vacancy_id = p.a JOIN vacancy vb ON vb.vacancy_id = p.b
     WHERE va.keySkills_str IS NOT NULL AND vb.keySkills_str IS NOT NULL""",
    "ca": f"SELECT a, b, token, count(*) AS ta FROM (SELECT a, b, unnest({tok('ta')}) AS token FROM pt) GROUP BY a, b, token",
    "cb": f"SELECT a, b, token, count(*) AS tb FROM (SELECT a, b, unnest({tok('tb')}) AS token FROM pt) GROUP BY a, b, token",
    "jj": """SELECT coalesce(ca.a, cb.a) AS a, coalesce(ca.b, cb.b) AS b, ca.ta, cb.tb
     FROM ca FULL OUTER JOIN cb ON ca.a = cb.a AND ca.b = cb.b AND ca.token = cb.token""",
    "agg": """SELECT a, b, sum(CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN ta * tb END) AS dot,
       sum(pow(coalesce(ta, 0) * CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN 1.0 ELSE 1 + ln(1.5) END, 2)) AS na,
       sum(pow(coalesce(tb, 0) * CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN 1.0 ELSE 1 + ln(1.5) END, 2)) AS nb
     FROM jj GROUP BY a, b""",
}


def session_pairs(spark, d):
    """Distinct (a, b) pairs of consecutive different items within a session."""
    i = fx.interaction(spark, d)
    w = Window.partitionBy("user_id", "session_id").orderBy("action_dt", "event_id")
    return (i.select(F.col("vacancy_id").alias("a"), F.lead("vacancy_id").over(w).alias("b"))
            .filter(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())


@register("k3_pair_cosine", W("""SELECT pt.a, pt.b,
  round(CASE WHEN agg.a IS NULL THEN NULL WHEN na > 0 AND nb > 0 THEN coalesce(dot, 0) / sqrt(na * nb) ELSE 0 END, 6) AS cos
FROM pt LEFT JOIN agg ON agg.a = pt.a AND agg.b = pt.b""", "vacancy", "interaction", extra=_PAIRS_SQL))
def k3_pair_cosine(spark, d):
    v = fx.vacancy(spark, d).filter(F.col("keySkills_str").isNotNull()).select("vacancy_id", "keySkills_str")
    p = session_pairs(spark, d)
    pt = (p.join(v.select(F.col("vacancy_id").alias("a"), F.col("keySkills_str").alias("ta")), "a")
          .join(v.select(F.col("vacancy_id").alias("b"), F.col("keySkills_str").alias("tb")), "b"))
    out = tfidf.pair_cosine(pt, "ta", "tb", ["a", "b"])
    return out.select("a", "b", r6("cos").alias("cos"))
