"""Evaluation queries (V1-V11, V15, J8) over a deterministic recommender:
predictions = a user's ten most-acted train items; truth = the items the
user responded to or favourited in the test period."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.catalog.textsim import tok
from jobsift.operators import aggregates, sampling
from jobsift.operators.running import group_ranks
from jobsift.plans import evaluate as ev
from jobsift.session import materialize
from jobsift.sources import fixtures as fx


def r6(c):
    return F.round(c, 6)


def predictions(spark, d, k: int = 10):
    i = fx.interaction(spark, d).filter("is_train")
    cnt = i.groupBy("user_id", "vacancy_id").agg(F.count("*").alias("n"))
    return sampling.top_k_per_group(cnt, ["user_id"], [F.col("n").desc(), F.col("vacancy_id").asc()], k) \
        .select("user_id", "vacancy_id", "rank")


def truth(spark, d, ranked=False):
    """(user_id, vacancy_id), and with ``ranked`` the item's place ``pos`` in the
    user's test period; a user may have any number of items."""
    i = fx.interaction(spark, d).filter(~F.col("is_train") & F.col("action_type").isin(1, 3))
    if not ranked:
        return i.select("user_id", "vacancy_id").distinct()
    first = materialize(i.groupBy("user_id", "vacancy_id").agg(F.min("action_dt").alias("t")))
    return group_ranks(first, ["user_id"], ["t", "vacancy_id"], "pos").select("user_id", "vacancy_id", "pos")


def _k3_ctes(p: str, src: str, ta: str, tb: str) -> dict[str, str]:
    """DuckDB CTEs for the pair cosine of ``src`` (a, b, ta, tb) -> {p}cos(a, b, cos)."""
    other = "1 + ln(1.5)"
    return {
        f"{p}src": f"SELECT a, b, {ta} AS ta, {tb} AS tb FROM {src} WHERE {ta} IS NOT NULL AND {tb} IS NOT NULL",
        f"{p}ca": f"SELECT a, b, token, count(*) AS ta FROM (SELECT a, b, unnest({tok('ta')}) AS token FROM {p}src) GROUP BY a, b, token",
        f"{p}cb": f"SELECT a, b, token, count(*) AS tb FROM (SELECT a, b, unnest({tok('tb')}) AS token FROM {p}src) GROUP BY a, b, token",
        f"{p}jj": f"""SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, x.ta, y.tb
            FROM {p}ca x FULL OUTER JOIN {p}cb y ON x.a = y.a AND x.b = y.b AND x.token = y.token""",
        f"{p}agg": f"""SELECT a, b, sum(CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN ta * tb END) AS dot,
            sum(pow(coalesce(ta, 0) * CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN 1.0 ELSE {other} END, 2)) AS na,
            sum(pow(coalesce(tb, 0) * CASE WHEN ta IS NOT NULL AND tb IS NOT NULL THEN 1.0 ELSE {other} END, 2)) AS nb
            FROM {p}jj GROUP BY a, b""",
        f"{p}cos": f"""SELECT s.a, s.b, CASE WHEN g.a IS NULL THEN NULL WHEN na > 0 AND nb > 0
            THEN coalesce(dot, 0) / sqrt(na * nb) ELSE 0.0 END AS cos
            FROM {p}src s LEFT JOIN {p}agg g ON g.a = s.a AND g.b = s.b""",
    }


_EXP = ("CASE {c} WHEN 'noExperience' THEN 0 WHEN 'between1And3' THEN 1 WHEN 'between3And6' THEN 2 "
        "WHEN 'moreThan6' THEN 3 END")

EVAL_CTES: dict[str, str] = {
    "pred": """SELECT user_id, vacancy_id, rank FROM (SELECT user_id, vacancy_id,
        row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, vacancy_id) AS rank
        FROM interaction WHERE is_train GROUP BY user_id, vacancy_id) WHERE rank <= 10""",
    "truth": """SELECT user_id, vacancy_id, row_number() OVER (PARTITION BY user_id ORDER BY min(action_dt), vacancy_id) AS pos
        FROM interaction WHERE NOT is_train AND action_type IN (1, 3) GROUP BY user_id, vacancy_id""",
    "pairs": """SELECT t.user_id, t.vacancy_id AS a, p.vacancy_id AS b, t.pos AS true_pos, p.rank AS pred_rank
        FROM truth t JOIN pred p ON p.user_id = t.user_id""",
    "pj": """SELECT i.a, i.b, va.vacancy_id IS NOT NULL AND vb.vacancy_id IS NOT NULL AS found,
        vb.vacancy_id IS NOT NULL AS found_b,
        va.keySkills_str AS ks_a, vb.keySkills_str AS ks_b, va.name AS nm_a, vb.name AS nm_b,
        va.workExperience AS we_a, vb.workExperience AS we_b, va.compensation_from AS cf_a, vb.compensation_from AS cf_b,
        va.employment AS em_a, vb.employment AS em_b, va.workSchedule AS ws_a, vb.workSchedule AS ws_b
        FROM (SELECT DISTINCT a, b FROM pairs) i LEFT JOIN vacancy va ON va.vacancy_id = i.a
        LEFT JOIN vacancy vb ON vb.vacancy_id = i.b""",
}
EVAL_CTES.update(_k3_ctes("sk", "pj", "ks_a", "ks_b"))
EVAL_CTES.update(_k3_ctes("nm", "pj", "nm_a", "nm_b"))
EVAL_CTES["feats"] = f"""SELECT pj.a, pj.b, found, found_b,
    CASE WHEN ks_a IS NOT NULL AND ks_b IS NOT NULL THEN skcos.cos ELSE 0.0 END AS sim_skills,
    CASE WHEN nm_a IS NOT NULL AND nm_b IS NOT NULL THEN nmcos.cos ELSE 0.0 END AS sim_name,
    coalesce(1 - abs(({_EXP.format(c='we_a')}) - ({_EXP.format(c='we_b')})) / 3.0, 0.0) AS sim_experience,
    CASE WHEN cf_a IS NULL OR cf_b IS NULL THEN 0.0 WHEN abs(cf_a - cf_b) = 0 THEN 1.0
         WHEN abs(cf_a - cf_b) > 0.5 * greatest(cf_a, cf_b) THEN 0.0
         ELSE 1 - abs(cf_a - cf_b) / (0.5 * greatest(cf_a, cf_b)) END AS sim_salary,
    CASE WHEN em_a IS NOT NULL AND em_b IS NOT NULL AND em_a = em_b THEN 1.0 ELSE 0.0 END::DOUBLE AS sim_employment,
    CASE WHEN ws_a IS NOT NULL AND ws_b IS NOT NULL AND ws_a = ws_b THEN 1.0 ELSE 0.0 END::DOUBLE AS sim_schedule
    FROM pj LEFT JOIN skcos ON skcos.a = pj.a AND skcos.b = pj.b LEFT JOIN nmcos ON nmcos.a = pj.a AND nmcos.b = pj.b"""
EVAL_CTES["fs"] = """SELECT a, b, found, found_b, (sim_skills + sim_name + sim_experience + sim_salary + sim_employment
    + sim_schedule) / 6.0 AS sim,
    0.25 * coalesce(sim_skills, 0) + 0.25 * coalesce(sim_name, 0) + 0.15 * sim_experience + 0.15 * sim_salary
    + 0.1 * sim_employment + 0.1 * sim_schedule AS wsim FROM feats"""


def EW(sql):
    return W(sql, "vacancy", "interaction", extra=EVAL_CTES)


def _feats(spark, d, ranked=False):
    p, t = predictions(spark, d), truth(spark, d, ranked)
    pairs = ev.truth_pred_pairs(p, t)
    feats = ev.pair_features(pairs, fx.vacancy(spark, d))
    return p, t, pairs, feats


@register("v1_v2_precision_recall", EW("""SELECT u.user_id,
  round(coalesce(h.hits, 0) / least(10, u.n_true), 6) AS precision, round(coalesce(h.hits, 0) / u.n_true, 6) AS recall
FROM (SELECT user_id, count(*) AS n_true FROM truth WHERE user_id IN (SELECT user_id FROM pred) GROUP BY user_id) u
LEFT JOIN (SELECT p.user_id, count(*) AS hits FROM pred p JOIN truth t ON t.user_id = p.user_id AND t.vacancy_id = p.vacancy_id
           GROUP BY p.user_id) h ON h.user_id = u.user_id"""))
def v1_v2_precision_recall(spark, d):
    out = ev.precision_recall_at_k(predictions(spark, d), truth(spark, d), 10)
    return out.select("user_id", r6("precision").alias("precision"), r6("recall").alias("recall"))


@register("v3_v6_pair_similarity", EW("""SELECT a, b, CAST(found AS INTEGER) AS found,
  round(sim_skills, 6) AS sim_skills, round(sim_name, 6) AS sim_name, round(sim_experience, 6) AS sim_experience,
  round(sim_salary, 6) AS sim_salary, round(sim_employment, 6) AS sim_employment, round(sim_schedule, 6) AS sim_schedule,
  round(sim, 6) AS mean_sim, round(wsim, 6) AS weighted_sim
FROM feats JOIN fs USING (a, b, found, found_b)"""))
def v3_v6_pair_similarity(spark, d):
    _, _, _, f = _feats(spark, d)
    return f.select("a", "b", F.col("found").cast("int").alias("found"),
                    *[r6(c).alias(c) for c in ev.FEATURES],
                    r6(ev.mean_similarity(f)).alias("mean_sim"), r6(ev.weighted_similarity()).alias("weighted_sim"))


@register("v7_pair_rate", EW("""SELECT p.user_id,
  round(CASE WHEN sum(CASE WHEN found AND sim IS NULL THEN 1 ELSE 0 END) > 0 THEN NULL
        ELSE avg(CASE WHEN found AND 1 - sim > 0.72 THEN 1.0 ELSE 0.0 END) END, 6) AS rate
FROM pairs p JOIN fs USING (a, b) GROUP BY p.user_id"""))
def v7_pair_rate(spark, d):
    _, _, pairs, f = _feats(spark, d)
    return ev.pair_rate(pairs, f, 0.72).select("user_id", r6("rate").alias("rate"))


@register("v8_similarity_mrr", EW("""SELECT user_id, round(avg(coalesce(1.0 / first_pos, 0.0)), 6) AS mrr FROM (
  SELECT p.user_id, p.b, min(CASE WHEN found AND sim > 0.75 THEN true_pos END) AS first_pos
  FROM pairs p JOIN fs USING (a, b) WHERE found_b GROUP BY p.user_id, p.b) GROUP BY user_id"""))
def v8_similarity_mrr(spark, d):
    _, _, pairs, f = _feats(spark, d, ranked=True)
    return ev.similarity_mrr(pairs, f, 0.75).select("user_id", r6("mrr").alias("mrr"))


@register("a16_metric_mean_median", EW("""SELECT round(avg(rate), 6) AS mean_rate, round(quantile_cont(rate, 0.5), 6) AS median_rate
FROM (SELECT p.user_id, CASE WHEN sum(CASE WHEN found AND sim IS NULL THEN 1 ELSE 0 END) > 0 THEN NULL
        ELSE avg(CASE WHEN found AND 1 - sim > 0.72 THEN 1.0 ELSE 0.0 END) END AS rate
      FROM pairs p JOIN fs USING (a, b) GROUP BY p.user_id)"""))
def a16_metric_mean_median(spark, d):
    _, _, pairs, f = _feats(spark, d)
    r = materialize(ev.pair_rate(pairs, f, 0.72))
    median = aggregates.grouped_median(r, [], "rate", "median_rate")
    return median.select(r6(r.select(F.avg("rate")).scalar()).alias("mean_rate"), r6("median_rate").alias("median_rate"))


def _sample_sql(col: str) -> str:
    return f"""(SELECT user_id, vacancy_id FROM (SELECT x.user_id, x.vacancy_id, row_number() OVER (PARTITION BY x.user_id
        ORDER BY md5(concat('42', CAST(x.vacancy_id AS VARCHAR))), x.vacancy_id) AS r
        FROM (SELECT DISTINCT user_id, vacancy_id FROM {{src}}) x JOIN vacancy v ON v.vacancy_id = x.vacancy_id
        WHERE v.{col} IS NOT NULL) WHERE r <= 3)"""


def _v9_ctes(col: str, p: str) -> dict[str, str]:
    s = _sample_sql(col)
    ctes = {
        f"{p}pairs": f"""SELECT t.user_id, t.vacancy_id AS a, q.vacancy_id AS b FROM {s.format(src='truth')} t
            JOIN {s.format(src='pred')} q ON q.user_id = t.user_id""",
        f"{p}txt": f"""SELECT DISTINCT x.a, x.b, va.{col} AS ta, vb.{col} AS tb FROM {p}pairs x
            JOIN vacancy va ON va.vacancy_id = x.a JOIN vacancy vb ON vb.vacancy_id = x.b""",
    }
    ctes.update(_k3_ctes(f"{p}k", f"{p}txt", "ta", "tb"))
    ctes[f"{p}mean"] = f"""SELECT x.user_id, avg(c.cos) AS mean_cos FROM {p}pairs x
        JOIN {p}kcos c ON c.a = x.a AND c.b = x.b GROUP BY x.user_id"""
    return ctes


_V9 = dict(EVAL_CTES)
_V9.update(_v9_ctes("keySkills_str", "vs"))
_V9.update(_v9_ctes("name", "vn"))


@register("v9_sampled_mean_cosine", W("""SELECT user_id, round(mean_cos, 6) AS mean_cos FROM vsmean""",
                                      "vacancy", "interaction", extra=_V9))
def v9_sampled_mean_cosine(spark, d):
    out = ev.sampled_mean_cosine(predictions(spark, d), truth(spark, d), fx.vacancy(spark, d), "keySkills_str")
    return out.select("user_id", r6("mean_cos").alias("mean_cos"))


@register("v10_two_column_mean", W("""SELECT s.user_id, round((s.mean_cos + n.mean_cos) / 2, 6) AS mean_cos
FROM vsmean s JOIN vnmean n ON n.user_id = s.user_id""", "vacancy", "interaction", extra=_V9))
def v10_two_column_mean(spark, d):
    p, t, v = predictions(spark, d), truth(spark, d), fx.vacancy(spark, d)
    s = ev.sampled_mean_cosine(p, t, v, "keySkills_str").withColumnRenamed("mean_cos", "s")
    n = ev.sampled_mean_cosine(p, t, v, "name").withColumnRenamed("mean_cos", "n")
    return s.join(n, "user_id").select("user_id", r6((F.col("s") + F.col("n")) / 2).alias("mean_cos"))


_GRID = ", ".join(f"({round(0.5 + i * 0.01, 2)})" for i in range(51))


@register("v11_threshold_sweep", EW(f"""
, grid AS (SELECT CAST(threshold AS DOUBLE) AS threshold FROM (VALUES {_GRID}) g(threshold)),
ur AS (SELECT p.user_id, count(*) AS n_pairs, sum(CASE WHEN found AND sim IS NULL THEN 1 ELSE 0 END) AS bad
       FROM pairs p JOIN fs USING (a, b) GROUP BY p.user_id),
rates AS (SELECT g.threshold, (SELECT count(*) FROM pairs p JOIN fs USING (a, b)
          WHERE p.user_id = ur.user_id AND found AND 1 - sim > g.threshold) / ur.n_pairs AS rate
          FROM ur, grid g WHERE ur.bad = 0),
med AS (SELECT threshold, quantile_cont(rate, 0.5) AS median_rate FROM rates GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round(median_rate, 6) AS median_rate FROM med
WHERE threshold <= coalesce((SELECT min(threshold) FROM med WHERE median_rate = 0), 1.0)""").replace(
    "\n\n, grid AS", ", grid AS", 1))
def v11_threshold_sweep(spark, d):
    _, _, pairs, f = _feats(spark, d)
    out = ev.threshold_sweep(pairs, f)
    return out.select(r6("threshold").alias("threshold"), r6("median_rate").alias("median_rate"))


@register("v15_similarity_ordered", EW("""SELECT user_id, b AS vacancy_id, round(wsim, 6) AS weighted_sim,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(wsim, 9), b) AS BIGINT) AS rank
FROM (SELECT DISTINCT p.user_id, p.b, fs.wsim FROM pairs p JOIN fs USING (a, b) WHERE p.true_pos = 1)"""))
def v15_similarity_ordered(spark, d):
    """Each user's predictions ordered by weighted similarity to the
    user's first true item, lowest first (the reference's order, Q2)."""
    _, _, pairs, f = _feats(spark, d, ranked=True)
    s = f.select("a", "b", ev.weighted_similarity().alias("wsim"))
    j = pairs.filter(F.col("true_pos") == 1).join(s, ["a", "b"]).select("user_id", "b", "wsim").distinct()
    w = Window.partitionBy("user_id").orderBy(F.round("wsim", 9), "b")
    return j.select("user_id", F.col("b").alias("vacancy_id"), r6("wsim").alias("weighted_sim"),
                    F.row_number().over(w).cast("bigint").alias("rank"))


@register("j8_truth_pred_pairs", EW("""SELECT user_id, a AS true_id, b AS pred_id, CAST(true_pos AS BIGINT) AS true_pos,
  CAST(pred_rank AS BIGINT) AS pred_rank FROM pairs"""))
def j8_truth_pred_pairs(spark, d):
    """Every true item of a user with every predicted one (|truth| x k)."""
    p = ev.truth_pred_pairs(predictions(spark, d), truth(spark, d, ranked=True))
    return p.select("user_id", F.col("a").alias("true_id"), F.col("b").alias("pred_id"),
                    F.col("true_pos").cast("bigint"), F.col("pred_rank").cast("bigint"))
