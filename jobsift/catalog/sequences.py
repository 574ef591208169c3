"""Interaction histories, joins, per-user aggregates and sampling
(inventory step 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.operators import aggregates, joins, sampling
from jobsift.operators import sequences as seq
from jobsift.sources import fixtures as fx
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


def _train_history(spark, d):
    i = fx.interaction(spark, d).filter("is_train")
    return seq.with_salary(i, fx.vacancy(spark, d))


# DuckDB: explicit positions over the train history.
_HIST = {
    "hist": """SELECT i.*, v.compensation_from AS salary,
     row_number() OVER (PARTITION BY i.user_id ORDER BY i.action_dt, i.event_id) - 1 AS pos
  FROM interaction i LEFT JOIN vacancy v ON v.vacancy_id = i.vacancy_id WHERE i.is_train""",
    "cuts": """SELECT user_id, max(pos) FILTER (WHERE action_type = 1) AS last_pos, count(*) AS n_items
  FROM hist GROUP BY user_id""",
    "tgt": """SELECT c.user_id, c.last_pos, c.n_items, c.last_pos - 1 AS hist_len, h.salary AS target
  FROM cuts c JOIN hist h ON h.user_id = c.user_id AND h.pos = c.last_pos""",
}


def HW(sql, *extra_names):
    extra = dict(_HIST)
    return W(sql, "vacancy", "interaction", extra=extra)


@register("w3_last_response_index", HW("""SELECT user_id, CAST(last_pos AS BIGINT) AS last_pos,
  CAST(n_items AS BIGINT) AS n_items FROM cuts WHERE last_pos IS NOT NULL"""))
def w3_last_response_index(spark, d):
    c = seq.response_cut(_train_history(spark, d))
    return c.select("user_id", F.col("last_pos").cast("bigint").alias("last_pos"),
                    F.col("n_items").cast("bigint").alias("n_items"))


@register("w4_prefix_before_response", HW("""SELECT user_id, CAST(hist_len AS BIGINT) AS hist_len,
  round(target, 6) AS target FROM tgt
WHERE target IS NOT NULL AND last_pos > 0 AND hist_len > 5 AND hist_len < 50"""))
def w4_prefix_before_response(spark, d):
    c = seq.gated_cuts(seq.response_cut(_train_history(spark, d)))
    return c.select("user_id", F.col("hist_len").cast("bigint").alias("hist_len"), r6("target").alias("target"))


_FRAME_SQL = """, fr AS (
  SELECT t.user_id, h.pos - (t.last_pos - 6) AS j, h.action_type, h.salary
  FROM tgt t JOIN hist h ON h.user_id = t.user_id AND h.pos BETWEEN t.last_pos - 6 AND t.last_pos - 2
  WHERE t.target IS NOT NULL AND t.last_pos > 0 AND t.hist_len >= 5 AND t.hist_len < 50)"""


def _frame_cols(prefix_sql_type, prefix_sal):
    return ", ".join(
        [f"max(action_type) FILTER (WHERE j = {k}) AS type_{k + 1}" for k in range(5)]
        + [f"round(max({prefix_sal}) FILTER (WHERE j = {k}), 6) AS salary_{k + 1}" for k in range(5)])


@register("w5_trailing_frame", HW("SELECT user_id, " + _frame_cols("", "salary")
                                  + " FROM fr GROUP BY user_id").replace(
    "\nSELECT user_id,", _FRAME_SQL + "\nSELECT user_id,", 1))
def w5_trailing_frame(spark, d):
    h = _train_history(spark, d)
    cuts = seq.gated_cuts(seq.response_cut(h), min_len=4)
    f = seq.trailing_frame(seq.history_before_cut(h, cuts), 5)
    return f.select("user_id", *[F.col("types")[k].alias(f"type_{k + 1}") for k in range(5)],
                    *[r6(F.col("salaries")[k]).alias(f"salary_{k + 1}") for k in range(5)])


@register("w6_frame_row_mean_impute", HW("SELECT user_id, " + ", ".join(
    f"round(coalesce(max(salary) FILTER (WHERE j = {k}), avg(salary)), 6) AS salary_{k + 1}" for k in range(5))
    + " FROM fr GROUP BY user_id").replace("\nSELECT user_id,", _FRAME_SQL + "\nSELECT user_id,", 1))
def w6_frame_row_mean_impute(spark, d):
    h = _train_history(spark, d)
    cuts = seq.gated_cuts(seq.response_cut(h), min_len=4)
    f = seq.trailing_frame(seq.history_before_cut(h, cuts), 5)
    filled = seq.impute_row_mean("salaries")
    return f.select("user_id", *[r6(filled[k]).alias(f"salary_{k + 1}") for k in range(5)])


@register("a12_action_type_means", HW("""
, g AS (SELECT * FROM tgt WHERE target IS NOT NULL AND last_pos > 0 AND hist_len > 5 AND hist_len < 50),
h2 AS (SELECT h.* , g.target FROM hist h JOIN g ON g.user_id = h.user_id AND h.pos < g.last_pos - 1),
um AS (SELECT user_id, CAST(sum(CAST(salary AS DECIMAL(18,2))) AS DOUBLE) / count(salary) AS m FROM h2
       GROUP BY user_id HAVING count(salary) > 0)
SELECT h2.user_id, round(um.m, 6) AS hist_mean,
  round(CASE WHEN count(*) FILTER (WHERE action_type = 1) > 0 THEN
    (coalesce(CAST(sum(CAST(salary AS DECIMAL(18,2))) FILTER (WHERE action_type = 1) AS DOUBLE), 0.0)
     + um.m * count(*) FILTER (WHERE action_type = 1 AND salary IS NULL)) / count(*) FILTER (WHERE action_type = 1)
    ELSE um.m END, 6) AS mean_type1,
  round(CASE WHEN count(*) FILTER (WHERE action_type = 2) > 0 THEN
    (coalesce(CAST(sum(CAST(salary AS DECIMAL(18,2))) FILTER (WHERE action_type = 2) AS DOUBLE), 0.0)
     + um.m * count(*) FILTER (WHERE action_type = 2 AND salary IS NULL)) / count(*) FILTER (WHERE action_type = 2)
    ELSE um.m END, 6) AS mean_type2,
  round(CASE WHEN count(*) FILTER (WHERE action_type = 3) > 0 THEN
    (coalesce(CAST(sum(CAST(salary AS DECIMAL(18,2))) FILTER (WHERE action_type = 3) AS DOUBLE), 0.0)
     + um.m * count(*) FILTER (WHERE action_type = 3 AND salary IS NULL)) / count(*) FILTER (WHERE action_type = 3)
    ELSE um.m END, 6) AS mean_type3,
  round(max(h2.target), 6) AS target
FROM h2 JOIN um ON um.user_id = h2.user_id GROUP BY h2.user_id, um.m""").replace("\n\n, g AS", ", g AS", 1))
def a12_action_type_means(spark, d):
    h = _train_history(spark, d)
    cuts = seq.gated_cuts(seq.response_cut(h))
    feats = seq.action_type_means(seq.history_before_cut(h, cuts))
    out = feats.join(cuts.select("user_id", "target"), "user_id")
    return out.select("user_id", *[r6(c).alias(c) for c in
                                   ["hist_mean", "mean_type1", "mean_type2", "mean_type3", "target"]])


@register("w1_last_row_per_user", W("""SELECT user_id, vacancy_id, action_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY action_dt DESC, event_id DESC) AS rn
  FROM interaction) WHERE rn = 1""", "interaction"))
def w1_last_row_per_user(spark, d):
    i = fx.interaction(spark, d).select("user_id", "vacancy_id", "action_type", "event_id", "action_dt")
    return seq.last_event(i).select("user_id", "vacancy_id", "action_type", "event_id")


@register("w2_latest_session", W("""SELECT user_id, session_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY action_dt DESC, session_id DESC) AS rn
  FROM interaction) WHERE rn = 1""", "interaction"))
def w2_latest_session(spark, d):
    return seq.latest_session(fx.interaction(spark, d)).select("user_id", "session_id")


@register("w7_probe_and_truth", W("""
, fi AS (SELECT user_id, vacancy_id, min(action_dt) AS t, min(event_id) FILTER (WHERE TRUE) AS e0,
           arg_min(event_id, (action_dt, event_id)) AS e
         FROM interaction WHERE action_type IN (1, 3) GROUP BY user_id, vacancy_id),
big AS (SELECT user_id FROM fi GROUP BY user_id HAVING count(*) > 10),
pr AS (SELECT user_id, arg_min(vacancy_id, (t, e)) AS probe FROM fi WHERE user_id IN (SELECT user_id FROM big) GROUP BY user_id)
SELECT fi.user_id, fi.vacancy_id, CAST(fi.vacancy_id = pr.probe AS INTEGER) AS is_probe
FROM fi JOIN pr ON pr.user_id = fi.user_id""", "interaction").replace("\n\n, fi AS", ", fi AS", 1))
def w7_probe_and_truth(spark, d):
    i = fx.interaction(spark, d).filter(F.col("action_type").isin(1, 3))
    return joins.probe_and_truth(i, min_distinct=10).select(
        "user_id", "vacancy_id", F.col("is_probe").cast("int").alias("is_probe"))


@register("w8_session_fold", W("""SELECT user_id, session_id,
  array_to_string(list(vacancy_id ORDER BY action_dt, event_id), ',') AS vacancy_ids,
  array_to_string(list(action_type ORDER BY action_dt, event_id), ',') AS action_types
FROM interaction GROUP BY user_id, session_id""", "interaction"))
def w8_session_fold(spark, d):
    f = seq.fold_sessions(fx.interaction(spark, d))
    return f.select("user_id", "session_id", F.array_join("vacancy_id", ",").alias("vacancy_ids"),
                    F.array_join("action_type", ",").alias("action_types"))


@register("i4_explode_parallel", W("""SELECT session_id,
  CAST(row_number() OVER (PARTITION BY user_id, session_id ORDER BY action_dt, event_id) - 1 AS BIGINT) AS pos,
  vacancy_id, action_type FROM interaction""", "interaction"))
def i4_explode_parallel(spark, d):
    f = seq.fold_sessions(fx.interaction(spark, d))
    out = seq.explode_parallel(f, "vacancy_id", "action_type", ["user_id", "session_id"])
    return out.select("session_id", F.col("pos").cast("bigint").alias("pos"), "vacancy_id", "action_type")


@register("i5_filter_by_parallel", W("""SELECT user_id, session_id,
  coalesce(array_to_string(list(vacancy_id ORDER BY action_dt, event_id) FILTER (WHERE action_type IN (1, 3)), ','), '') AS acted
FROM interaction GROUP BY user_id, session_id""", "interaction"))
def i5_filter_by_parallel(spark, d):
    f = seq.fold_sessions(fx.interaction(spark, d))
    return f.select("user_id", "session_id",
                    F.array_join(seq.filter_by_parallel("vacancy_id", "action_type", (1, 3)), ",").alias("acted"))


@register("j1_inner_join", W("""SELECT i.user_id, i.event_id, v.name, v.area_id
FROM interaction i JOIN vacancy v ON v.vacancy_id = i.vacancy_id""", "interaction", "vacancy"))
def j1_inner_join(spark, d):
    return fx.interaction(spark, d).join(fx.vacancy(spark, d), "vacancy_id").select(
        "user_id", "event_id", "name", "area_id")


@register("j2_join_different_keys", W("""SELECT i.event_id, i.vacancy_id AS liked_id, v.workExperience
FROM interaction i JOIN vacancy v ON v.vacancy_id = i.vacancy_id WHERE i.action_type = 3""", "interaction", "vacancy"))
def j2_join_different_keys(spark, d):
    likes = fx.interaction(spark, d).filter("action_type = 3").select("event_id", F.col("vacancy_id").alias("liked_id"))
    v = fx.vacancy(spark, d)
    return likes.join(v, likes["liked_id"] == v["vacancy_id"]).select("event_id", "liked_id", "workExperience")


@register("j3_semi_join", W("""SELECT vacancy_id, name FROM vacancy
WHERE vacancy_id IN (SELECT vacancy_id FROM interaction WHERE action_type = 1)""", "vacancy", "interaction"))
def j3_semi_join(spark, d):
    resp = fx.interaction(spark, d).filter("action_type = 1")
    return fx.vacancy(spark, d).join(resp, "vacancy_id", "left_semi").select("vacancy_id", "name")


@register("j5_array_lookup_join", W("""SELECT i.user_id, i.session_id,
  array_to_string(list(coalesce(CAST(CAST(floor(v.compensation_from * 100) AS BIGINT) AS VARCHAR), 'nan')
                       ORDER BY i.action_dt, i.event_id), ',') AS salaries
FROM interaction i LEFT JOIN vacancy v ON v.vacancy_id = i.vacancy_id GROUP BY i.user_id, i.session_id""",
                                     "interaction", "vacancy"))
def j5_array_lookup_join(spark, d):
    f = seq.fold_sessions(fx.interaction(spark, d))
    sal = fx.vacancy(spark, d).select("vacancy_id", F.floor(F.col("compensation_from") * 100).alias("cents"))
    out = joins.lookup_array(f, ["user_id", "session_id"], "vacancy_id", sal, "cents")
    return out.select("user_id", "session_id", F.array_join(
        F.transform("cents", lambda x: F.coalesce(x.cast("string"), F.lit("nan"))), ",").alias("salaries"))


_REGION_TXT = "CASE WHEN c_custkey % 5 = 0 THEN 'Atlantis' ELSE n.n_name END"


@register("j7_lookup_with_default", f"""SELECT c.c_custkey AS user_id,
  CAST(coalesce(m.n_nationkey, 113) AS BIGINT) AS region_id
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN nation m ON replace(m.n_name, ' ', '') = replace({_REGION_TXT}, ' ', '')""")
def j7_lookup_with_default(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    users = c.select(F.col("c_custkey").alias("user_id"), F.expr(_REGION_TXT.replace("n.", "")).alias("region"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("region"), "n_nationkey")
    out = joins.lookup_with_default(users, "region", names, "region", "n_nationkey", 113, normalise_spaces=True)
    return out.select("user_id", F.col("n_nationkey").cast("bigint").alias("region_id"))


@register("a6_pivot_long", W("""SELECT user_id, vacancy_id, round(avg(action_type), 6) AS score
FROM interaction GROUP BY user_id, vacancy_id""", "interaction"))
def a6_pivot_long(spark, d):
    i = fx.interaction(spark, d)
    return i.groupBy("user_id", "vacancy_id").agg(r6(F.avg("action_type")).alias("score"))


@register("a7_row_normalised", W("""SELECT user_id, vacancy_id,
  round(s / CAST(sum(CAST(s AS DECIMAL(38,18))) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS weight
FROM (SELECT user_id, vacancy_id, avg(action_type) AS s FROM interaction GROUP BY user_id, vacancy_id)""", "interaction"))
def a7_row_normalised(spark, d):
    i = fx.interaction(spark, d)
    cells = i.groupBy("user_id", "vacancy_id").agg(F.avg("action_type").alias("s"))
    out = aggregates.row_normalised(cells, "user_id", "s")
    return out.select("user_id", "vacancy_id", r6("weight").alias("weight"))


@register("a10_group_size", W("SELECT user_id, CAST(count(*) AS BIGINT) AS group_size FROM interaction GROUP BY user_id",
                              "interaction"))
def a10_group_size(spark, d):
    return fx.interaction(spark, d).groupBy("user_id").agg(F.count("*").alias("group_size"))


@register("a11_mean_or_default", W("""SELECT i.user_id, round(coalesce(avg(v.compensation_from), 0), 6) AS mean_salary
FROM interaction i LEFT JOIN vacancy v ON v.vacancy_id = i.vacancy_id WHERE i.action_type = 1
GROUP BY i.user_id""", "interaction", "vacancy"))
def a11_mean_or_default(spark, d):
    h = seq.with_salary(fx.interaction(spark, d).filter("action_type = 1"), fx.vacancy(spark, d))
    return h.groupBy("user_id").agg(r6(aggregates.mean_or_default("salary")).alias("mean_salary"))


@register("l2_global_top_n", W("""SELECT skill, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(keySkills) AS skill FROM vacancy)
GROUP BY skill ORDER BY cnt DESC, skill LIMIT 10""", "vacancy"))
def l2_global_top_n(spark, d):
    freq = aggregates.token_frequency(fx.vacancy(spark, d), "keySkills", "skill")
    return aggregates.top_n(freq, "skill", 10)


@register("l4_seeded_sample", W("""SELECT user_id FROM (SELECT DISTINCT user_id FROM interaction)
ORDER BY md5(concat('42', CAST(user_id AS VARCHAR))), user_id LIMIT 20""", "interaction"))
def l4_seeded_sample(spark, d):
    users = fx.interaction(spark, d).select("user_id").distinct()
    return sampling.sample_n(users, 20, 42, "user_id")


@register("l5_prefix_cap", W("SELECT vacancy_id, name FROM vacancy ORDER BY vacancy_id LIMIT 500", "vacancy"))
def l5_prefix_cap(spark, d):
    return sampling.prefix_cap(fx.vacancy(spark, d).select("vacancy_id", "name"), 500, "vacancy_id")


@register("l7_group_split", W(f"""SELECT user_id,
  CAST(substr(md5(concat('42', CAST(user_id AS VARCHAR))), 1, 8) < '{sampling.hex_threshold(0.1)}' AS INTEGER) AS is_test
FROM (SELECT DISTINCT user_id FROM interaction)""", "interaction"))
def l7_group_split(spark, d):
    users = fx.interaction(spark, d).select("user_id").distinct()
    return users.select("user_id", sampling.split_by_key(users, "user_id", 0.1, 42).cast("int").alias("is_test"))
