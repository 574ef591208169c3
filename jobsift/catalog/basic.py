"""Scans, projections, cleaning, encoders, titles, simple aggregates and set
operations (inventory steps 1 and 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.functions import codes, text, titles
from jobsift.operators import aggregates, cleaning, encoders, sets
from jobsift.operators import titles as title_ops
from jobsift.sources import fixtures as fx
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


VAC_COLS = ["vacancy_id", "name_raw", "name", "keySkills_str", "company_id", "compensation_from",
            "compensation_to", "compensation_currencyCode", "area_id", "employment",
            "workSchedule", "workExperience"]
VAC_SQL_COLS = ", ".join(VAC_COLS)


# ----------------------------------------------------------------- S: scans
@register("s5_parquet_scan", W(f"SELECT {VAC_SQL_COLS} FROM vacancy", "vacancy"))
def s5_parquet_scan(spark, d):
    return fx.vacancy(spark, d).select(*VAC_COLS)


@register("s6_table_sql", W("SELECT vacancy_id, name, area_id FROM vacancy WHERE workExperience = 'noExperience'",
                            "vacancy"))
def s6_table_sql(spark, d):
    fx.vacancy(spark, d).createOrReplaceTempView("vacancies_ru")
    return spark.sql("SELECT vacancy_id, name, area_id FROM vacancies_ru "
                     "WHERE workExperience = 'noExperience'")


# ------------------------------------------------------ P: projection/filter
@register("p1_rename", "SELECT p_partkey AS vacancy_id, p_brand AS area_id, p_retailprice AS compensation_from FROM part")
def p1_rename(spark, d):
    return cleaning.rename(table(spark, d, "part"), {"p_partkey": "vacancy_id", "p_brand": "area_id",
                                                     "p_retailprice": "compensation_from"})


@register("p2_bot_view", W("""SELECT v.vacancy_id, v.name, d.description, v.compensation_from, v.compensation_to
FROM vacancy v LEFT JOIN descriptions d ON d.vacancy_id = v.vacancy_id""", "vacancy", "descriptions"))
def p2_bot_view(spark, d):
    v = fx.vacancy(spark, d)
    return v.join(fx.descriptions(spark, d), "vacancy_id", "left").select(
        "vacancy_id", "name", "description", "compensation_from", "compensation_to")


@register("p3_equality_filter", W("""SELECT vacancy_id, name FROM vacancy
WHERE area_id = 'Brand#3' AND employment = 'full' AND workSchedule = 'remote'""", "vacancy"))
def p3_equality_filter(spark, d):
    return cleaning.filter_equal(fx.vacancy(spark, d), area_id="Brand#3", employment="full",
                                 workSchedule="remote").select("vacancy_id", "name")


@register("p4_currency_filter", W("SELECT vacancy_id, compensation_from FROM vacancy WHERE compensation_currencyCode = 'RUR'",
                                  "vacancy"))
def p4_currency_filter(spark, d):
    return cleaning.keep_currency(fx.vacancy(spark, d)).select("vacancy_id", "compensation_from")


@register("p5_null_aware_not_equal", W("""SELECT vacancy_id, compensation_currencyCode FROM vacancy
WHERE compensation_currencyCode IS DISTINCT FROM 'RUR'""", "vacancy"))
def p5_null_aware_not_equal(spark, d):
    return cleaning.drop_currency(fx.vacancy(spark, d)).select("vacancy_id", "compensation_currencyCode")


@register("p6_drop_nulls", W("""SELECT vacancy_id FROM vacancy WHERE keySkills_str IS NOT NULL
AND compensation_from IS NOT NULL AND name IS NOT NULL AND workExperience IS NOT NULL""", "vacancy"))
def p6_drop_nulls(spark, d):
    return cleaning.drop_nulls(fx.vacancy(spark, d), ["keySkills_str", "compensation_from", "name",
                                                      "workExperience"]).select("vacancy_id")


@register("p7_fill_mean", W("""SELECT vacancy_id,
  round(coalesce(compensation_from, (SELECT avg(compensation_from) FROM vacancy)), 6) AS compensation_from,
  round(coalesce(compensation_to, avg(compensation_to) OVER (PARTITION BY area_id)), 6) AS compensation_to
FROM vacancy""", "vacancy"))
def p7_fill_mean(spark, d):
    v = fx.vacancy(spark, d)
    out = cleaning.fill_with_mean(v, ["compensation_from"])
    out = cleaning.fill_with_mean(out, ["compensation_to"], by=["area_id"])
    return out.select("vacancy_id", r6("compensation_from").alias("compensation_from"),
                      r6("compensation_to").alias("compensation_to"))


_SAL_TXT = ("CASE WHEN p_partkey % 13 = 0 THEN 'n/a' WHEN p_partkey % 7 = 0 THEN NULL "
            "ELSE CAST(p_retailprice AS VARCHAR) END")


@register("p8_fill_constant", f"""SELECT p_partkey AS vacancy_id,
  CAST(trunc(coalesce(TRY_CAST({_SAL_TXT} AS DOUBLE), 100000.0)) AS BIGINT) AS salary FROM part""")
def p8_fill_constant(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_SAL_TXT.replace("VARCHAR", "STRING")).alias("txt"))
    return p.select(F.col("p_partkey").alias("vacancy_id"), cleaning.numeric_or_default("txt").alias("salary"))


@register("p9_first_per_key", W("""SELECT user_id, vacancy_id, action_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY vacancy_id ORDER BY action_dt, event_id) AS rn
  FROM interaction WHERE vacancy_id IS NOT NULL) WHERE rn = 1""", "interaction"))
def p9_first_per_key(spark, d):
    i = fx.interaction(spark, d)
    return cleaning.first_per_key(i, "vacancy_id", ["action_dt", "event_id"],
                                  not_null=["vacancy_id"]).select("user_id", "vacancy_id", "action_type", "event_id")


@register("p10_drop_sessions_touching", W("""SELECT session_id, vacancy_id, action_type, event_id FROM interaction
WHERE session_id NOT IN (SELECT i.session_id FROM interaction i JOIN vacancy v ON v.vacancy_id = i.vacancy_id
                         WHERE v.compensation_currencyCode IS DISTINCT FROM 'RUR')""", "interaction", "vacancy"))
def p10_drop_sessions_touching(spark, d):
    foreign = cleaning.drop_currency(fx.vacancy(spark, d))
    return cleaning.drop_groups_touching(fx.interaction(spark, d), "session_id", "vacancy_id", foreign) \
        .select("session_id", "vacancy_id", "action_type", "event_id")


def _user_counts(spark, d):
    """Sizes of each user's lists of likes, responses and test views: counted,
    never gathered."""
    t = F.col("action_type")
    return fx.interaction(spark, d).groupBy("user_id").agg(
        F.count_if(t == 3).alias("n_likes"), F.count_if(t == 1).alias("n_responses"),
        F.count_if((t == 2) & ~F.col("is_train")).alias("n_preds"))


_USER_LISTS_SQL = """SELECT user_id,
  list(vacancy_id) FILTER (WHERE action_type = 3) AS likes,
  list(vacancy_id) FILTER (WHERE action_type = 1) AS responses,
  list(vacancy_id) FILTER (WHERE action_type = 2 AND NOT is_train) AS preds
FROM interaction GROUP BY user_id"""


@register("p11_non_empty_arrays", W("""SELECT user_id, CAST(len(likes) AS BIGINT) AS n_likes,
  CAST(len(responses) AS BIGINT) AS n_responses FROM ul WHERE len(likes) > 0 AND len(responses) > 0""",
                                    "interaction", extra={"ul": _USER_LISTS_SQL}))
def p11_non_empty_arrays(spark, d):
    return _user_counts(spark, d).filter("n_likes > 0 and n_responses > 0").select("user_id", "n_likes", "n_responses")


@register("p12_drop_empty_predictions", W("""SELECT user_id, CAST(len(preds) AS BIGINT) AS n_preds
FROM ul WHERE len(preds) > 0""", "interaction", extra={"ul": _USER_LISTS_SQL}))
def p12_drop_empty_predictions(spark, d):
    return _user_counts(spark, d).filter("n_preds > 0").select("user_id", "n_preds")


_PAY_TXT = ("concat(CAST(floor(abs(c_acctbal) * 20) AS BIGINT), ' ', "
            "CASE WHEN c_custkey % 4 = 0 THEN 'USD' ELSE 'руб.' END)")


@register("p13_amount_currency", f"""SELECT user_id, round(amount, 6) AS amount FROM (
  SELECT c_custkey AS user_id, TRY_CAST(split_part(t, ' ', 1) AS DOUBLE) AS amount,
         nullif(substr(t, strpos(t, ' ') + 1), '') AS currency
  FROM (SELECT c_custkey, {_PAY_TXT} AS t FROM customer))
WHERE currency = 'руб.' AND amount >= 20000""")
def p13_amount_currency(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr(_PAY_TXT.replace("BIGINT", "BIGINT")).alias("t"))
    return (c.select(F.col("c_custkey").alias("user_id"), *cleaning.amount_and_currency("t"))
            .filter((F.col("currency") == "руб.") & (F.col("amount") >= 20000))
            .select("user_id", r6("amount").alias("amount")))


_SEG = "CASE WHEN c_custkey % 6 = 0 THEN 'Не указано' ELSE c_mktsegment END"


@register("p14_literal_exclusion", f"""SELECT c_custkey AS user_id, {_SEG} AS segment FROM customer
WHERE ({_SEG}) IS DISTINCT FROM 'Не указано'""")
def p14_literal_exclusion(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(_SEG).alias("segment"))
    return c.filter(~F.col("segment").eqNullSafe("Не указано"))


@register("p15_id_prefix_strip", W("""SELECT event_id,
  CAST(regexp_replace(concat('v_', CAST(vacancy_id AS VARCHAR)), '^v_', '') AS BIGINT) AS vacancy_id,
  split_part(session_id, '_', 2) AS day FROM interaction""", "interaction"))
def p15_id_prefix_strip(spark, d):
    i = fx.interaction(spark, d)
    return i.select("event_id",
                    text.strip_prefix_id(F.concat(F.lit("v_"), F.col("vacancy_id").cast("string")))
                    .cast("bigint").alias("vacancy_id"),
                    text.after_underscore("session_id").alias("day"))


@register("p16_sanity_filter", W("SELECT vacancy_id FROM vectors WHERE vec[1] > 0", "vectors"))
def p16_sanity_filter(spark, d):
    return fx.vectors(spark, d).filter(F.col("vec")[0] > 0).select("vacancy_id")


@register("p17_point_lookup", W("SELECT event_id, vacancy_id, action_type FROM interaction WHERE user_id = 7",
                                "interaction"))
def p17_point_lookup(spark, d):
    return fx.interaction(spark, d).filter(F.col("user_id") == 7).select("event_id", "vacancy_id", "action_type")


@register("p18_dictionary_cleaning", W("""SELECT DISTINCT lower(p) AS title FROM (
  SELECT unnest(list_filter(list_transform(regexp_split_to_array(name_raw, '[/\\\\]'), lambda x: trim(x)), lambda x: length(x) > 0)) AS p
  FROM vacancy) WHERE p IS NOT NULL AND length(p) >= 6""", "vacancy"))
def p18_dictionary_cleaning(spark, d):
    parts = fx.vacancy(spark, d).select(F.explode(titles.slash_parts("name_raw")).alias("title"))
    return cleaning.lower_titles(parts, "title")


# ----------------------------------------------------------- E: encoders
@register("e1_label_encoding", W("""SELECT vacancy_id,
  CAST(dense_rank() OVER (ORDER BY employment) - 1 AS BIGINT) AS employment_encoder,
  CAST(dense_rank() OVER (ORDER BY area_id) - 1 AS BIGINT) AS area_encoder FROM vacancy""", "vacancy"))
def e1_label_encoding(spark, d):
    v = fx.vacancy(spark, d)
    out = encoders.label_encode(v, "employment")
    out = encoders.label_encode(out, "area_id", "area_encoder")
    return out.select("vacancy_id", "employment_encoder", "area_encoder")


@register("e2_e4_ordinals", W("""SELECT vacancy_id,
  CASE workExperience WHEN 'moreThan6' THEN 4 WHEN 'between3And6' THEN 3 WHEN 'between1And3' THEN 2 ELSE 1 END AS experience_code,
  CASE employment WHEN 'full' THEN 5 WHEN 'part' THEN 4 WHEN 'project' THEN 3 WHEN 'probation' THEN 2 ELSE 1 END AS employment_code,
  CASE workSchedule WHEN 'fullDay' THEN 5 WHEN 'shift' THEN 4 WHEN 'remote' THEN 3 WHEN 'flexible' THEN 2 ELSE 1 END AS schedule_code
FROM vacancy""", "vacancy"))
def e2_e4_ordinals(spark, d):
    v = fx.vacancy(spark, d)
    return v.select("vacancy_id", codes.experience_ordinal("workExperience").alias("experience_code"),
                    codes.employment_ordinal("employment").alias("employment_code"),
                    codes.schedule_ordinal("workSchedule").alias("schedule_code"))


@register("e5_cluster_codes", W("""SELECT vacancy_id,
  CASE workExperience WHEN 'noExperience' THEN 0 WHEN 'between3And6' THEN 1 WHEN 'between1And3' THEN 2 WHEN 'moreThan6' THEN 3 END AS experience_code,
  CASE workSchedule WHEN 'fullDay' THEN 0 WHEN 'flyInFlyOut' THEN 1 WHEN 'flexible' THEN 2 WHEN 'shift' THEN 3 WHEN 'remote' THEN 4 END AS schedule_code,
  CASE employment WHEN 'full' THEN 4 WHEN 'part' THEN 3 WHEN 'project' THEN 2 WHEN 'probation' THEN 1 WHEN 'volunteer' THEN 0 END AS employment_code
FROM vacancy""", "vacancy"))
def e5_cluster_codes(spark, d):
    v = fx.vacancy(spark, d)
    return v.select("vacancy_id", *codes.cluster_codes("workExperience", "workSchedule", "employment"))


@register("e6_metric_experience", W("""SELECT vacancy_id,
  CASE workExperience WHEN 'noExperience' THEN 0 WHEN 'between1And3' THEN 1 WHEN 'between3And6' THEN 2 WHEN 'moreThan6' THEN 3 END AS experience_index
FROM vacancy""", "vacancy"))
def e6_metric_experience(spark, d):
    return fx.vacancy(spark, d).select("vacancy_id", codes.metric_experience("workExperience").alias("experience_index"))


@register("e7_board_codes", """SELECT p_partkey AS vacancy_id,
  CASE p_size % 14 WHEN 6 THEN 'full' WHEN 10 THEN 'part' WHEN 13 THEN 'part' WHEN 12 THEN 'full' WHEN 9 THEN 'full' WHEN 7 THEN 'project' ELSE 'full' END AS employment,
  CASE WHEN p_partkey % 3 = 2 THEN 'remote' ELSE CASE p_partkey % 14 WHEN 6 THEN 'fullDay' WHEN 7 THEN 'fullDay' WHEN 10 THEN 'flexible'
       WHEN 13 THEN 'flexible' WHEN 12 THEN 'shift' WHEN 9 THEN 'flyInFlyOut' ELSE 'fullDay' END END AS workSchedule,
  CASE p_size % 6 WHEN 1 THEN 'noExperience' WHEN 2 THEN 'between1And3' WHEN 3 THEN 'between3And6' WHEN 4 THEN 'moreThan6' ELSE 'noExperience' END AS workExperience
FROM part""")
def e7_board_codes(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("vacancy_id"),
                    codes.board_employment(F.col("p_size") % 14).alias("employment"),
                    codes.board_schedule(F.col("p_partkey") % 14, F.col("p_partkey") % 3).alias("workSchedule"),
                    codes.board_experience(F.col("p_size") % 6).alias("workExperience"))


# Resume-style wording derived from part rows (some pieces are unmapped on purpose).
_EMP_WORDS = ["полная занятость", "неполный день", "частичная занятость", "стажировка",
              "проектная работа", "волонтерство", "вахта", "другое"]
_SCH_WORDS = ["вахтовый метод", "удаленная работа", "гибкий график", "сменный график",
              "полный день", "свободный", "ночной", "другое"]


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_EMP_TXT_SQL = (f"concat({_sql_list(_EMP_WORDS)}[p_size % 8 + 1], ', ', "
                f"{_sql_list(_EMP_WORDS)}[p_partkey % 8 + 1])")
_SCH_TXT_SQL = (f"concat({_sql_list(_SCH_WORDS)}[p_partkey % 8 + 1], ', ', "
                f"{_sql_list(_SCH_WORDS)}[p_size % 8 + 1])")


@register("e8_multi_value_mapping", f"""SELECT vacancy_id,
  array_to_string(list_filter(list_transform(string_split(emp, ', '), lambda x: CASE x
    WHEN 'полная занятость' THEN 'full' WHEN 'неполный день' THEN 'part' WHEN 'частичная занятость' THEN 'part'
    WHEN 'стажировка' THEN 'probation' WHEN 'проектная работа' THEN 'project' WHEN 'волонтерство' THEN 'volunteer' END),
    lambda x: x IS NOT NULL), ',') AS employment,
  array_to_string(list_filter(list_transform(string_split(sch, ', '), lambda x: CASE x
    WHEN 'вахтовый метод' THEN 'flyInFlyOut' WHEN 'удаленная работа' THEN 'remote' WHEN 'гибкий график' THEN 'flexible'
    WHEN 'сменный график' THEN 'shift' WHEN 'полный день' THEN 'fullDay' END), lambda x: x IS NOT NULL), ',') AS workSchedule
FROM (SELECT p_partkey AS vacancy_id, {_EMP_TXT_SQL} AS emp, {_SCH_TXT_SQL} AS sch FROM part)""")
def e8_multi_value_mapping(spark, d):
    p = table(spark, d, "part")
    ew = F.array(*[F.lit(w) for w in _EMP_WORDS])
    sw = F.array(*[F.lit(w) for w in _SCH_WORDS])
    emp = F.concat(F.element_at(ew, (F.col("p_size") % 8 + 1).cast("int")), F.lit(", "),
                   F.element_at(ew, (F.col("p_partkey") % 8 + 1).cast("int")))
    sch = F.concat(F.element_at(sw, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(", "),
                   F.element_at(sw, (F.col("p_size") % 8 + 1).cast("int")))
    return p.select(F.col("p_partkey").alias("vacancy_id"),
                    F.array_join(codes.map_multi(emp, codes.RESUME_EMPLOYMENT), ",").alias("employment"),
                    F.array_join(codes.map_multi(sch, codes.RESUME_SCHEDULE), ",").alias("workSchedule"))


@register("e9_experience_from_years", W("""SELECT user_id, CASE WHEN experience_years < 1 THEN 'noExperience'
  WHEN experience_years < 3 THEN 'between1And3' WHEN experience_years < 6 THEN 'between3And6'
  ELSE 'moreThan6' END AS workExperience FROM request""", "request"))
def e9_experience_from_years(spark, d):
    return fx.request(spark, d).select("user_id", codes.experience_from_years("experience_years").alias("workExperience"))


@register("e10_experience_from_months", """SELECT c_custkey AS user_id, CASE WHEN m IS NULL THEN NULL
  WHEN ceil(m / 12.0) = 0 THEN 'noExperience' WHEN ceil(m / 12.0) < 3 THEN 'between1And3'
  WHEN ceil(m / 12.0) < 6 THEN 'between3And6' ELSE 'moreThan6' END AS workExperience
FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 100 END AS m FROM customer)""")
def e10_experience_from_months(spark, d):
    c = table(spark, d, "customer")
    m = F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_custkey") % 100)
    return c.select(F.col("c_custkey").alias("user_id"), codes.experience_from_months(m).alias("workExperience"))


# --------------------------------------------------------- I21/I22/N1-N3
_NO_PAREN_SQL = "trim(regexp_replace(regexp_replace(name_raw, '\\((.*?)\\)', '', 'g'), '\\s+', ' ', 'g'))"
_PARTS_SQL = f"list_filter(list_transform(regexp_split_to_array({_NO_PAREN_SQL}, '[/\\\\]'), lambda x: trim(x)), lambda x: length(x) > 0)"


@register("i21_title_parentheses", W(f"""SELECT vacancy_id,
  array_to_string(regexp_extract_all(name_raw, '\\((.*?)\\)', 1), ',') AS parenthesis,
  {_NO_PAREN_SQL} AS name_no_parenthesis FROM vacancy""", "vacancy"))
def i21_title_parentheses(spark, d):
    v = fx.vacancy(spark, d)
    return v.select("vacancy_id", F.array_join(titles.parentheses("name_raw"), ",").alias("parenthesis"),
                    titles.without_parentheses("name_raw").alias("name_no_parenthesis"))


@register("i22_title_slash_parts", W(f"""SELECT vacancy_id, ({_PARTS_SQL})[1] AS head,
  array_to_string(({_PARTS_SQL})[2:], ',') AS rest FROM vacancy""", "vacancy"))
def i22_title_slash_parts(spark, d):
    v = fx.vacancy(spark, d)
    parts = titles.slash_parts(titles.without_parentheses("name_raw"))
    return v.select("vacancy_id", F.try_element_at(parts, F.lit(1)).alias("head"),
                    F.array_join(F.slice(parts, 2, 1 << 20), ",").alias("rest"))


@register("n1_clean_title", W(f"SELECT vacancy_id, ({_PARTS_SQL})[1] AS clean_name FROM vacancy", "vacancy"))
def n1_clean_title(spark, d):
    return fx.vacancy(spark, d).select("vacancy_id", titles.clean_title("name_raw").alias("clean_name"))


@register("n2_title_part_frequency", W(f"""SELECT part, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest({_PARTS_SQL}) AS part FROM vacancy) GROUP BY part""", "vacancy"))
def n2_title_part_frequency(spark, d):
    return title_ops.part_frequency(fx.vacancy(spark, d), "vacancy_id", "name_raw")


# Oracle for N3 in closed form: the final head is the first part of maximal
# count; rest j holds the running leader before j when that leader is rarer.
_N3_SQL = W(f"""
, parts AS (SELECT vacancy_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS part
            FROM (SELECT vacancy_id, {_PARTS_SQL} AS p FROM vacancy)),
counts AS (SELECT part, count(*) AS cnt FROM parts GROUP BY part),
pc AS (SELECT vacancy_id, pos, parts.part, cnt, cnt * 100000 + (99999 - pos) AS score
       FROM parts JOIN counts USING (part)),
lead AS (SELECT *, max(score) OVER (PARTITION BY vacancy_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
                max(score) OVER (PARTITION BY vacancy_id) AS best FROM pc),
res AS (SELECT l.vacancy_id, l.pos, l.best,
          CASE WHEN l.pos = 0 THEN NULL WHEN (l.prev_best // 100000) < l.cnt THEN pb.part ELSE l.part END AS new_part
        FROM lead l LEFT JOIN pc pb ON pb.vacancy_id = l.vacancy_id AND pb.score = l.prev_best)
SELECT r.vacancy_id, h.part AS clean_name,
       coalesce(array_to_string(list(r.new_part ORDER BY r.pos) FILTER (WHERE r.pos > 0), ','), '') AS slash_names
FROM res r JOIN pc h ON h.vacancy_id = r.vacancy_id AND h.score = r.best
GROUP BY r.vacancy_id, h.part""", "vacancy").replace("\n, parts AS", ", parts AS", 1)


@register("n3_name_swap", _N3_SQL)
def n3_name_swap(spark, d):
    out = title_ops.promote_popular_parts(fx.vacancy(spark, d), "vacancy_id", "name_raw")
    return out.select("vacancy_id", "clean_name", F.array_join("slash_names", ",").alias("slash_names"))


# ----------------------------------------------------------- A: aggregates
@register("a1_value_counts", W("SELECT workSchedule, CAST(count(*) AS BIGINT) AS cnt FROM vacancy GROUP BY workSchedule",
                               "vacancy"))
def a1_value_counts(spark, d):
    return aggregates.value_counts(fx.vacancy(spark, d), "workSchedule")


_SKILL_FREQ_SQL = "SELECT skill, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT unnest(keySkills) AS skill FROM vacancy) GROUP BY skill"


@register("a2_token_frequency", W(_SKILL_FREQ_SQL, "vacancy"))
def a2_token_frequency(spark, d):
    return aggregates.token_frequency(fx.vacancy(spark, d), "keySkills", "skill")


@register("a3_frequency_threshold", W(f"SELECT * FROM ({_SKILL_FREQ_SQL}) WHERE cnt >= 10", "vacancy"))
def a3_frequency_threshold(spark, d):
    return aggregates.token_frequency(fx.vacancy(spark, d), "keySkills", "skill", min_count=10)


@register("a4_mean_median", W("""SELECT compensation_currencyCode AS currency,
  round(avg(compensation_from), 6) AS mean_from, round(quantile_cont(compensation_from, 0.5), 6) AS median_from,
  round(avg(compensation_to), 6) AS mean_to, round(quantile_cont(compensation_to, 0.5), 6) AS median_to
FROM vacancy WHERE compensation_currencyCode IS NOT NULL GROUP BY compensation_currencyCode""", "vacancy"))
def a4_mean_median(spark, d):
    v = fx.vacancy(spark, d).filter(F.col("compensation_currencyCode").isNotNull())
    out = aggregates.mean_median(v, ["compensation_currencyCode"], ["compensation_from", "compensation_to"])
    return out.select(F.col("compensation_currencyCode").alias("currency"),
                      *[r6(c).alias(c) for c in ["mean_from", "median_from", "mean_to", "median_to"]])


@register("a5_count_by_keys", W("""SELECT area_id, employment, CAST(count(compensation_from) AS BIGINT) AS n_from,
  CAST(count(compensation_to) AS BIGINT) AS n_to FROM vacancy
WHERE area_id IS NOT NULL AND employment IS NOT NULL GROUP BY area_id, employment""", "vacancy"))
def a5_count_by_keys(spark, d):
    return aggregates.non_null_counts(fx.vacancy(spark, d), ["area_id", "employment"],
                                      {"compensation_from": "n_from", "compensation_to": "n_to"})


@register("a9_distinct_counts", W("""SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
  CAST(count(DISTINCT vacancy_id) AS BIGINT) AS n_vacancies, CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions
FROM interaction""", "interaction"))
def a9_distinct_counts(spark, d):
    i = fx.interaction(spark, d)
    return i.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("vacancy_id").alias("n_vacancies"),
                 F.count_distinct("session_id").alias("n_sessions"))


@register("a17_null_counts", W("""SELECT """ + ", ".join(
    f"CAST(count(*) - count({c}) AS BIGINT) AS {c}" for c in VAC_COLS) + " FROM vacancy", "vacancy"))
def a17_null_counts(spark, d):
    return aggregates.null_counts(fx.vacancy(spark, d).select(*VAC_COLS))


# -------------------------------------------------------------- U: sets
@register("u1_union_by_name", W("""SELECT vacancy_id, name, area_id, NULL::DOUBLE AS compensation_from FROM vacancy
UNION ALL SELECT p_partkey + 1000000000 AS vacancy_id, p_name AS name, NULL AS area_id, p_retailprice AS compensation_from
FROM part WHERE p_size > 40""", "vacancy"))
def u1_union_by_name(spark, d):
    a = fx.vacancy(spark, d).select("vacancy_id", "name", "area_id")
    b = table(spark, d, "part").filter(F.col("p_size") > 40).select(
        (F.col("p_partkey") + 1000000000).alias("vacancy_id"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("compensation_from"))
    return sets.union_all_by_name([a, b])


@register("u2_union_filled", W("""SELECT vacancy_id, keySkills_str FROM vacancy WHERE keySkills_str IS NOT NULL
UNION ALL SELECT vacancy_id, lower(name) AS keySkills_str FROM vacancy WHERE keySkills_str IS NULL""", "vacancy"))
def u2_union_filled(spark, d):
    v = fx.vacancy(spark, d)
    have = v.filter(F.col("keySkills_str").isNotNull()).select("vacancy_id", "keySkills_str")
    filled = v.filter(F.col("keySkills_str").isNull()).select("vacancy_id", F.lower("name").alias("keySkills_str"))
    return filled.unionByName(have)


@register("u3_intersect_keys", W("""SELECT user_id FROM interaction WHERE is_train
INTERSECT SELECT user_id FROM interaction WHERE NOT is_train""", "interaction"))
def u3_intersect_keys(spark, d):
    i = fx.interaction(spark, d)
    return sets.common_keys(i.filter("is_train"), i.filter("not is_train"), "user_id")


@register("u4_u6_array_sets", W("""SELECT user_id,
  array_to_string(list_sort(list_distinct(list(vacancy_id))), ',') AS distinct_items,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(list(vacancy_id) FILTER (WHERE action_type = 3), []),
                                                      coalesce(list(vacancy_id) FILTER (WHERE action_type = 1), [])))), ',') AS liked_or_responded,
  CAST(len(list_intersect(list_distinct(coalesce(list(vacancy_id) FILTER (WHERE action_type = 3), [])),
                          list_distinct(coalesce(list(vacancy_id) FILTER (WHERE action_type = 1), [])))) AS BIGINT) AS n_both
FROM interaction GROUP BY user_id""", "interaction"))
def u4_u6_array_sets(spark, d):
    t = F.col("action_type")
    u = fx.interaction(spark, d).groupBy("user_id").agg(
        F.collect_set("vacancy_id").alias("all_items"), F.collect_set(F.when(t == 3, F.col("vacancy_id"))).alias("likes"),
        F.collect_set(F.when(t == 1, F.col("vacancy_id"))).alias("responses"))
    return u.select("user_id",
                    F.array_join(sets.sorted_distinct("all_items"), ",").alias("distinct_items"),
                    F.array_join(F.array_sort(F.array_union("likes", "responses")), ",").alias("liked_or_responded"),
                    F.size(F.array_intersect("likes", "responses")).cast("bigint").alias("n_both"))
