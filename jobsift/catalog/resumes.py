"""String, list-text, JSON and resume-text operators (I1-I3, I6-I11, I13-I15,
I17-I20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.functions import resume, text
from jobsift.functions.text import let
from jobsift.operators import phrases, trees
from jobsift.operators import sequences as seq
from jobsift.sources import fixtures as fx
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ I1-I3
@register("i1_parse_list_literal", W("""SELECT user_id, session_id,
  array_to_string(list(vacancy_id ORDER BY action_dt, event_id), ',') AS vacancy_ids,
  array_to_string(list(action_type ORDER BY action_dt, event_id), ',') AS action_types
FROM interaction GROUP BY user_id, session_id""", "interaction"))
def i1_parse_list_literal(spark, d):
    """Session lists written as Python literals and parsed back."""
    f = seq.fold_sessions(fx.interaction(spark, d))
    lit = f.select("user_id", "session_id",
                   F.concat(F.lit("["), F.array_join(F.transform(
                       "vacancy_id", lambda x: F.concat(F.lit("'v_"), x.cast("string"), F.lit("'"))), ", "),
                       F.lit("]")).alias("ids_txt"),
                   F.concat(F.lit("["), F.array_join("action_type", ", "), F.lit("]")).alias("types_txt"))
    ids = F.transform(resume.parse_quoted_list("ids_txt"), lambda s: text.strip_prefix_id(s).cast("bigint"))
    return lit.select("user_id", "session_id", F.array_join(ids, ",").alias("vacancy_ids"),
                      F.array_join(resume.parse_int_list("types_txt"), ",").alias("action_types"))


def _skills_text():
    """keySkills as a list literal; every 13th row holds an empty list."""
    quoted = F.transform("keySkills", lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return (F.when(F.col("vacancy_id") % 13 == 0, F.lit("[]"))
            .otherwise(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))))


_SKILLS_TXT_SQL = """CASE WHEN vacancy_id % 13 = 0 THEN '[]' WHEN keySkills IS NULL THEN NULL
  ELSE concat('[', array_to_string(list_transform(keySkills, lambda x: concat('''', x, '''')), ', '), ']') END"""
_NORM_SQL = """list_filter(list_transform(string_split(regexp_replace(t, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ','),
    lambda s: concat(upper(substr(trim(trim(s), ''''), 1, 1)), lower(substr(trim(trim(s), ''''), 2)))),
    lambda s: length(s) > 0)"""


@register("i2_skill_list_normalise", W(f"""SELECT vacancy_id,
  CASE WHEN len(n) > 0 THEN array_to_string(n, '|') END AS skills,
  CASE WHEN len(n) > 0 THEN lower(array_to_string(n, ' ')) END AS skills_str
FROM (SELECT vacancy_id, {_NORM_SQL} AS n FROM (SELECT vacancy_id, {_SKILLS_TXT_SQL} AS t FROM vacancy))""", "vacancy"))
def i2_skill_list_normalise(spark, d):
    """I2 + I3: normalised skill list and the lower-case skill string."""
    v = fx.vacancy(spark, d).select("vacancy_id", "keySkills")
    n = resume.normalise_skill_list(_skills_text())
    out = v.select("vacancy_id", n.alias("n"))
    return out.select("vacancy_id", F.array_join("n", "|").alias("skills"),
                      F.lower(F.array_join("n", " ")).alias("skills_str"))


# -------------------------------------------------------------------- I6
_HTML_SQL = """trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ \\t\\n\\r\\f]+', ' ', 'g'))"""


@register("i6_html_to_text", f"SELECT page_id, {_HTML_SQL} AS text FROM pages")
def i6_html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text("html").alias("text"))


# -------------------------------------------------------------------- I7
@register("i7_timestamp_normalise", W("""SELECT event_id,
  strftime(strptime(substr(replace(CAST(action_dt AS VARCHAR), ' ', 'T') || '+03:00', 1, 19), '%Y-%m-%dT%H:%M:%S'),
           '%Y-%m-%d %H:%M:%S') AS published_at,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1704067200 + event_id * 37), '%Y-%m-%d %H:%M:%S') AS from_epoch
FROM interaction""", "interaction"))
def i7_timestamp_normalise(spark, d):
    """ISO text (first 19 characters) and epoch seconds to 'yyyy-MM-dd HH:mm:ss'."""
    i = fx.interaction(spark, d)
    iso = F.concat(F.replace(F.col("action_dt").cast("string"), F.lit(" "), F.lit("T")), F.lit("+03:00"))
    parsed = F.to_timestamp_ntz(F.substring(iso, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    epoch = F.lit(1704067200) + F.col("event_id") * 37
    from_epoch = F.expr("timestampadd(SECOND, 1704067200 + event_id * 37, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    del epoch
    return i.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("published_at"),
                    F.date_format(from_epoch, "yyyy-MM-dd HH:mm:ss").alias("from_epoch"))


# -------------------------------------------------------------------- I8
_VAC_JSON_SCHEMA = ("id BIGINT, salary STRUCT<`from`: DOUBLE, `to`: DOUBLE, currency: STRING>, "
                    "schedule STRUCT<id: STRING>, experience STRUCT<id: STRING>, employer STRUCT<id: STRING>, "
                    "professional_roles ARRAY<STRUCT<id: STRING>>, key_skills ARRAY<STRUCT<name: STRING>>")


@register("i8_nested_json_flatten", W("""SELECT vacancy_id, compensation_from, compensation_to,
  CASE WHEN compensation_from IS NOT NULL OR compensation_to IS NOT NULL THEN compensation_currencyCode END
    AS compensation_currencyCode, workSchedule, workExperience, company_id, lower(p_type) AS prof_code,
  CASE WHEN keySkills IS NULL THEN '' ELSE array_to_string(keySkills, '|') END AS keySkills
FROM vacancy JOIN part ON p_partkey = vacancy_id""", "vacancy"))
def i8_nested_json_flatten(spark, d):
    """Crawled-vacancy JSON (optional salary, nested schedule/experience/
    employer, first professional role, key_skills[].name) flattened."""
    v = fx.vacancy(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("vacancy_id"), "p_type"),
                                  "vacancy_id")
    salary = F.when(F.col("compensation_from").isNotNull() | F.col("compensation_to").isNotNull(), F.struct(
        F.col("compensation_from").alias("from"), F.col("compensation_to").alias("to"),
        F.col("compensation_currencyCode").alias("currency")))
    doc = F.to_json(F.struct(
        F.col("vacancy_id").alias("id"), salary.alias("salary"),
        F.struct(F.col("workSchedule").alias("id")).alias("schedule"),
        F.struct(F.col("workExperience").alias("id")).alias("experience"),
        F.struct(F.col("company_id").alias("id")).alias("employer"),
        F.array(F.struct(F.lower("p_type").alias("id"))).alias("professional_roles"),
        F.transform(F.coalesce(F.col("keySkills"), F.array().cast("array<string>")),
                    lambda s: F.struct(s.alias("name"))).alias("key_skills")))
    j = v.select(F.from_json(doc, _VAC_JSON_SCHEMA).alias("j")).select("j.*")
    return j.select(
        F.col("id").alias("vacancy_id"), F.col("salary.from").alias("compensation_from"),
        F.col("salary.to").alias("compensation_to"), F.col("salary.currency").alias("compensation_currencyCode"),
        F.col("schedule.id").alias("workSchedule"), F.col("experience.id").alias("workExperience"),
        F.col("employer.id").alias("company_id"),
        F.try_element_at("professional_roles", F.lit(1))["id"].alias("prof_code"),
        F.array_join(F.transform("key_skills", lambda s: s["name"]), "|").alias("keySkills"))


# ------------------------------------------------------------- I9-I11
def _bench_words(spark, d):
    """Dictionary derived from the benchmark texts: distinct alphabetic words
    of at least five letters, as written."""
    b = table(spark, d, "benchmark")
    return b.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), 0)).alias("w")) \
        .filter(F.col("w").rlike(r"^\p{L}{5,}$")).distinct()


_BENCH_WORDS_SQL = """SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM benchmark)
  WHERE regexp_full_match(w, '\\p{L}{5,}')"""


@register("i9_first_dictionary_match", W("""
, toks AS (SELECT conv_id, turn, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (
    SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM conversations)),
hit AS (SELECT conv_id, turn, arg_min(toks.w, pos) AS city FROM toks JOIN dict USING (w) GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, hit.city FROM conversations c LEFT JOIN hit USING (conv_id, turn)
""", extra={"dict": _BENCH_WORDS_SQL}).replace("\n\n, toks AS", ", toks AS", 1))
def i9_first_dictionary_match(spark, d):
    """The dictionary word that occurs first in each turn (null if none)."""
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    hits = phrases.first_match(conv, ["conv_id", "turn"], "text", _bench_words(spark, d), "w")
    return conv.select("conv_id", "turn").join(hits, ["conv_id", "turn"], "left") \
        .select("conv_id", "turn", F.col("match").alias("city"))


@register("i10_skill_extraction", W("""
, toks AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS pos, w FROM (
    SELECT conv_id, turn, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (
      SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM conversations))
    WHERE regexp_full_match(w, '\\p{L}+')),
grams AS (SELECT conv_id, turn, w AS g FROM toks
    UNION ALL SELECT a.conv_id, a.turn, a.w || ' ' || b.w FROM toks a JOIN toks b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.pos = a.pos + 1
    UNION ALL SELECT a.conv_id, a.turn, a.w || ' ' || b.w || ' ' || c.w FROM toks a
      JOIN toks b ON b.conv_id = a.conv_id AND b.turn = a.turn AND b.pos = a.pos + 1
      JOIN toks c ON c.conv_id = a.conv_id AND c.turn = a.turn AND c.pos = a.pos + 2)
SELECT DISTINCT conv_id, turn, g AS skill FROM grams JOIN dict ON dict.w = lower(grams.g)""",
                                        extra={"dict": "SELECT DISTINCT lower(w) AS w FROM (" + _BENCH_WORDS_SQL + ")"}
                                        ).replace("\n\n, toks AS", ", toks AS", 1))
def i10_skill_extraction(spark, d):
    """Alphabetic tokens, their 1- to 3-grams, matched in lower case
    against a dictionary; distinct matches as written."""
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    vocab = _bench_words(spark, d).select(F.lower("w").alias("w")).distinct()
    return phrases.extract_ngrams(conv, ["conv_id", "turn"], "text", vocab, "w") \
        .select("conv_id", "turn", F.col("gram").alias("skill"))


_PHRASE_DICT_SQL = "SELECT DISTINCT lower(s) AS phrase FROM (SELECT unnest(keySkills) AS s FROM vacancy)"


@register("i11_phrase_extraction", W("""
, toks AS (SELECT vacancy_id, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (
    SELECT vacancy_id, regexp_extract_all(lower(name_raw), '[\\p{L}\\p{N}_]+') AS t FROM vacancy)),
cands AS (SELECT vacancy_id, pos, w AS phrase, 1 AS n FROM toks
    UNION ALL SELECT a.vacancy_id, a.pos, a.w || ' ' || b.w, 2 FROM toks a JOIN toks b ON b.vacancy_id = a.vacancy_id AND b.pos = a.pos + 1
    UNION ALL SELECT a.vacancy_id, a.pos, a.w || ' ' || b.w || ' ' || c.w, 3 FROM toks a
      JOIN toks b ON b.vacancy_id = a.vacancy_id AND b.pos = a.pos + 1 JOIN toks c ON c.vacancy_id = a.vacancy_id AND c.pos = a.pos + 2),
m AS (SELECT cands.* FROM cands JOIN dict USING (phrase)),
best AS (SELECT vacancy_id, pos, arg_max(phrase, n) AS phrase FROM m GROUP BY vacancy_id, pos)
SELECT vacancy_id, array_to_string(list(phrase ORDER BY first_pos), ',') AS phrases FROM (
  SELECT vacancy_id, phrase, min(pos) AS first_pos FROM best GROUP BY vacancy_id, phrase) GROUP BY vacancy_id""",
                                         "vacancy", extra={"dict": _PHRASE_DICT_SQL}).replace(
    "\n\n, toks AS", ", toks AS", 1))
def i11_phrase_extraction(spark, d):
    """Dictionary phrases found in each title (longest match at a
    position, non-overlapping, distinct in order of first appearance)."""
    v = fx.vacancy(spark, d)
    vocab = v.select(F.explode("keySkills").alias("s")).select(F.lower("s").alias("phrase")).distinct()
    found = phrases.extract_phrases(v.select("vacancy_id", F.lower("name_raw").alias("t")), ["vacancy_id"], "t",
                                    vocab, "phrase")
    return found.select("vacancy_id", F.array_join("phrases", ",").alias("phrases"))


# ------------------------------------------------------------ I13, I14
_Y_WORD = "CASE WHEN {n} % 10 = 1 AND {n} % 100 <> 11 THEN 'год' WHEN {n} % 10 IN (2, 3, 4) THEN 'года' ELSE 'лет' END"


def _experience_text():
    y, m = F.col("c_custkey") % 20, F.col("c_custkey") % 12
    yw = F.when((y % 10 == 1) & (y % 100 != 11), "год").when((y % 10).isin(2, 3, 4), "года").otherwise("лет")
    mw = F.when(m == 1, "месяц").when(m.isin(2, 3, 4), "месяца").otherwise("месяцев")
    head = F.concat(F.lit("Опыт работы "), y.cast("string"), F.lit(" "), yw, F.lit(" "), m.cast("string"), F.lit(" "), mw)
    second = F.concat(F.lit("Опыт работы "), (y + 1).cast("string"), F.lit(" лет"))
    return (F.when(F.col("c_custkey") % 3 == 0, F.concat(head, F.lit(" "), second))
            .when(F.col("c_custkey") % 3 == 1, F.concat(head, F.lit(" "), F.col("c_mktsegment")))
            .otherwise(head))


_Y = "c_custkey % 20"
_EXP_TXT_SQL = f"""SELECT c_custkey, c_mktsegment, c_acctbal, CASE c_custkey % 3
    WHEN 0 THEN concat(head, ' Опыт работы ', CAST({_Y} + 1 AS VARCHAR), ' лет')
    WHEN 1 THEN concat(head, ' ', c_mktsegment) ELSE head END AS t
  FROM (SELECT *, concat('Опыт работы ', CAST({_Y} AS VARCHAR), ' ', {_Y_WORD.format(n='(' + _Y + ')')}, ' ',
    CAST(c_custkey % 12 AS VARCHAR), ' ', CASE WHEN c_custkey % 12 = 1 THEN 'месяц'
      WHEN c_custkey % 12 IN (2, 3, 4) THEN 'месяца' ELSE 'месяцев' END) AS head FROM customer)"""
_UNITS_SQL = "['год', 'года', 'лет', 'месяц', 'месяца', 'месяцев']"
_BLOCK_CTES = {
    "txt": _EXP_TXT_SQL,
    "wds": "SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '') AS ws FROM txt",
    "hds": f"""SELECT *, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'Опыт' AND ws[i + 1] = 'работы'
        AND list_has_any(ws[i + 2:i + 8], {_UNITS_SQL})) AS hs FROM wds""",
    "blk": """SELECT *, CASE WHEN len(hs) > 1 THEN array_to_string(ws[hs[2]:coalesce(hs[3], len(ws) + 1) - 1], ' ')
        WHEN len(hs) = 1 THEN array_to_string(ws[hs[1]:], ' ') END AS block FROM hds""",
    "bw": "SELECT *, list_filter(string_split(block, ' '), lambda w: w NOT IN ('Опыт', 'работы')) AS bs FROM blk",
    "mon": f"""SELECT *, list_transform(range(1, len(bs) + 1), lambda i:
        CASE WHEN bs[i] IN ('год', 'года', 'лет') THEN TRY_CAST(bs[i - 1] AS BIGINT) * 12
             WHEN bs[i] IN ('месяц', 'месяца', 'месяцев') THEN TRY_CAST(bs[i - 1] AS BIGINT)
             WHEN regexp_full_match(bs[i], '[0-9]+') THEN 0 END) AS ms FROM bw""",
    "mos": """SELECT *, CASE WHEN len(list_filter(ms, lambda x: x IS NULL)) = 0 THEN CAST(list_sum(ms) AS BIGINT) END
        AS months FROM mon""",
}


@register("i13_resume_experience", W("""SELECT c_custkey AS user_id, block, months,
  CASE WHEN months IS NULL THEN NULL WHEN ceil(months / 12.0) = 0 THEN 'noExperience'
       WHEN ceil(months / 12.0) < 3 THEN 'between1And3' WHEN ceil(months / 12.0) < 6 THEN 'between3And6'
       ELSE 'moreThan6' END AS workExperience FROM mos""", extra=_BLOCK_CTES))
def i13_resume_experience(spark, d):
    """I13 + E10 on resume-style experience headers derived from customers."""
    c = table(spark, d, "customer").select("c_custkey", _experience_text().alias("t"))
    # many rows of little text lie in few files: a task for each core, not for each file
    c = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "c_custkey")
    from jobsift.functions.codes import experience_from_months
    # text, block and months are read several times and would be worked out at each
    parsed = let(F.col("t"), lambda t: let(resume.experience_block(t), lambda b: let(
        resume.experience_months(b), lambda m: F.struct(
            b.alias("block"), m.alias("months"), experience_from_months(m).alias("workExperience")))))
    return c.select(F.col("c_custkey").alias("user_id"), F.inline(F.array(parsed)))


@register("i14_drop_durations", W("""SELECT c_custkey AS user_id,
  trim(regexp_replace(t, '[0-9]+ (месяцев|месяца|месяц|года|год|лет)', '', 'g')) AS text FROM txt""",
                                  extra={"txt": _EXP_TXT_SQL}))
def i14_drop_durations(spark, d):
    """I14 on the same derived headers."""
    c = table(spark, d, "customer").select("c_custkey", _experience_text().alias("t"))
    return c.select(F.col("c_custkey").alias("user_id"), resume.drop_durations("t").alias("text"))


# ----------------------------------------------------------------- I15
@register("i15_filter_structs", W("""SELECT i.user_id, i.session_id,
  coalesce(array_to_string(list(v.nm ORDER BY i.action_dt, i.event_id) FILTER (WHERE length(v.nm) > 0), '|'), '') AS names,
  CAST(sum(len(list_filter(v.sk, lambda s: length(s) > 1 OR s = 'R'))) FILTER (WHERE length(v.nm) > 0) AS BIGINT) AS n_skills
FROM interaction i JOIN (SELECT p_partkey AS vacancy_id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS nm,
  [p_name, substr(p_type, 1, 1), CASE WHEN p_size % 7 = 0 THEN 'R' ELSE lower(p_type) END] AS sk FROM part) v
  ON v.vacancy_id = i.vacancy_id
GROUP BY i.user_id, i.session_id""", "interaction"))
def i15_filter_structs(spark, d):
    """Per session, job entries with a non-empty name; inside each, skills
    of one letter are dropped except 'R'."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("vacancy_id"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit("")).otherwise(F.col("p_name")).alias("nm"),
        F.array("p_name", F.substring("p_type", 1, 1),
                F.when(F.col("p_size") % 7 == 0, F.lit("R")).otherwise(F.lower("p_type"))).alias("sk"))
    i = fx.interaction(spark, d).join(p, "vacancy_id")
    s = i.groupBy("user_id", "session_id").agg(F.array_sort(F.collect_list(F.struct(
        seq.order_key().alias("k"), F.struct(F.col("nm").alias("name"), F.col("sk").alias("skills")).alias("job"))))
        .alias("jobs"))
    jobs = F.transform("jobs", lambda x: x["job"])
    kept = F.transform(F.filter(jobs, lambda j: F.length(j["name"]) > 0),
                       lambda j: j.withField("skills", F.filter(j["skills"], lambda k: (F.length(k) > 1) | (k == "R"))))
    out = s.select("user_id", "session_id", kept.alias("kept"))
    n_sk = F.aggregate("kept", F.lit(0).cast("bigint"), lambda acc, j: acc + F.size(j["skills"]))
    return out.select("user_id", "session_id",
                      F.array_join(F.transform("kept", lambda j: j["name"]), "|").alias("names"),
                      F.when(F.size("kept") > 0, n_sk).alias("n_skills"))


# ------------------------------------------------------------ I17-I20
@register("i17_parse_answer", W("""SELECT user_id, split_part(t, ';', 1) AS region, split_part(t, ';', 2) AS title,
  CAST(split_part(t, ';', 3) AS BIGINT) AS years
FROM (SELECT user_id, concat(area_id, ';', title, ';', CAST(experience_years AS VARCHAR)) AS t FROM request)""", "request"))
def i17_parse_answer(spark, d):
    r = fx.request(spark, d).select("user_id", F.concat_ws(";", "area_id", "title",
                                                          F.col("experience_years").cast("string")).alias("t"))
    region, title, years = resume.split_answer("t")
    return r.select("user_id", region.alias("region"), title.alias("title"), years.cast("bigint").alias("years"))


@register("i18_invert_multimap", """SELECT lower(p_type) AS role, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS areas
FROM part GROUP BY lower(p_type)""")
def i18_invert_multimap(spark, d):
    """Area -> roles (brand -> types) inverted to role -> areas."""
    p = table(spark, d, "part")
    area_roles = p.groupBy("p_brand").agg(F.collect_set(F.lower("p_type")).alias("roles"))
    inv = area_roles.select("p_brand", F.explode("roles").alias("role")) \
        .groupBy("role").agg(F.array_sort(F.collect_set("p_brand")).alias("areas"))
    return inv.select("role", F.array_join("areas", ",").alias("areas"))


def regions_of(docs, col):
    return trees.tree_leaves(docs, col).unionByName(trees.tree_roots(docs, col))


_CAT_SCHEMA = "id STRING, name STRING, roles ARRAY<STRUCT<id: STRING, name: STRING>>"


@register("i19_flatten_catalogue", """SELECT DISTINCT 'area' AS kind, p_brand AS a, concat('Area ', p_brand) AS b FROM part
UNION SELECT DISTINCT 'role', lower(p_type), concat('Role ', lower(p_type)) FROM part
UNION SELECT DISTINCT 'area_role', p_brand, lower(p_type) FROM part""")
def i19_flatten_catalogue(spark, d):
    """A category catalogue as JSON documents (one per area with its
    roles) flattened to (area, name), (role, name) and (area, role)."""
    p = table(spark, d, "part")
    docs = p.groupBy("p_brand").agg(F.to_json(F.struct(
        F.col("p_brand").alias("id"), F.concat(F.lit("Area "), F.col("p_brand")).alias("name"),
        F.collect_set(F.struct(F.lower("p_type").alias("id"), F.concat(F.lit("Role "), F.lower("p_type")).alias("name")))
        .alias("roles"))).alias("json"))
    j = docs.select(F.from_json("json", _CAT_SCHEMA).alias("c"))
    areas = j.select(F.lit("area").alias("kind"), F.col("c.id").alias("a"), F.col("c.name").alias("b"))
    roles = j.select(F.explode("c.roles").alias("r")).select(F.lit("role").alias("kind"), F.col("r.id").alias("a"),
                                                             F.col("r.name").alias("b"))
    links = j.select(F.col("c.id").alias("a"), F.explode("c.roles").alias("r")).select(
        F.lit("area_role").alias("kind"), "a", F.col("r.id").alias("b"))
    return areas.unionByName(roles).unionByName(links).distinct()


@register("i20_region_tree_leaves", """SELECT 0 AS leaf_id, 'World' AS name
UNION ALL SELECT 100 + n_nationkey AS leaf_id, n_name AS name FROM nation
UNION ALL SELECT r_regionkey AS leaf_id, r_name AS name FROM region
  WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""")
def i20_region_tree_leaves(spark, d):
    """A region tree (world -> regions -> nations) as nested JSON,
    flattened to leaf id -> name (plus the root)."""
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    regions = r.join(n.groupBy("n_regionkey").agg(F.collect_set(F.struct(
        (F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_name").alias("name"),
        F.array().cast("array<string>").alias("areas"))).alias("areas")),
        F.col("r_regionkey") == F.col("n_regionkey"), "left")
    docs = regions.select(F.to_json(F.struct(
        F.lit(0).cast("bigint").alias("id"), F.lit("World").alias("name"), F.array(F.struct(
            F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"),
            F.coalesce("areas", F.array()).alias("areas"))).alias("areas"))).alias("json"))
    return regions_of(docs, "json")


# ------------------------------------------------------------ I12, I16
def _resume_text(spark, d):
    """Resume-style experience text derived from customers and two parts:
    header, then two jobs with periods, titles and skills."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", _experience_text().alias("head"))
    p = table(spark, d, "part").select("p_partkey", "p_name", F.lower("p_type").alias("t"))
    a = p.select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("ta"), F.col("t").alias("sa"))
    b = p.select((F.col("p_partkey") - 1).alias("c_custkey"), F.col("p_name").alias("tb"), F.col("t").alias("sb"))
    months = F.array(*[F.lit(m) for m in resume.MONTHS])
    k = F.col("c_custkey")

    def month(off):
        return F.element_at(months, ((k + off) % 12 + 1).cast("int"))

    text = F.concat_ws(" ", F.col("head"),
                       month(0), (F.lit(2010) + k % 10).cast("string"), F.lit("—"), month(3),
                       (F.lit(2011) + k % 10).cast("string"), F.col("ta"), F.col("sa"),
                       month(5), (F.lit(2015) + k % 5).cast("string"), F.lit("— по настоящее время"),
                       F.col("tb"), F.col("sb"))
    return c.join(a, "c_custkey", "left").join(b, "c_custkey", "left").select(
        F.col("c_custkey").alias("user_id"), text.alias("resume"))


_MONTHS_SQL = "['" + "', '".join(resume.MONTHS) + "']"
_RESUME_CTES = {
    "txt": _EXP_TXT_SQL,
    "res": f"""SELECT c.c_custkey AS user_id, concat_ws(' ', c.t, {_MONTHS_SQL}[c.c_custkey % 12 + 1],
        CAST(2010 + c.c_custkey % 10 AS VARCHAR), '—', {_MONTHS_SQL}[(c.c_custkey + 3) % 12 + 1],
        CAST(2011 + c.c_custkey % 10 AS VARCHAR), a.p_name, lower(a.p_type), {_MONTHS_SQL}[(c.c_custkey + 5) % 12 + 1],
        CAST(2015 + c.c_custkey % 5 AS VARCHAR), '— по настоящее время', b.p_name, lower(b.p_type)) AS t
        FROM txt c LEFT JOIN part a ON a.p_partkey = c.c_custkey LEFT JOIN part b ON b.p_partkey = c.c_custkey + 1""",
    "rws": "SELECT *, list_filter(string_split(t, ' '), lambda w: w <> '') AS ws FROM res",
    "sts": f"""SELECT *, list_filter(range(1, len(ws) + 1), lambda i: list_contains({_MONTHS_SQL}, ws[i])
        AND ws[i + 2] = '—' AND regexp_full_match(ws[i + 1], '[0-9]{{4}}')) AS ss FROM rws""",
    "jbs": """SELECT *, list_filter(list_transform(range(1, len(ss) + 1), lambda n: array_to_string(
        ws[ss[n] + CASE WHEN ws[ss[n] + 3] = 'по' THEN 6 ELSE 5 END:coalesce(ss[n + 1], len(ws) + 1) - 1], ' ')),
        lambda x: x <> '') AS jobs FROM sts""",
}


@register("i12_resume_job_split", W("""SELECT user_id, array_to_string(jobs, '|') AS jobs,
  CAST(len(jobs) AS INTEGER) AS n_jobs FROM jbs""", extra=_RESUME_CTES))
def i12_resume_job_split(spark, d):
    """I12 on derived resume texts; hand-made Russian resumes are in the unit tests."""
    r = _resume_text(spark, d)
    jobs = resume.split_jobs("resume")
    return r.select("user_id", F.array_join(jobs, "|").alias("jobs"), F.size(jobs).alias("n_jobs"))


def _found_sql(entries: str) -> str:
    """Phrases of a dictionary in each piece, joined in order of appearance."""
    return f"""SELECT user_id, piece_no, array_to_string(list(phrase ORDER BY first_pos), '|') AS found FROM (
        SELECT user_id, piece_no, phrase, min(pos) AS first_pos FROM (
          SELECT user_id, piece_no, pos, arg_max(phrase, n) AS phrase FROM grams JOIN ({entries}) USING (phrase)
          GROUP BY user_id, piece_no, pos) GROUP BY user_id, piece_no, phrase) GROUP BY user_id, piece_no"""


_JOB_CTES = dict(_RESUME_CTES)
_JOB_CTES.update({k: v.replace("FROM txt", "FROM res") for k, v in _BLOCK_CTES.items() if k != "txt"})
_JOB_CTES.update({
    "pieces": "SELECT user_id, generate_subscripts(jobs, 1) - 1 AS piece_no, unnest(jobs) AS piece FROM jbs",
    "ptok": """SELECT user_id, piece_no, generate_subscripts(t, 1) AS pos, unnest(t) AS w FROM (
        SELECT user_id, piece_no, regexp_extract_all(lower(piece), '[\\p{L}\\p{N}_]+') AS t FROM pieces)""",
    "grams": """SELECT user_id, piece_no, pos, w AS phrase, 1 AS n FROM ptok
        UNION ALL SELECT a.user_id, a.piece_no, a.pos, a.w || ' ' || b.w, 2 FROM ptok a
          JOIN ptok b ON b.user_id = a.user_id AND b.piece_no = a.piece_no AND b.pos = a.pos + 1
        UNION ALL SELECT a.user_id, a.piece_no, a.pos, a.w || ' ' || b.w || ' ' || c.w, 3 FROM ptok a
          JOIN ptok b ON b.user_id = a.user_id AND b.piece_no = a.piece_no AND b.pos = a.pos + 1
          JOIN ptok c ON c.user_id = a.user_id AND c.piece_no = a.piece_no AND c.pos = a.pos + 2""",
    "fnames": _found_sql("SELECT DISTINCT lower(name) AS phrase FROM vacancy"),
    "fskills": _found_sql(_PHRASE_DICT_SQL),
})


@register("i16_job_structs", W("""SELECT p.user_id, CAST(p.piece_no AS INTEGER) AS piece_no, coalesce(n.found, '') AS names,
  coalesce(k.found, '') AS keyskills, c.c_acctbal AS salary,
  CASE WHEN months IS NULL THEN NULL WHEN ceil(months / 12.0) = 0 THEN 'noExperience'
       WHEN ceil(months / 12.0) < 3 THEN 'between1And3' WHEN ceil(months / 12.0) < 6 THEN 'between3And6'
       ELSE 'moreThan6' END AS workExperience, c.c_mktsegment AS employment
FROM pieces p JOIN customer c ON c.c_custkey = p.user_id JOIN mos ON mos.user_id = p.user_id
LEFT JOIN fnames n ON n.user_id = p.user_id AND n.piece_no = p.piece_no
LEFT JOIN fskills k ON k.user_id = p.user_id AND k.piece_no = p.piece_no""", "vacancy", extra=_JOB_CTES))
def i16_job_structs(spark, d):
    """I16 (Q21 fixed): per job piece a struct of the titles and skills found
    in it (dictionary phrases, in order), plus the resume-level salary,
    experience and employment."""
    r = _resume_text(spark, d).join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal", "c_mktsegment"),
        "user_id")
    pieces = r.select("user_id", "c_acctbal", "c_mktsegment", "resume",
                      F.posexplode(resume.split_jobs("resume")).alias("piece_no", "piece"))
    v = fx.vacancy(spark, d)
    names = v.select(F.lower("name").alias("phrase")).distinct()
    skills_vocab = v.select(F.explode("keySkills").alias("s")).select(F.lower("s").alias("phrase")).distinct()
    low = pieces.select("user_id", "piece_no", F.lower("piece").alias("t"))
    found_n = phrases.extract_phrases(low, ["user_id", "piece_no"], "t", names, "phrase") \
        .withColumnRenamed("phrases", "names")
    found_s = phrases.extract_phrases(low, ["user_id", "piece_no"], "t", skills_vocab, "phrase") \
        .withColumnRenamed("phrases", "keyskills")
    from jobsift.functions.codes import experience_from_months
    exp = experience_from_months(resume.experience_months(resume.experience_block("resume")))
    out = pieces.join(found_n, ["user_id", "piece_no"], "left").join(found_s, ["user_id", "piece_no"], "left")
    job = F.struct(F.coalesce("names", F.array().cast("array<string>")).alias("name"),
                   F.coalesce("keyskills", F.array().cast("array<string>")).alias("keyskills"),
                   F.col("c_acctbal").alias("salary"), exp.alias("workExperience"),
                   F.col("c_mktsegment").alias("employment"))
    return out.select("user_id", "piece_no", F.array_join(job["name"], "|").alias("names"),
                      F.array_join(job["keyskills"], "|").alias("keyskills"), job["salary"].alias("salary"),
                      job["workExperience"].alias("workExperience"), job["employment"].alias("employment"))
