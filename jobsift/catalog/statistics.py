"""Statistics (A8, A13-A15, E12), skill merging (N4-N6), item-neighbour
recommenders (R7, R8 with K5/E11, R10, R13) and remaining joins (J4, J11, L6)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.catalog.textsim import topk_sql
from jobsift.functions import codes
from jobsift.operators import encoders, skills, stats, tfidf
from jobsift.operators import sequences as seq
from jobsift.operators.sampling import top_k_per_group
from jobsift.sources import fixtures as fx
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


_ORD = {
    "experience_code": "CASE workExperience WHEN 'moreThan6' THEN 4 WHEN 'between3And6' THEN 3 WHEN 'between1And3' THEN 2 ELSE 1 END",
    "employment_code": "CASE employment WHEN 'full' THEN 5 WHEN 'part' THEN 4 WHEN 'project' THEN 3 WHEN 'probation' THEN 2 ELSE 1 END",
    "schedule_code": "CASE workSchedule WHEN 'fullDay' THEN 5 WHEN 'shift' THEN 4 WHEN 'remote' THEN 3 WHEN 'flexible' THEN 2 ELSE 1 END",
}


def _coded(spark, d):
    v = fx.vacancy(spark, d)
    return v.select("vacancy_id", "area_id", "compensation_from", "compensation_to",
                    codes.experience_ordinal("workExperience").alias("experience_code"),
                    codes.employment_ordinal("employment").alias("employment_code"),
                    codes.schedule_ordinal("workSchedule").alias("schedule_code"))


_CODED_SQL = ("SELECT vacancy_id, area_id, compensation_from, compensation_to, "
              + ", ".join(f"{v} AS {k}" for k, v in _ORD.items()) + " FROM vacancy")
_SP_COLS = ["compensation_from", "compensation_to", "experience_code", "employment_code"]


def _spearman_sql():
    parts = []
    for i, a in enumerate(_SP_COLS):
        for b in _SP_COLS[i + 1:]:
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS rho FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
  FROM coded WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return "\nUNION ALL ".join(parts)


@register("a13_spearman", W(_spearman_sql(), "vacancy", extra={"coded": _CODED_SQL}))
def a13_spearman(spark, d):
    out = stats.spearman(_coded(spark, d), _SP_COLS)
    return out.select("col_a", "col_b", r6("rho").alias("rho"))


_KT_COLS = ["experience_code", "employment_code", "schedule_code"]


def _kendall_sql():
    parts = []
    for i, a in enumerate(_KT_COLS):
        for b in _KT_COLS[i + 1:]:
            parts.append(f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(
  (SELECT sum(CASE WHEN r.y > l.y THEN l.c * r.c ELSE 0 END) - sum(CASE WHEN r.y < l.y THEN l.c * r.c ELSE 0 END)
   FROM cells_{a}_{b} l JOIN cells_{a}_{b} r ON l.x < r.x)
  / sqrt(((SELECT sum(c) FROM cells_{a}_{b}) * ((SELECT sum(c) FROM cells_{a}_{b}) - 1) / 2
          - (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells_{a}_{b} GROUP BY x)))
       * ((SELECT sum(c) FROM cells_{a}_{b}) * ((SELECT sum(c) FROM cells_{a}_{b}) - 1) / 2
          - (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells_{a}_{b} GROUP BY y)))), 6) AS tau_b""")
    return "\nUNION ALL ".join(parts)


def _kendall_ctes():
    ctes = {"coded": _CODED_SQL}
    for i, a in enumerate(_KT_COLS):
        for b in _KT_COLS[i + 1:]:
            ctes[f"cells_{a}_{b}"] = (f"SELECT {a} AS x, {b} AS y, count(*) AS c FROM coded "
                                      f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2")
    return ctes


@register("a14_kendall_tau_b", W(_kendall_sql(), "vacancy", extra=_kendall_ctes()))
def a14_kendall_tau_b(spark, d):
    out = stats.kendall_tau_b(_coded(spark, d), _KT_COLS)
    return out.select("col_a", "col_b", r6("tau_b").alias("tau_b"))


@register("e12_minmax_per_group", W("""SELECT vacancy_id, round(CASE WHEN max(s) OVER w = min(s) OVER w THEN 0.0
  ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 6) AS scaled
FROM (SELECT vacancy_id, area_id, coalesce(compensation_from, 100000.0) AS s FROM vacancy)
WINDOW w AS (PARTITION BY area_id)""", "vacancy"))
def e12_minmax_per_group(spark, d):
    """Salary min-max scaled inside each area (constant group -> 0)."""
    v = fx.vacancy(spark, d).withColumn("s", F.coalesce("compensation_from", F.lit(100000.0)))
    return encoders.minmax_scale(v, "s", ["area_id"]).select("vacancy_id", r6("scaled").alias("scaled"))


# ---------------------------------------------------------------- skills
_SKILL_CNT_SQL = "SELECT skill, count(*) AS cnt FROM (SELECT unnest(keySkills) AS skill FROM vacancy) GROUP BY skill HAVING count(*) >= 10"


@register("n4_skill_neighbours", W("""SELECT qid AS skill, cid AS neighbour, round(score, 6) AS score,
  CAST(rank AS BIGINT) AS rank FROM topk""", "vacancy", extra=dict(
    {"sc0": _SKILL_CNT_SQL},
    **topk_sql("SELECT 0 AS scope, skill AS cid, skill AS text FROM sc0",
               "SELECT 0 AS scope, skill AS qid, skill AS text FROM sc0", 15))))
def n4_skill_neighbours(spark, d):
    """15 nearest skills of each frequent skill (TF-IDF cosine)."""
    counts = skills.skill_counts(fx.vacancy(spark, d))
    out = skills.skill_neighbours(counts, 15)
    return out.select("skill", "neighbour", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _renamed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    """The same CTEs under other names."""
    names = re.compile(r"\b(" + "|".join(ctes) + r")\b")
    return {prefix + k: names.sub(lambda m: prefix + m.group(1), v) for k, v in ctes.items()}


def _election_sql(n: int, counts: str, topk: str, threshold: float) -> dict[str, str]:
    """N5's round in order of rank: a skill follows the first leader that has it
    among its nearest, else leads; the leaders so far are the recursion's state."""
    return {
        f"prio{n}": f"SELECT skill, row_number() OVER (ORDER BY cnt DESC, skill) AS r FROM {counts}",
        f"inc{n}": f"""SELECT p.r, list(a.r ORDER BY a.r) FILTER (WHERE a.r IS NOT NULL) AS s FROM prio{n} p
            LEFT JOIN (SELECT * FROM {topk} WHERE 1 - score <= {threshold}) t ON t.cid = p.skill
            LEFT JOIN prio{n} a ON a.skill = t.qid AND a.r < p.r GROUP BY p.r""",
        f"rec{n}": f"""SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders, CAST(0 AS BIGINT) AS owner
            UNION ALL SELECT i + 1, CASE WHEN b IS NULL THEN list_append(leaders, i + 1) ELSE leaders END, coalesce(b, i + 1)
            FROM (SELECT x.i, x.leaders, list_filter(inc{n}.s, lambda y: list_contains(x.leaders, y))[1] AS b
                  FROM rec{n} x JOIN inc{n} ON inc{n}.r = x.i + 1)""",
        f"map{n}": f"""SELECT p.skill, l.skill AS leader FROM rec{n} JOIN prio{n} p ON p.r = i JOIN prio{n} l ON l.r = owner""",
    }


_MERGE = {"sc0": _SKILL_CNT_SQL}
_MERGE.update(_renamed(topk_sql("SELECT 0 AS scope, skill AS cid, skill AS text FROM sc0",
                                "SELECT 0 AS scope, skill AS qid, skill AS text FROM sc0", 15), "one_"))
_MERGE.update(_election_sql(1, "sc0", "one_topk", 0.5))
_MERGE["sc1"] = "SELECT sc0.skill, cnt FROM sc0 JOIN map1 ON map1.skill = sc0.skill AND map1.leader = sc0.skill"
_MERGE.update(_renamed(topk_sql("SELECT 0 AS scope, skill AS cid, skill AS text FROM sc1",
                                "SELECT 0 AS scope, skill AS qid, skill AS text FROM sc1", 15), "two_"))
_MERGE.update(_election_sql(2, "sc1", "two_topk", 0.65))
_MERGE["merged"] = "SELECT map1.skill, coalesce(map2.leader, map1.leader) AS leader FROM map1 LEFT JOIN map2 ON map2.skill = map1.leader"


def MW(sql: str) -> str:
    return W(sql, "vacancy", extra=_MERGE).replace("WITH ", "WITH RECURSIVE ", 1)


@register("n5_skill_merging", MW("SELECT skill, leader FROM merged"))
def n5_skill_merging(spark, d):
    """Skill -> leader after the two merge rounds."""
    return skills.merge_skills(fx.vacancy(spark, d))


@register("n6_replace_skills", MW("""SELECT v.vacancy_id, CASE WHEN any_value(v.keySkills) IS NOT NULL THEN
  coalesce(array_to_string(list(m.leader ORDER BY e.pos) FILTER (WHERE m.leader IS NOT NULL), '|'), '') END AS keySkills
FROM vacancy v LEFT JOIN (SELECT vacancy_id, unnest(keySkills) AS skill, generate_subscripts(keySkills, 1) AS pos FROM vacancy) e
  ON e.vacancy_id = v.vacancy_id LEFT JOIN merged m ON m.skill = e.skill GROUP BY v.vacancy_id"""))
def n6_replace_skills(spark, d):
    """Vacancy skills replaced by their leaders."""
    v = fx.vacancy(spark, d)
    m = skills.merge_skills(v)
    out = skills.replace_skills(v, "vacancy_id", "keySkills", m)
    return out.select("vacancy_id", F.array_join("keySkills", "|").alias("keySkills"))


@register("a15_vocabulary_reduction", MW("""SELECT CAST(count(DISTINCT leader) AS BIGINT) AS n_leaders,
  CAST(sum(CASE WHEN skill <> leader THEN 1 ELSE 0 END) AS BIGINT) AS n_merged FROM merged"""))
def a15_vocabulary_reduction(spark, d):
    """Leaders and merged skills after N5."""
    return skills.reduction_totals(skills.merge_skills(fx.vacancy(spark, d)))


# ------------------------------------------------------------ R7, A8, R10
def _liked(spark, d):
    i = fx.interaction(spark, d).filter("is_train AND action_type IN (1, 3)")
    return i.select("user_id", "vacancy_id").distinct()


def _area_neighbours(spark, d, queries, k, k_col=None):
    v = fx.vacancy(spark, d).filter(F.col("keySkills_str").isNotNull())
    docs = v.select("area_id", "vacancy_id", F.col("keySkills_str").alias("text"))
    q = queries.join(docs.withColumnRenamed("vacancy_id", "query_id"), "query_id")
    return tfidf.tfidf_top_k(q, docs, k, scope=["area_id"], k_col=k_col)


_R7_CTES = topk_sql(
    "SELECT area_id AS scope, vacancy_id AS cid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL",
    """SELECT area_id AS scope, vacancy_id AS qid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL
       AND vacancy_id IN (SELECT vacancy_id FROM interaction WHERE is_train AND action_type IN (1, 3))""", 5)


@register("r7_per_like_knn", W("""SELECT l.user_id, l.vacancy_id AS liked_id, t.cid AS vacancy_id, CAST(t.rank AS BIGINT) AS rank
FROM (SELECT DISTINCT user_id, vacancy_id FROM interaction WHERE is_train AND action_type IN (1, 3)) l
JOIN topk t ON t.qid = l.vacancy_id""", "vacancy", "interaction", extra=_R7_CTES))
def r7_per_like_knn(spark, d):
    """The 5 nearest vacancies (itself included) of every liked or
    responded vacancy, inside its area; scored once per distinct item."""
    liked = _liked(spark, d)
    nn = _area_neighbours(spark, d, liked.select(F.col("vacancy_id").alias("query_id")).distinct(), 5)
    return liked.join(nn.withColumnRenamed("vacancy_id", "nb").withColumnRenamed("query_id", "vacancy_id"),
                      "vacancy_id").select("user_id", F.col("vacancy_id").alias("liked_id"),
                                           F.col("nb").alias("vacancy_id"), F.col("rank").cast("bigint"))


@register("a8_collect_neighbours", W("""SELECT qid AS query_id, array_to_string(list(cid ORDER BY rank), ',') AS neighbours
FROM topk GROUP BY qid""", "vacancy", "interaction", extra=_R7_CTES))
def a8_collect_neighbours(spark, d):
    """Ordered neighbour list per item (bounded by k)."""
    nn = _area_neighbours(spark, d, _liked(spark, d).select(F.col("vacancy_id").alias("query_id")).distinct(), 5)
    g = nn.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vacancy_id"))).alias("s"))
    return g.select("query_id", F.array_join(F.transform("s", lambda x: x["vacancy_id"]), ",").alias("neighbours"))


_R10_CTES = dict(topk_sql(
    "SELECT area_id AS scope, vacancy_id AS cid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL",
    """SELECT area_id AS scope, vacancy_id AS qid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL
       AND vacancy_id IN (SELECT vacancy_id FROM interaction WHERE is_train AND action_type <> 2)""", 5))
_R10_CTES.update({
    "acts": """SELECT user_id, vacancy_id, row_number() OVER (PARTITION BY user_id ORDER BY action_dt, event_id) AS apos
        FROM interaction WHERE is_train AND action_type <> 2""",
    "lst": """SELECT a.user_id, t.cid AS vacancy_id, a.apos, t.rank AS nrank,
        row_number() OVER (PARTITION BY a.user_id ORDER BY a.apos, t.rank) AS pos FROM acts a JOIN topk t ON t.qid = a.vacancy_id""",
    "tot": "SELECT user_id, count(*) AS n FROM lst GROUP BY user_id",
    "votes": """SELECT user_id, vacancy_id, count(*) AS c, min(pos) AS first_pos FROM lst GROUP BY user_id, vacancy_id""",
})


@register("r10_neighbour_voting", W("""SELECT user_id, CAST(rank AS BIGINT) AS rank, vacancy_id FROM (
  SELECT user_id, vacancy_id, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, first_pos) AS rank
  FROM votes) WHERE rank <= 30""", "vacancy", "interaction", extra=_R10_CTES))
def r10_neighbour_voting(spark, d):
    """R10 + L3: the neighbours of every non-view train action vote; the 30
    most frequent stay (ties by first occurrence), whatever a user's history."""
    acts = fx.interaction(spark, d).filter("is_train AND action_type <> 2") \
        .select("user_id", "vacancy_id", seq.order_key().alias("ak"))
    nn = _area_neighbours(spark, d, acts.select(F.col("vacancy_id").alias("query_id")).distinct(), 5)
    votes = acts.join(nn.select(F.col("query_id").alias("vacancy_id"), F.col("vacancy_id").alias("nb"), "rank"),
                      "vacancy_id").groupBy("user_id", F.col("nb").alias("vacancy_id")).agg(
        F.count("*").alias("c"), F.min(F.struct("ak", "rank")).alias("first"))
    top = top_k_per_group(votes, ["user_id"], [F.col("c").desc(), F.col("first")], 30, "rank")
    return top.select("user_id", F.col("rank").cast("bigint"), "vacancy_id")


# ------------------------------------------------------------ R8
_CAT_COLS = ["workExperience", "workSchedule", "employment"]
# Text neighbours per liked item of users with few and more of them.
LIGHT, LIGHT_K, HEAVY_K = 2, 50, 20


def mismatch_weight(prefix_a: str, prefix_b: str, cols=_CAT_COLS):
    """One-hot hamming numerator: 2 when both values exist and
    differ, 1 when exactly one side is null (Q36), 0 when equal."""
    total = None
    for c in cols:
        a, b = F.col(f"{prefix_a}{c}"), F.col(f"{prefix_b}{c}")
        w = (F.when(a.isNull() & b.isNull(), 0).when(a.isNull() | b.isNull(), 1)
             .when(a == b, 0).otherwise(2))
        total = w if total is None else total + w
    return total


@register("r8_two_stage_knn", W("""
, liked AS (SELECT DISTINCT i.user_id, i.vacancy_id FROM interaction i JOIN vacancy v ON v.vacancy_id = i.vacancy_id
            WHERE i.is_train AND i.action_type IN (1, 3) AND v.keySkills_str IS NOT NULL),
hist AS (SELECT user_id, CASE WHEN count(*) <= 2 THEN 50 ELSE 20 END AS k FROM liked GROUP BY user_id),
pool AS (SELECT DISTINCT l.user_id, t.cid AS vacancy_id FROM liked l JOIN hist USING (user_id)
         JOIN topk t ON t.qid = l.vacancy_id AND t.rank <= hist.k),
msc AS (SELECT l.user_id, l.vacancy_id AS liked_id, p.vacancy_id,
  (CASE WHEN a.workExperience = b.workExperience THEN 0 ELSE 2 END + CASE WHEN a.workSchedule = b.workSchedule THEN 0 ELSE 2 END
   + CASE WHEN a.employment = b.employment THEN 0 ELSE 2 END) AS w
  FROM liked l JOIN pool p ON p.user_id = l.user_id JOIN vacancy a ON a.vacancy_id = l.vacancy_id
  JOIN vacancy b ON b.vacancy_id = p.vacancy_id)
SELECT user_id, liked_id, vacancy_id, CAST(w AS INTEGER) AS weight, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, liked_id ORDER BY w, vacancy_id) AS rank FROM msc) WHERE rank <= 10
""", "vacancy", "interaction", extra=topk_sql(
    "SELECT area_id AS scope, vacancy_id AS cid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL",
    """SELECT area_id AS scope, vacancy_id AS qid, keySkills_str AS text FROM vacancy WHERE keySkills_str IS NOT NULL
       AND vacancy_id IN (SELECT vacancy_id FROM interaction WHERE is_train AND action_type IN (1, 3))""", 50)
).replace("\n\n, liked AS", ", liked AS", 1))
def r8_two_stage_knn(spark, d):
    """Stage 1 pools each user's text neighbours, 20 per liked item and 50 for
    users with at most two of them; stage 2 ranks the pool for every liked item by
    categorical mismatch (K5), 10 per item.

    Stage 2 never pairs every liked item with every pool item: the pool is
    reduced to categorical classes (at most the product of the category
    sizes) holding their 10 lowest ids, and liked items meet classes only.
    """
    v = fx.vacancy(spark, d)
    liked = _liked(spark, d).join(v.filter(F.col("keySkills_str").isNotNull()).select("vacancy_id"), "vacancy_id")
    size = liked.groupBy("user_id").agg(F.when(F.count("*") <= LIGHT, LIGHT_K).otherwise(HEAVY_K).alias("k"))
    wanted = liked.join(size, "user_id")
    asked = wanted.groupBy(F.col("vacancy_id").alias("query_id")).agg(F.max("k").alias("k"))
    nn = _area_neighbours(spark, d, asked, LIGHT_K, "k")
    pool = wanted.join(nn.select(F.col("query_id").alias("vacancy_id"), F.col("vacancy_id").alias("nb"), "rank"), "vacancy_id") \
        .filter(F.col("rank") <= F.col("k")).select("user_id", F.col("nb").alias("vacancy_id")).distinct()
    cats = v.select("vacancy_id", *_CAT_COLS)
    pc = pool.join(cats, "vacancy_id")
    cls = top_k_per_group(pc, ["user_id", *_CAT_COLS], [F.col("vacancy_id")], 10, "__r") \
        .select("user_id", "vacancy_id", *[F.col(c).alias(f"p_{c}") for c in _CAT_COLS])
    lk = liked.join(cats.select("vacancy_id", *[F.col(c).alias(f"l_{c}") for c in _CAT_COLS]), "vacancy_id") \
        .withColumnRenamed("vacancy_id", "liked_id")
    sc = lk.join(cls, "user_id").withColumn("weight", mismatch_weight("l_", "p_"))
    top = top_k_per_group(sc, ["user_id", "liked_id"], [F.col("weight"), F.col("vacancy_id")], 10, "rank")
    return top.select("user_id", "liked_id", "vacancy_id", F.col("weight").cast("int"), F.col("rank").cast("bigint"))


# ------------------------------------------------------------------ R13
@register("r13_entry_dispatch", W("""SELECT c.c_custkey AS user_id,
  CASE WHEN s.session_id IS NULL THEN 'initial' ELSE 'next' END AS branch, s.session_id
FROM customer c LEFT JOIN (SELECT user_id, session_id FROM (SELECT user_id, session_id, row_number() OVER
  (PARTITION BY user_id ORDER BY action_dt DESC, session_id DESC) AS rn FROM interaction) WHERE rn = 1) s
  ON s.user_id = c.c_custkey""", "interaction"))
def r13_entry_dispatch(spark, d):
    """Users with a session go to the next-step recommender with their
    latest session; the others to the initial recommender."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    latest = seq.latest_session(fx.interaction(spark, d)).select("user_id", "session_id")
    j = users.join(latest, "user_id", "left")
    return j.select("user_id", F.when(F.col("session_id").isNull(), "initial").otherwise("next").alias("branch"),
                    "session_id")


# ------------------------------------------------------------ J4, J11, L6
@register("j4_anti_join", """SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)""")
def j4_anti_join(spark, d):
    """Corpus documents that do not equal any benchmark passage."""
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "benchmark").select("text").distinct(), "text", "left_anti").select("doc_id")


@register("j11_incremental_enrichment", """SELECT p_partkey AS vacancy_id,
  coalesce(CASE l.quality WHEN 1 THEN 'checked' WHEN 0 THEN 'rejected' END, lower(p_type)) AS code,
  CASE WHEN l.doc_id IS NULL THEN 'fetched' ELSE 'stored' END AS source
FROM part LEFT JOIN labels l ON l.doc_id = p_partkey
WHERE coalesce(CASE l.quality WHEN 1 THEN 'checked' WHEN 0 THEN 'rejected' END, lower(p_type)) IS NOT NULL""")
def j11_incremental_enrichment(spark, d):
    """Ids already processed (the labels store) are skipped; the rest
    get a code from the lookup source (the part's type); codes are merged
    onto the rows and rows without a code are dropped."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("vacancy_id"), "p_type")
    store = table(spark, d, "labels").select(
        F.col("doc_id").alias("vacancy_id"),
        F.when(F.col("quality") == 1, "checked").when(F.col("quality") == 0, "rejected").alias("stored_code"))
    todo = part.join(store, "vacancy_id", "left_anti")
    fetched = todo.select("vacancy_id", F.lower("p_type").alias("fetched_code"))
    merged = part.select("vacancy_id").join(store, "vacancy_id", "left").join(fetched, "vacancy_id", "left")
    out = merged.select("vacancy_id", F.coalesce("stored_code", "fetched_code").alias("code"),
                        F.when(F.col("stored_code").isNotNull() | F.col("fetched_code").isNull(), "stored")
                        .otherwise("fetched").alias("source"))
    return out.dropna(subset=["code"])


@register("l6_shuffle_cap", W("""SELECT area_id, vacancy_id FROM (SELECT area_id, vacancy_id, row_number() OVER
  (PARTITION BY area_id ORDER BY md5(concat('42', CAST(vacancy_id AS VARCHAR))), vacancy_id) AS r FROM vacancy) WHERE r <= 20""",
                              "vacancy"))
def l6_shuffle_cap(spark, d):
    """A reproducible random cap of 20 vacancies per area."""
    v = fx.vacancy(spark, d)
    key = F.md5(F.concat(F.lit("42"), F.col("vacancy_id").cast("string")))
    return top_k_per_group(v, ["area_id"], [key, F.col("vacancy_id")], 20, "__r").select("area_id", "vacancy_id")


@register("i23_flatten_nested_predictions", W("""SELECT DISTINCT l.user_id, t.cid AS vacancy_id
FROM (SELECT DISTINCT user_id, vacancy_id FROM interaction WHERE is_train AND action_type IN (1, 3)) l
JOIN topk t ON t.qid = l.vacancy_id""", "vacancy", "interaction", extra=_R7_CTES))
def i23_flatten_nested_predictions(spark, d):
    """Legacy nested predictions {liked id: [neighbour ids]} stored as
    JSON per (user, liked item), flattened back to distinct (user, vacancy)."""
    liked = _liked(spark, d)
    nn = _area_neighbours(spark, d, liked.select(F.col("vacancy_id").alias("query_id")).distinct(), 5)
    lists = nn.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vacancy_id"))).alias("s"))
    docs = liked.join(lists.withColumnRenamed("query_id", "vacancy_id"), "vacancy_id").select(
        "user_id", F.to_json(F.create_map(F.col("vacancy_id").cast("string"),
                                          F.transform("s", lambda x: x["vacancy_id"]))).alias("json"))
    parsed = docs.select("user_id", F.explode(F.from_json("json", "map<string, array<bigint>>")).alias("k", "ids"))
    return parsed.select("user_id", F.explode("ids").alias("vacancy_id")).distinct()
