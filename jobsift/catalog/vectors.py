"""Dense-vector queries on the ``embeddings`` table (K1, K4, K6, K7, K9,
K10, V12-V14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.basic import _PARTS_SQL
from jobsift.catalog.evaluation import EVAL_CTES, predictions
from jobsift.catalog.sqlviews import with_views as W
from jobsift.functions import codes
from jobsift.functions.titles import clean_title
from jobsift.operators import vectors as vx
from jobsift.sources import fixtures as fx
from jobsift.sources import io
from jobsift.sources.embeddings import EmbeddingStore
from jobsift.sources.tables import table


def r6(c):
    return F.round(c, 6)


NV = {"nv": """SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]),
    lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings"""}


def _pairs_sql(k: int, desc: bool, exclude_self: bool) -> str:
    order = "DESC" if desc else "ASC"
    cond = "WHERE a.vec_id <> b.vec_id" if exclude_self else ""
    return f"""SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS cid, list_inner_product(a.v, b.v) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) {order}, b.vec_id) AS rank
    FROM nv a, nv b {cond}) WHERE rank <= {k}"""


@register("k1_dense_top_k", W(f"""SELECT qid AS query_id, cid AS vacancy_id, round(score, 6) AS score,
  CAST(rank AS BIGINT) AS rank FROM ({_pairs_sql(50, True, False)})""", extra=NV))
def k1_dense_top_k(spark, d):
    v = fx.vectors(spark, d)
    out = vx.dense_top_k(v.withColumnRenamed("vacancy_id", "query_id"), v, 50)
    return out.select("query_id", "vacancy_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("k4_farthest_k", W(f"""SELECT qid AS query_id, cid AS vacancy_id, round(score, 6) AS score,
  CAST(rank AS BIGINT) AS rank FROM ({_pairs_sql(50, False, True)})""", extra=NV))
def k4_farthest_k(spark, d):
    """K4 with the ids corrected (Q7): the 50 least similar, self excluded."""
    v = fx.vectors(spark, d)
    out = vx.dense_top_k(v.withColumnRenamed("vacancy_id", "query_id"), v, 50, largest=False, exclude_self=True)
    return out.select("query_id", "vacancy_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


_V12 = dict(NV)
_V12["top"] = _pairs_sql(100, True, True)
_V12["hits"] = """SELECT t.qid, min(t.rank) AS first_hit, count(*) FILTER (WHERE t.rank <= 1) AS h1,
    count(*) FILTER (WHERE t.rank <= 10) AS h10, count(*) AS h100
    FROM top t JOIN nv q ON q.vec_id = t.qid JOIN nv c ON c.vec_id = t.cid WHERE q.label = c.label GROUP BY t.qid"""
_V12["npos"] = "SELECT vec_id AS qid, count(*) OVER (PARTITION BY label) - 1 AS n_pos FROM nv"


@register("v12_v13_retrieval_metrics", W("""SELECT
  round(avg(CASE WHEN first_hit <= 1 THEN 1.0 / first_hit ELSE 0.0 END), 6) AS mrr_1,
  round(avg(CASE WHEN first_hit <= 10 THEN 1.0 / first_hit ELSE 0.0 END), 6) AS mrr_10,
  round(avg(CASE WHEN first_hit <= 100 THEN 1.0 / first_hit ELSE 0.0 END), 6) AS mrr_100,
  round(avg(coalesce(h1, 0) / n_pos), 6) AS recall_1, round(avg(coalesce(h10, 0) / n_pos), 6) AS recall_10,
  round(avg(coalesce(h100, 0) / n_pos), 6) AS recall_100
FROM npos LEFT JOIN hits USING (qid) WHERE n_pos > 0""", extra=_V12))
def v12_v13_retrieval_metrics(spark, d):
    """MRR@{1,10,100} and Recall@{1,10,100}: same-label vectors are the
    positives of each query (self excluded)."""
    v = fx.vectors(spark, d)
    top = vx.dense_top_k(v.withColumnRenamed("vacancy_id", "query_id"), v, 100, exclude_self=True)
    lab = v.select("vacancy_id", "label")
    hits = (top.join(lab.withColumnRenamed("vacancy_id", "query_id").withColumnRenamed("label", "ql"), "query_id")
            .join(lab.withColumnRenamed("label", "cl"), "vacancy_id")
            .filter(F.col("ql") == F.col("cl"))
            .groupBy("query_id").agg(F.min("rank").alias("first_hit"),
                                     F.count(F.when(F.col("rank") <= 1, 1)).alias("h1"),
                                     F.count(F.when(F.col("rank") <= 10, 1)).alias("h10"),
                                     F.count("*").alias("h100")))
    npos = lab.join(lab.groupBy("label").agg((F.count("*") - 1).alias("n_pos")), "label") \
        .select(F.col("vacancy_id").alias("query_id"), "n_pos").filter("n_pos > 0")
    j = npos.join(hits, "query_id", "left")

    def mrr(c):
        return r6(F.avg(F.when(F.col("first_hit") <= c, 1.0 / F.col("first_hit")).otherwise(0.0))).alias(f"mrr_{c}")

    def rec(h, c):
        return r6(F.avg(F.coalesce(F.col(h), F.lit(0)) / F.col("n_pos"))).alias(f"recall_{c}")

    return j.agg(mrr(1), mrr(10), mrr(100), rec("h1", 1), rec("h10", 10), rec("h100", 100))


_V14 = dict(NV)
_V14["rk"] = "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM nv"
_V14["fl"] = """SELECT label, min(vec_id) FILTER (WHERE r = 1) AS first_id, min(vec_id) FILTER (WHERE r = 2) AS second_id
    FROM rk GROUP BY label"""
_V14["trip"] = """SELECT q.vec_id, CASE WHEN q.vec_id = f.first_id THEN f.second_id ELSE f.first_id END AS p1,
    c.first_id AS p2, n.first_id AS p3 FROM nv q JOIN fl f ON f.label = q.label
    JOIN fl c ON c.label = (q.label + 1) % 10 JOIN fl n ON n.label = (q.label + 5) % 10"""


@register("v14_triplet_accuracy", W("""SELECT CAST(count(*) AS BIGINT) AS n_triplets,
  round(avg(CASE WHEN s1 > s2 AND s2 > s3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (
  SELECT list_inner_product(q.v, a.v) AS s1, list_inner_product(q.v, b.v) AS s2, list_inner_product(q.v, c.v) AS s3
  FROM trip t JOIN nv q ON q.vec_id = t.vec_id JOIN nv a ON a.vec_id = t.p1 JOIN nv b ON b.vec_id = t.p2
  JOIN nv c ON c.vec_id = t.p3)""", extra=_V14))
def v14_triplet_accuracy(spark, d):
    """V14 (Q14 fixed): share of triplets with sim(q, same label) > sim(q,
    next label) > sim(q, label + 5); partners are the lowest ids of each label."""
    v = fx.vectors(spark, d).select("vacancy_id", "label", vx.l2_normalise("vec").alias("v"))
    first = v.groupBy("label").agg(F.min("vacancy_id").alias("first_id"))
    second = v.join(first, "label").filter(F.col("vacancy_id") > F.col("first_id")) \
        .groupBy("label").agg(F.min("vacancy_id").alias("second_id"))
    fl = first.join(second, "label", "left")
    q = v.join(fl, "label").select(
        "vacancy_id", "label", "v",
        F.when(F.col("vacancy_id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id")).alias("p1"))
    q = (q.join(fl.select(F.col("label").alias("l2"), F.col("first_id").alias("p2")), F.col("l2") == (F.col("label") + 1) % 10)
         .join(fl.select(F.col("label").alias("l3"), F.col("first_id").alias("p3")), F.col("l3") == (F.col("label") + 5) % 10))
    vv = v.select("vacancy_id", "v")
    for p, s in (("p1", "s1"), ("p2", "s2"), ("p3", "s3")):
        q = q.join(vv.select(F.col("vacancy_id").alias(p), F.col("v").alias(f"{p}v")), p) \
            .withColumn(s, vx.dot("v", f"{p}v"))
    ok = (F.col("s1") > F.col("s2")) & (F.col("s2") > F.col("s3"))
    return q.agg(F.count("*").alias("n_triplets"), r6(F.avg(F.when(ok, 1.0).otherwise(0.0))).alias("accuracy"))


_K9 = dict(EVAL_CTES)
_K9.update(NV)


@register("k9_mean_history_similarity", W("""SELECT p.user_id, p.vacancy_id,
  round(coalesce(avg(list_inner_product(cv.v, hv.v)), 0), 6) AS mean_sim
FROM (SELECT DISTINCT user_id, vacancy_id FROM pred) p LEFT JOIN nv cv ON cv.vec_id = p.vacancy_id
LEFT JOIN (SELECT user_id, vacancy_id, row_number() OVER (PARTITION BY user_id, vacancy_id ORDER BY action_dt, event_id) AS nth
           FROM interaction WHERE is_train AND action_type <> 2) h
  ON h.user_id = p.user_id AND (h.vacancy_id <> p.vacancy_id OR h.nth > 1)
LEFT JOIN nv hv ON hv.vec_id = h.vacancy_id
GROUP BY p.user_id, p.vacancy_id""", "vacancy", "interaction", extra=_K9))
def k9_mean_history_similarity(spark, d):
    pred = predictions(spark, d)
    hist = fx.interaction(spark, d).filter("is_train AND action_type <> 2")
    out = vx.mean_similarity_to_history(pred, hist, fx.vectors(spark, d))
    return out.select("user_id", "vacancy_id", r6("mean_sim").alias("mean_sim"))


@register("k10_texts_to_embed", """SELECT md5(text) AS text_hash, CAST(count(*) AS BIGINT) AS n_rows FROM documents
WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(d.text) FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
                                            WHERE d.text IS NOT NULL)
GROUP BY md5(text)""")
def k10_texts_to_embed(spark, d):
    docs = table(spark, d, "documents")
    stored = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id") \
        .filter(F.col("text").isNotNull()).select(F.md5("text").alias("text_hash"))
    return vx.texts_to_embed(docs.select("text"), stored)


@register("k10_embedding_store", W(f"""
, title AS (SELECT DISTINCT ({_PARTS_SQL})[1] AS t FROM vacancy),
asked AS (SELECT DISTINCT title AS t FROM request),
run1 AS (SELECT t FROM title WHERE t IS NOT NULL),
run2 AS (SELECT t FROM run1 UNION SELECT t FROM asked WHERE t IS NOT NULL)
SELECT 1 AS run, (SELECT count(*) FROM run1) AS n_texts, (SELECT count(*) FROM run1) AS n_encoded, (SELECT count(*) FROM run1) AS n_stored
UNION ALL SELECT 2, (SELECT count(*) FROM run2), (SELECT count(*) FROM run2) - (SELECT count(*) FROM run1), (SELECT count(*) FROM run2)
UNION ALL SELECT 3, (SELECT count(*) FROM run2), 0, (SELECT count(*) FROM run2)""", "vacancy", "request").replace(
    "\n\n, title AS", ", title AS", 1))
def k10_embedding_store(spark, d):
    """Three runs against one store: the catalogue's titles, those and the
    requests' titles, the same again, which encodes nothing."""
    store = EmbeddingStore(spark, io.scratch_path(spark, "k10"))
    titles = fx.vacancy(spark, d).select(clean_title("name_raw").alias("t"))
    both = titles.union(fx.request(spark, d).select("title"))
    rows = []
    for run, texts in enumerate((titles, both, both), 1):
        n = texts.filter("t IS NOT NULL").distinct().count()
        rows.append((run, n, store.update(texts, "t", prefix="query: "), store.load().count()))
    return spark.createDataFrame(rows, "run int, n_texts long, n_encoded long, n_stored long")


@register("k6_lsh_top_k")
def k6_lsh_top_k(spark, d):
    """K6: approximate top-10 by LSH + exact re-rank (rows-only check;
    recall against K1 is tested in tests/)."""
    v = fx.vectors(spark, d)
    out = vx.lsh_top_k(v.withColumnRenamed("vacancy_id", "query_id"), v, 10)
    return out.select("query_id", "vacancy_id", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("k7_kmeans_e13_features")
def k7_kmeans_e13_features(spark, d):
    """E13 + K7: vector components plus clustering codes (null -> 0), k-means
    with k=10; labels are not comparable across libraries (rows-only)."""
    from pyspark.ml.functions import array_to_vector
    v = fx.vectors(spark, d)
    cat = fx.vacancy(spark, d).select("vacancy_id", *codes.cluster_codes("workExperience", "workSchedule", "employment"))
    feats = v.join(cat, "vacancy_id", "left").select(
        "vacancy_id", array_to_vector(F.col("vec").cast("array<double>")).alias("emb"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
          for c in ["experience_code", "schedule_code", "employment_code"]])
    return vx.kmeans_labels(feats, ["emb", "experience_code", "schedule_code", "employment_code"], 10)
