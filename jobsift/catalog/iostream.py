"""File sources/sinks round trips (S1-S4, S7-S12) and the streaming session
fold (T1).  Each query writes data derived from the supplied tables to a
fresh scratch folder under the shared checkpoint folder and scans it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobsift.catalog import register
from jobsift.catalog.sqlviews import with_views as W
from jobsift.sources import fixtures as fx
from jobsift.sources import io
from jobsift.sources.tables import table
from jobsift.streaming import sessions


@register("s1_csv_scan", W("SELECT vacancy_id, name, area_id, compensation_from FROM vacancy", "vacancy"))
def s1_csv_scan(spark, d):
    path = io.scratch_path(spark, "s1")
    v = fx.vacancy(spark, d).select("vacancy_id", "name", "area_id", "compensation_from")
    io.write_csv(v, path, with_index="vacancy_id")
    return io.read_csv(spark, path, "`Unnamed: 0` BIGINT, vacancy_id BIGINT, name STRING, area_id STRING, "
                                    "compensation_from DOUBLE")


@register("s2_csv_semicolon", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s2_csv_semicolon(spark, d):
    path = io.scratch_path(spark, "s2")
    io.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, sep=";")
    return io.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, c_mktsegment STRING", sep=";")


@register("s3_s9_json_lines", W("""SELECT vacancy_id, name, CASE WHEN keySkills IS NULL THEN NULL
  ELSE array_to_string(keySkills, '|') END AS keySkills FROM vacancy""", "vacancy"))
def s3_s9_json_lines(spark, d):
    path = io.scratch_path(spark, "s3")
    io.write_json(fx.vacancy(spark, d).select("vacancy_id", "name", "keySkills"), path)
    back = io.read_json(spark, path, "vacancy_id BIGINT, name STRING, keySkills ARRAY<STRING>")
    return back.select("vacancy_id", "name", F.array_join("keySkills", "|").alias("keySkills"))


@register("s4_gzip_json_lines", W("SELECT user_id, area_id, title FROM request", "request"))
def s4_gzip_json_lines(spark, d):
    path = io.scratch_path(spark, "s4")
    io.write_json(fx.request(spark, d).select("user_id", "area_id", "title"), path, gzip=True)
    return io.read_json(spark, path, "user_id BIGINT, area_id STRING, title STRING")


@register("s7_table_replace", "SELECT p_partkey, p_name, p_brand FROM part")
def s7_table_replace(spark, d):
    path = io.scratch_path(spark, "s7")
    io.replace_table(table(spark, d, "part").select("p_partkey", "p_name").limit(0), "jobsift_vacancies", path)
    return io.replace_table(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"),
                            "jobsift_vacancies", path)


@register("s8_append_sink", W("SELECT vacancy_id, name FROM vacancy", "vacancy"))
def s8_append_sink(spark, d):
    path = io.scratch_path(spark, "s8")
    v = fx.vacancy(spark, d).select("vacancy_id", "name")
    io.write_csv(v.filter(F.col("vacancy_id") % 2 == 0), path)
    io.write_csv(v.filter(F.col("vacancy_id") % 2 == 1), path, mode="append")
    return io.read_csv(spark, path, "vacancy_id BIGINT, name STRING")


@register("s10_keyed_upsert", W("""SELECT user_id, round(compensation_from, 6) AS compensation_from, area_id FROM request
WHERE user_id % 5 <> 0
UNION ALL SELECT user_id, round(compensation_from * 1.1, 6), area_id FROM request WHERE user_id % 5 = 0""", "request"))
def s10_keyed_upsert(spark, d):
    """New profiles of every fifth user replace the stored ones; the table
    is written, updated by key and scanned again."""
    r = fx.request(spark, d).select("user_id", "compensation_from", "area_id")
    new = r.filter(F.col("user_id") % 5 == 0).withColumn("compensation_from", F.col("compensation_from") * 1.1)
    path = io.scratch_path(spark, "s10")
    r.write.parquet(path)
    out = spark.read.parquet(io.upsert_table(spark, path, new, ["user_id"]))
    return out.select("user_id", F.round("compensation_from", 6).alias("compensation_from"), "area_id")


@register("s11_text_dictionary", W("SELECT DISTINCT lower(s) AS entry FROM (SELECT unnest(keySkills) AS s FROM vacancy)",
                                   "vacancy"))
def s11_text_dictionary(spark, d):
    path = io.scratch_path(spark, "s11")
    words = fx.vacancy(spark, d).select(F.explode("keySkills").alias("s")).select(F.initcap("s").alias("value"))
    words.write.mode("overwrite").text(path)
    return io.read_dictionary(spark, path)


@register("s12_dataset_folders", """SELECT source AS name, doc_id, md5(text) AS text_md5 FROM (SELECT source, doc_id, text, row_number() OVER
  (PARTITION BY source ORDER BY md5(concat('42', CAST(doc_id AS VARCHAR))), doc_id) AS r FROM documents) WHERE r <= 50""")
def s12_dataset_folders(spark, d):
    """Documents written as one JSON dataset folder per source, read
    back with the dataset name and at most 50 examples per dataset."""
    path = io.scratch_path(spark, "s12")
    table(spark, d, "documents").select("doc_id", "source", "text").write.partitionBy("source").json(path)
    out = io.read_datasets(spark, path, 50, "doc_id", schema="doc_id BIGINT, text STRING")
    return out.select("name", "doc_id", F.md5("text").alias("text_md5"))


_EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@register("t1_streaming_session_fold", W("""
SELECT user_id, strftime(min(action_dt), '%Y-%m-%d %H:%M:%S') AS session_start,
  array_to_string(list(vacancy_id ORDER BY action_dt, event_id), ',') AS vacancy_ids,
  array_to_string(list(action_type ORDER BY action_dt, event_id), ',') AS action_types
FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY action_dt, event_id) AS nth FROM (
  SELECT *, CASE WHEN action_dt - lag(action_dt) OVER (PARTITION BY user_id ORDER BY action_dt, event_id)
    < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM interaction)) GROUP BY user_id, nth""", "interaction"))
def t1_streaming_session_fold(spark, d):
    """The events table consumed as a stream (availableNow), folded into
    30-minute gap sessions with a watermark, written append-only as parquet
    and scanned back; an end-of-input row closes the last sessions."""
    out, ckpt = io.scratch_path(spark, "t1-out"), io.scratch_path(spark, "t1-ckpt")
    # a glob: the file source watches a folder pattern, here the one table file
    src = f"{d.rstrip('/')}/event[s].parquet"
    actions = sessions.with_end_of_input(sessions.action_stream(spark, src, _EVENTS_SCHEMA), io.scratch_path(spark, "t1-end"))
    sessions.run_available_now(sessions.fold_sessions_stream(actions), out, ckpt)
    res = spark.read.parquet(out).filter(F.col("user_id").isNotNull())
    return res.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
                      F.array_join("vacancy_id", ",").alias("vacancy_ids"),
                      F.array_join("action_type", ",").alias("action_types"))
