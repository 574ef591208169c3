"""Domain views over the supplied tables.

The recommendation operators work on a vacancy catalogue, an interaction log
and a table of recommendation requests.  These views derive them from the
TPC-H-like tables so that every operator's work grows with the data.  The
same derivations exist as SQL text in ``jobsift.catalog.sqlviews`` for the
DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.sources.tables import table

# The split point between history (train) and future (test).
TRAIN_CUTOFF = "2024-01-16 00:00:00"


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def vacancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancy catalogue, one row per part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    skills = F.array(F.col("p_name"), F.lower("p_type"),
                     F.concat(F.lit("size"), _s("p_size")))
    return p.select(
        k.alias("vacancy_id"),
        F.when(k % 3 == 0, F.col("p_name"))
        .otherwise(F.concat(F.col("p_name"), F.lit(" / "), F.lower("p_type"),
                            F.lit(" ("), F.col("p_brand"), F.lit(")"))).alias("name_raw"),
        F.col("p_name").alias("name"),
        F.when(k % 11 == 0, F.lit(None).cast("array<string>")).otherwise(skills).alias("keySkills"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.array_join(skills, " ")).alias("keySkills_str"),
        F.concat(F.lit("c_"), _s(k % 37)).alias("company_id"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("p_retailprice")).alias("compensation_from"),
        F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("p_retailprice") * 1.5).alias("compensation_to"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 10 == 1, F.lit("USD"))
        .otherwise(F.lit("RUR")).alias("compensation_currencyCode"),
        F.col("p_brand").alias("area_id"),
        F.when(F.col("p_type") == "ECONOMY", "part").when(F.col("p_type") == "SMALL", "project")
        .when(F.col("p_type") == "MEDIUM", "probation").when(F.col("p_type") == "PROMO", "volunteer")
        .otherwise("full").alias("employment"),
        F.when(F.col("p_size") % 5 == 0, "fullDay").when(F.col("p_size") % 5 == 1, "shift")
        .when(F.col("p_size") % 5 == 2, "remote").when(F.col("p_size") % 5 == 3, "flexible")
        .otherwise("flyInFlyOut").alias("workSchedule"),
        F.when(F.col("p_size") <= 12, "noExperience").when(F.col("p_size") <= 25, "between1And3")
        .when(F.col("p_size") <= 37, "between3And6").otherwise("moreThan6").alias("workExperience"),
    )


def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long interaction log: one row per (user, vacancy, action)."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("purchase", "view", "click"))
    return e.select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("vacancy_id"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2)
        .otherwise(3).alias("action_type"),
        F.col("ts").alias("action_dt"),
        "event_id",
        F.concat(_s("user_id"), F.lit("_"), F.col("ts").cast("date").cast("string")).alias("session_id"),
        (F.col("ts") < F.lit(TRAIN_CUTOFF).cast("timestamp_ntz")).alias("is_train"),
    )


def request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendation requests: a user profile with a wanted title and skills."""
    c = table(spark, sf_dir, "customer")
    v = vacancy(spark, sf_dir).select(F.col("vacancy_id").alias("c_custkey"),
                                      F.col("name").alias("title"),
                                      F.lower("keySkills_str").alias("skills"))
    return c.join(v, "c_custkey").select(
        F.col("c_custkey").alias("user_id"),
        (F.lit(900.0) + F.abs("c_acctbal") / 100).alias("compensation_from"),
        F.concat(F.lit("Brand#"), _s(F.col("c_nationkey") + 1)).alias("area_id"),
        (F.col("c_custkey") % 9).alias("experience_years"),
        "title", "skills",
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancy descriptions: documents keyed by vacancy id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vacancy_id"), F.col("text").alias("description"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense vectors keyed by vacancy id."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vacancy_id"), F.col("embedding").alias("vec"), "label")
