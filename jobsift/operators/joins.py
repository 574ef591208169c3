"""Join patterns of the reference (J1-J11) expressed as Spark joins.

Sort-merge vs broadcast is left to AQE, which measures the materialised
build side at run time (``spark.sql.adaptive.autoBroadcastJoinThreshold``)
and switches to a broadcast only below that bound; the explicit
``broadcast`` hint is used only for fixed vocabularies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.operators.sequences import order_key


def lookup_array(df: DataFrame, keys: list[str], array_col: str, table: DataFrame,
                 value: str, table_key: str | None = None) -> DataFrame:
    """Replace every element of ``array_col`` by its ``value`` in
    ``table`` (null when unknown), keeping order.  Done as posexplode +
    equi join + ordered regroup, so the lookup table is never collected."""
    tk = table_key or array_col
    ex = df.select(*keys, F.posexplode(array_col).alias("__pos", "__item"))
    t = table.select(F.col(tk).alias("__item"), F.col(value).alias("__val"))
    j = ex.join(t, "__item", "left")
    regroup = j.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__pos", "__val"))).alias("__s"))
    return regroup.select(*keys, F.transform("__s", lambda x: x["__val"]).alias(value))


def lookup_with_default(df: DataFrame, col: str, table: DataFrame, table_col: str,
                        value: str, default, normalise_spaces: bool = False) -> DataFrame:
    """Left lookup of ``col`` in ``table``; missing -> ``default``."""
    norm = (lambda c: F.regexp_replace(c, " ", "")) if normalise_spaces else (lambda c: c)
    t = table.select(norm(F.col(table_col)).alias("__k"), F.col(value).alias("__v"))
    j = df.withColumn("__k", norm(F.col(col))).join(t, "__k", "left")
    return j.withColumn(value, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v")


def probe_and_truth(events: DataFrame, min_distinct: int = 10, user: str = "user_id",
                    item: str = "vacancy_id") -> DataFrame:
    """W7 in long form: per user the distinct items in order of first action;
    the first is the probe, the rest the truth; only users with more than
    ``min_distinct`` distinct items.  Aggregates only (no per-user arrays)."""
    first = events.groupBy(user, item).agg(F.min(order_key()).alias("k"))
    users = first.groupBy(user).agg(F.count("*").alias("n"), F.min_by(item, "k").alias("probe")) \
        .filter(F.col("n") > min_distinct)
    return first.join(users, user).select(user, item, (F.col(item) == F.col("probe")).alias("is_probe"))


def anti_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` without a match in ``other`` on ``on``."""
    return df.join(other.select(*on).distinct(), on, "left_anti")
