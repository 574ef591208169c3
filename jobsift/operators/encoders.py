"""Label encoding and per-group scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.operators.running import overall_ranks


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """0-based rank of the value among the sorted distinct values.

    The distinct values (any number of them) are ranked by prefix sums; the codes
    are joined back with an equi join that AQE turns into a broadcast when they
    are few at run time.
    """
    out = out or f"{col}_encoder"
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    codes = overall_ranks(values, [col], out).withColumn(out, F.col(out) - 1)
    return df.join(codes, col, "left")


def minmax_over(value: Column | str, group: list[str] | None = None, constant_value: float = 0.0) -> Column:
    """(x - min) / (max - min) inside the group; a constant group maps to
    ``constant_value`` (0 as sklearn does; MLlib's scaler would give 0.5)."""
    v = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*(group or []))
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return F.when(hi == lo, F.lit(constant_value)).otherwise((v - lo) / (hi - lo))


def minmax_scale(df: DataFrame, value: str, group: list[str], out: str = "scaled",
                 constant_value: float = 0.0) -> DataFrame:
    """E12 for large groups: min and max per group as a grouped aggregate
    (partial, skew-safe) joined back, instead of a window over the group."""
    mm = df.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    j = df.join(mm, group)
    scaled = F.when(F.col("__hi") == F.col("__lo"), F.lit(constant_value)) \
        .otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return j.withColumn(out, scaled).drop("__lo", "__hi")
