"""Grouped aggregates.

All are hash aggregates with a partial (map-side) stage, so a hot group key
is pre-aggregated before the shuffle and never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1: rows per category (null is its own category)."""
    return df.groupBy(col).agg(F.count("*").alias("cnt"))


def token_frequency(df: DataFrame, array_col: str, out: str = "token",
                    min_count: int | None = None) -> DataFrame:
    """A2/A3: occurrences of every array element, optional HAVING threshold."""
    freq = (df.select(F.explode(array_col).alias(out)).groupBy(out)
            .agg(F.count("*").alias("cnt")))
    return freq.filter(F.col("cnt") >= min_count) if min_count is not None else freq


def top_n(freq: DataFrame, key: str, n: int, count_col: str = "cnt") -> DataFrame:
    """L2: global top-n by count, ties by key.  ``limit`` after ``orderBy``
    plans as TakeOrderedAndProject (per-partition top-n, then merge)."""
    return freq.orderBy(F.col(count_col).desc(), F.col(key).asc()).limit(n)


def grouped_median(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """Exact median of ``value`` per group (mean of the middle two), nulls
    passed over: by..., out.

    A sketch of fixed size brackets the middle (its error, a ten-thousandth of
    the rows, is far inside the bracket); rows below are counted, and only the
    distinct values between the brackets are put in order.  No task holds a
    group's values.
    """
    d = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    q = F.percentile_approx("__v", [0.49, 0.51], 10_000)
    bounds = d.groupBy(*by).agg(q.alias("__q"), F.count("*").alias("__n")).select(
        *by, F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"), "__n")
    if by:
        j = d.join(bounds, by)
    else:
        one = bounds.first()
        j = d.withColumns({c: F.lit(one[c]) for c in ("__lo", "__hi", "__n")})
    # values below the bracket count as one value under it
    v = F.when(F.col("__v") >= F.col("__lo"), F.col("__v"))
    counts = j.filter(F.col("__v") <= F.col("__hi")).groupBy(*by, "__n", v.alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(F.col("__v").asc_nulls_first()))
    ordered = counts.withColumn("__upto", upto)

    def at(index):
        return F.min(F.when(F.col("__upto") > index, F.col("__v")))

    return ordered.groupBy(*by).agg(((at(F.expr("(__n - 1) div 2")) + at(F.expr("__n div 2"))) / 2).alias(out))


def mean_median(df: DataFrame, by: list[str], cols: Iterable[str]) -> DataFrame:
    """A4: mean and exact median per group (non-null keys)."""
    cols = list(cols)
    short = {c: c.split("_")[-1] for c in cols}
    out = df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{short[c]}") for c in cols])
    for c in cols:
        out = out.join(grouped_median(df, by, c, f"median_{short[c]}"), by, "left")
    return out


def non_null_counts(df: DataFrame, by: list[str], cols: Mapping[str, str]) -> DataFrame:
    """A5: non-null counts per group; rows with a null key are dropped, as in pandas."""
    for b in by:
        df = df.filter(F.col(b).isNotNull())
    return df.groupBy(*by).agg(*[F.count(c).alias(a) for c, a in cols.items()])


def row_normalised(df: DataFrame, by: str, value: str, out: str = "weight") -> DataFrame:
    """Value divided by the sum over the row (``by`` group).  The row sum
    is a grouped aggregate joined back, not a window, so a hot row key is
    pre-aggregated map-side and the join can be split by AQE's skew handling."""
    # the row sum is accumulated as a decimal: exact, so it does not depend on
    # the order in which partial sums are merged
    sums = df.groupBy(by).agg(F.sum(F.col(value).cast("decimal(38,18)")).cast("double").alias("__sum"))
    return df.join(sums, by).withColumn(out, F.col(value) / F.col("__sum")).drop("__sum")


def mean_or_default(c: Column | str, default: float = 0.0) -> Column:
    """Mean that skips nulls, ``default`` when the group has none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.avg(c), F.lit(default))


def null_counts(df: DataFrame) -> DataFrame:
    """Null count of every column, one row."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns]) \
        .select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in df.columns])
