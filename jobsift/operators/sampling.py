"""Deterministic ordering, top-k, sampling and splitting.

Random choices are replaced by an md5 order of ``seed || id`` so Spark and
DuckDB pick the same rows and re-runs after executor loss are identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_key(seed: int | str, *cols) -> Column:
    """Pseudo-random but reproducible order key."""
    return F.md5(F.concat(F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                              for c in cols]))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """First k rows per group by an explicit order (ties must be broken
    by the caller, e.g. by id).  Planned as WindowGroupLimit: partial top-k
    per map task, so a hot group never reaches one task whole."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """L4: n rows without replacement, reproducible (md5 order, global limit)."""
    return df.orderBy(md5_key(seed, key), F.col(key)).limit(n)


def hex_threshold(fraction: float) -> str:
    """md5 prefixes (8 hex digits) below this string make up ``fraction``."""
    return format(int(fraction * 16 ** 8), "08x")


def md5_under(fraction: float, seed, key) -> Column:
    return F.substring(md5_key(seed, key), 1, 8) < F.lit(hex_threshold(fraction))


def sample_fraction(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """L4 for fractions: keep rows whose md5 bucket falls under the fraction."""
    return df.filter(md5_under(fraction, seed, key))


def prefix_cap(df: DataFrame, n: int, key: str) -> DataFrame:
    """First n rows by key (there is no physical row order in Spark)."""
    return df.orderBy(key).limit(n)


def split_by_key(df: DataFrame, key: str, test_fraction: float = 0.1, seed: int = 42) -> Column:
    """Boolean ``is_test`` from an md5 bucket of the key; all rows of one
    key (user) land on the same side."""
    return md5_under(test_fraction, seed, key)


def ordered_ids(score: str, ident: str, ascending: bool = True) -> Column:
    """L8 aggregate: ids ordered by score (ascending as the reference, Q2)."""
    s = F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), F.col(ident).alias("i"))))
    ids = F.transform(s, lambda x: x["i"])
    return ids if ascending else F.reverse(ids)
