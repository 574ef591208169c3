"""Set operations on DataFrames and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all_by_name(frames: list[DataFrame]) -> DataFrame:
    """Concatenation by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both inputs."""
    return a.select(key).intersect(b.select(key))


def sorted_distinct(c) -> Column:
    """U4: ``list(set(x))`` with a stable (sorted) order (Q17)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(c))


def overlap_size(a, b) -> Column:
    """Number of distinct common elements."""
    return F.size(F.array_intersect(a, b))
