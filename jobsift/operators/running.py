"""Running sums and ranks inside groups of any length.

A window over a group brings all its rows into one task.  Here a group of more
than ``per_task`` rows is cut into bins along its order: the bins' totals, a few
thousand rows a group at most, are added up to what lies before each bin, and a
window runs inside a bin only.  Smaller groups are one bin.

Bin edges are the group's rows with the smallest hashes: an even sample of its
rows that comes out the same in every task and every retry, so nothing has to be
stored before it is used and the plan stays lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_TASK = 200_000
#: edges of a group at most; a square number, as they are searched in two steps
EDGES = 64 * 64


def _bin_of(edges: Column, at: Column, most: int) -> Column:
    """Number of sorted ``edges`` that are not above ``at``: first among every
    step-th edge, then among the step edges that follow."""
    step = max(1, int(most ** 0.5))
    heads = F.filter(edges, lambda e, i: (i % step == step - 1) & (e <= at))
    skip = F.size(heads) * step
    return skip + F.size(F.filter(F.slice(edges, skip + 1, step), lambda e: e <= at))


def binned(df: DataFrame, keys: list[str], order: list[str], per_task: int = PER_TASK, most: int = EDGES,
           out: str = "__bin") -> DataFrame:
    """``out``: the bin of each row along ``order`` inside its group; 0 in groups
    of ``per_task`` rows or fewer.  Rows of a lower bin come first in the order.
    Keys are not null; rows equal in ``order`` share a bin."""
    at = F.struct(*order)
    parts = F.least(F.ceil(F.col("__n") / per_task), F.lit(most))
    hot = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > per_task).select(*keys, parts.alias("__parts"))
    lowest = Window.partitionBy(*keys).orderBy(F.xxhash64(*order), at)
    sample = df.join(hot, keys).select(*keys, "__parts", *order).withColumn("__r", F.row_number().over(lowest)) \
        .filter((F.col("__r") <= most) & (F.col("__r") < F.col("__parts")))
    edges = sample.groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("__edges"))
    found = F.when(F.col("__edges").isNull(), F.lit(0)).otherwise(_bin_of(F.col("__edges"), at, most))
    return df.join(edges, keys, "left").withColumn(out, found.cast("int")).drop("__edges")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 per_task: int = PER_TASK) -> DataFrame:
    """``sums``: new columns, each the sum of a column over the group's rows up
    to and with the row itself, in ascending ``order`` (which must tell the rows
    of a group apart).  Keys are not null."""
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    b = binned(df.withColumns(values), keys, order, per_task)
    total = b.groupBy(*keys, "__bin").agg(*[F.sum(v).alias(f"__t{v}") for v in values])
    below = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*keys, "__bin", *[F.coalesce(F.sum(f"__t{v}").over(below), F.lit(0)).alias(f"__b{v}") for v in values])
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({f"__i{v}": F.sum(v).over(inside) for v in values}).join(before, [*keys, "__bin"])
    return b.withColumns({name: F.col(f"__i{v}") + F.col(f"__b{v}") for name, v in zip(sums, values)}).drop(
        "__bin", *values, *[f"__{x}{v}" for v in values for x in "ib"])


def group_ranks(df: DataFrame, keys: list[str], order: list[str], out: str = "rank",
                per_task: int = PER_TASK) -> DataFrame:
    """``out``: rank from 1 inside the group, as ``row_number`` would give it."""
    return running_sums(df, keys, order, {out: F.lit(1).cast("long")}, per_task)


def overall_ranks(df: DataFrame, order: list[str], out: str = "rank", per_task: int = PER_TASK) -> DataFrame:
    """``out``: rank from 1 among all rows."""
    # one key for all rows; a literal would be taken out of joins, groups and windows
    one = F.pmod(F.xxhash64(*order), F.lit(1))
    return group_ranks(df.withColumn("__all", one), ["__all"], order, out, per_task).drop("__all")
