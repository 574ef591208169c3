"""Title part statistics and popular-part promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.functions.titles import slash_parts, without_parentheses


def title_parts(df: DataFrame, key: str, col: str) -> DataFrame:
    """Long form (key, pos, part) of the slash parts of a cleaned title;
    pos 0 is the head."""
    parts = slash_parts(without_parentheses(col))
    return df.select(key, F.posexplode(parts).alias("pos", "part"))


def part_frequency(df: DataFrame, key: str, col: str) -> DataFrame:
    """Occurrences of every part, heads and rests together."""
    return title_parts(df, key, col).groupBy("part").agg(F.count("*").alias("cnt"))


def promote_popular_parts(df: DataFrame, key: str, col: str) -> DataFrame:
    """Walk the rest parts left to right; whenever the current head is
    strictly rarer than the part, the two swap places.

    Returns (key, clean_name, slash_names).  Counts come from one grouped
    aggregate; the per-title walk is an ``aggregate`` over the (short) part
    array, so it stays a JVM expression.
    """
    parts = title_parts(df, key, col)
    counts = parts.groupBy("part").agg(F.count("*").alias("cnt"))
    rows = (parts.join(counts, "part")
            .groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "part", "cnt"))).alias("p")))
    steps = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)) \
        .otherwise(F.array().cast("array<int>"))

    def step(acc, j):
        swap = acc[0]["cnt"] < acc[j]["cnt"]
        return F.when(swap, F.transform(
            acc, lambda x, i: F.when(i == 0, acc[j]).when(i == j, acc[0]).otherwise(x))
        ).otherwise(acc)

    walked = F.aggregate(steps, F.col("p"), step)
    return rows.select(
        key,
        walked[0]["part"].alias("clean_name"),
        F.transform(F.slice(walked, 2, 1 << 20), lambda x: x["part"]).alias("slash_names"),
    )
