"""Rank correlations (A13 Spearman, A14 Kendall tau-b), pairwise complete.

Both start from one long table of distinct (pair of columns, x, y) cells with
their counts, for all column pairs at once; ties then are counts, and no step
compares rows with each other.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.operators.running import PER_TASK, binned, running_sums

#: bins along each axis at most, so that their grid is one task's work
GRID = 32 * 32
#: integers of any size that a sum of pair products needs
WIDE = "decimal(38,0)"


def _cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(pair, x, y, n): distinct values of every two columns, where both are known."""
    pairs = [F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for i, (a, b) in enumerate(combinations(cols, 2))]
    known = df.select(F.explode(F.array(*pairs)).alias("c")).select("c.*").filter("x IS NOT NULL AND y IS NOT NULL")
    return known.groupBy("pair", "x", "y").agg(F.count("*").alias("n"))


def _named(df: DataFrame, cols: list[str], value: Column, out: str) -> DataFrame:
    """A row for every pair of columns, null where none was computed."""
    names = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("col_a"), F.lit(b).alias("col_b"))
                      for i, (a, b) in enumerate(combinations(cols, 2))])
    every = df.sparkSession.range(1).select(F.explode(names).alias("c")).select("c.*")
    return every.join(df.select("pair", value.alias(out)), "pair", "left").select("col_a", "col_b", out)


def _tied_ranks(cells: DataFrame, axis: str, per_task: int) -> DataFrame:
    """(pair, axis, r, m): twice the tie-averaged rank of each distinct value
    less (rows of the pair + 1), which is a whole number, and the value's count."""
    counts = cells.groupBy("pair", axis).agg(F.sum("n").alias("m"))
    upto = running_sums(counts, ["pair"], [axis], {"upto": F.col("m")}, per_task)
    total = cells.groupBy("pair").agg(F.sum("n").alias("total"))
    # ranks upto - m + 1 .. upto; twice their mean is 2 * upto - m + 1
    return upto.join(total, "pair").select("pair", axis, "m", (2 * F.col("upto") - F.col("m") - F.col("total")).alias("r"))


def spearman(df: DataFrame, cols: list[str], per_task: int = PER_TASK) -> DataFrame:
    """Spearman correlation of every column pair over the rows where both
    are non-null (pairwise complete): the correlation of tie-averaged ranks.

    Ranks are cumulative counts over the distinct values; centred and doubled
    they are whole numbers, so all sums are exact.  Null where a column does not
    vary or a pair has no row.  One lazy plan for all pairs.
    """
    cells = _cells(df, cols)
    x, y = (_tied_ranks(cells, a, per_task).withColumnRenamed("r", f"r{a}") for a in "xy")

    def product(n, a, b):  # up to 10 ** 12 rows
        factors = F.col(n).cast("decimal(12,0)") * F.col(a).cast("decimal(13,0)")
        return F.sum((factors * F.col(b).cast("decimal(13,0)")).cast(WIDE)).cast("double")

    def square(ranks, a):
        return ranks.groupBy("pair").agg(product("m", f"r{a}", f"r{a}").alias(f"s{a}"))

    both = cells.join(x.drop("m"), ["pair", "x"]).join(y.drop("m"), ["pair", "y"]).groupBy("pair").agg(
        product("n", "rx", "ry").alias("sxy"))
    sums = both.join(square(x, "x"), "pair").join(square(y, "y"), "pair")
    rho = F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("sxy") / F.sqrt("sx") / F.sqrt("sy"))
    return _named(sums, cols, rho, "rho")


def inversions(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over the pairs with u[i] < u[j] and v[i] > v[j]: a
    merge count from the top bit of v's rank to the lowest, all merges of a bit
    at once."""
    order = np.lexsort((v, u))  # equal u by rising v: no inversion among them
    rank = np.unique(v[order], return_inverse=True)[1].astype(np.int64)
    w = w[order].astype(np.int64)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        group, high = rank >> (bit + 1), (rank >> bit & 1).astype(bool)
        ones = np.cumsum(np.where(high, w, 0))
        first = np.append(True, group[1:] != group[:-1])
        base = np.where(high, w, 0)[first]
        start = (ones[first] - base)[np.cumsum(first) - 1]
        above, low = (ones - start)[~high], w[~high]
        # halves of 24 bits keep the products within a long
        total += (int((low * (above >> 24)).sum()) << 24) + int((low * (above & 0xFFFFFF)).sum())
        by = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[by], w[by]
    return total


def _inverted(points: DataFrame, group: list[str], u: str, v: str) -> DataFrame:
    """(pair, inv): ``inversions`` of the points of each group, by pair."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair": pdf["pair"].iloc[:1], "inv": [Decimal(inversions(
            pdf[u].to_numpy(), pdf[v].to_numpy(), pdf["n"].to_numpy()))]})

    return points.groupBy(*group).applyInPandas(count, f"pair int, inv {WIDE}")


def kendall_tau_b(df: DataFrame, cols: list[str], per_task: int = PER_TASK) -> DataFrame:
    """Kendall tau-b of every column pair (pairwise complete), also for
    continuous columns.

    The discordant pairs of cells, x rising and y falling, are counted in three
    disjoint sets.  Cells lie in bins of the order (x, y) and in bins of the order
    (y, x): two cells share the first bin, or else the second, or neither.  The
    first two sets are merge counts inside a bin; the third counts on the grid of
    both bins' totals.  Ties follow from the counts of distinct values.  Null
    where a column does not vary or a pair has fewer than two rows.
    """
    cells = binned(binned(_cells(df, cols), ["pair"], ["x", "y"], per_task, GRID, "p"), ["pair"], ["y", "x"], per_task, GRID, "q")
    grid = cells.groupBy("pair", "p", "q").agg(F.sum("n").alias("n"))
    found = _inverted(cells.select("pair", "p", "x", "y", "n"), ["pair", "p"], "x", "y").unionByName(
        _inverted(cells.select("pair", "q", "p", "y", "n"), ["pair", "q"], "p", "y")).unionByName(
        _inverted(grid, ["pair"], "p", "q")).groupBy("pair").agg(F.sum("inv").alias("inv"))

    def pairs(c) -> Column:
        """Ordered pairs among ``c`` rows."""
        n = F.col(c).cast("decimal(19,0)")
        return (n * (n - F.lit(1).cast("decimal(1,0)"))).cast(WIDE)

    def ties(axis, out):
        return cells.groupBy("pair", axis).agg(F.sum("n").alias("m")).groupBy("pair").agg(F.sum(pairs("m")).alias(out))

    all_ = cells.groupBy("pair").agg(F.sum("n").alias("total"), F.sum(pairs("n")).alias("txy"))
    j = found.join(all_, "pair").join(ties("x", "tx"), "pair").join(ties("y", "ty"), "pair")
    n0 = pairs("total")
    # concordant + discordant = all - tied in x - tied in y + tied in both
    lead = (n0 - F.col("tx") - F.col("ty") + F.col("txy") - 4 * F.col("inv")).cast("double")
    x, y = (n0 - F.col("tx")).cast("double"), (n0 - F.col("ty")).cast("double")
    return _named(j, cols, F.when((x > 0) & (y > 0), lead / F.sqrt(x) / F.sqrt(y)), "tau_b")
