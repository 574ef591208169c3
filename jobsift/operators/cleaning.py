"""Projection, filtering and cleaning of the catalogue and logs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.functions.text import squeeze, strip


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Subset + rename (nested source names become flat)."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def filter_equal(df: DataFrame, **conditions) -> DataFrame:
    """Conjunction of equality tests; pushed to the scan by Catalyst."""
    cond = F.lit(True)
    for c, v in conditions.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.filter(cond)


def keep_currency(df: DataFrame, code: str = "RUR", col: str = "compensation_currencyCode") -> DataFrame:
    """Rows priced in ``code``; null currency is dropped."""
    return df.filter(F.col(col) == code)


def drop_currency(df: DataFrame, code: str = "RUR", col: str = "compensation_currencyCode") -> DataFrame:
    """P5: pandas ``!=`` semantics, so a null currency counts as foreign (Q32)."""
    return df.filter(~F.col(col).eqNullSafe(code))


def drop_nulls(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """P6."""
    return df.dropna(subset=list(subset))


def fill_with_mean(df: DataFrame, cols: Iterable[str], by: Iterable[str] | None = None) -> DataFrame:
    """Nulls replaced by the column mean (of the group when ``by`` is given).

    The whole-table mean is a scalar subquery (one partial+final aggregate),
    the per-group mean a grouped aggregate joined back on the group key; no
    single-partition window is used.
    """
    cols = list(cols)
    if by:
        by = list(by)
        means = df.groupBy(*by).agg(*[F.avg(c).alias(f"__mean_{c}") for c in cols])
        out = df.join(means, by, "left")
        for c in cols:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__mean_{c}")))
        return out.drop(*[f"__mean_{c}" for c in cols])
    out = df
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), df.select(F.avg(c)).scalar()))
    return out


def numeric_or_default(c, default: float = 100000) -> Column:
    """Coerce text to a number, bad or null values get ``default``; int."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("double"),
                      F.lit(float(default))).cast("long")


def first_per_key(df: DataFrame, key: str | list[str], order: list[str],
                  not_null: Iterable[str] = ()) -> DataFrame:
    """Drop rows with nulls in ``not_null``, then the first row per key by
    an explicit ascending order (deterministic, unlike ``dropDuplicates``).

    ``min_by`` over an ordering struct is a partial aggregate: a key holding
    a large share of the rows is reduced map-side, never gathered whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for c in not_null:
        df = df.filter(F.col(c).isNotNull())
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(first.alias("__r")).select(*keys, "__r.*")


def drop_groups_touching(df: DataFrame, group: str, item: str, excluded: DataFrame,
                         excluded_item: str | None = None) -> DataFrame:
    """P10: drop every group (session) that holds any excluded item.

    Two semi/anti joins on the long table: the excluded set is joined on the
    item, the offending group keys are de-duplicated, then anti-joined.
    """
    ex = excluded.select(F.col(excluded_item or item).alias(item)).distinct()
    bad = df.join(ex, item, "left_semi").select(group).distinct()
    return df.join(bad, group, "left_anti")


def non_empty(c) -> Column:
    """Array is non-null and has elements."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.size(c) > 0)


def amount_and_currency(c) -> list[Column]:
    """Text ``'<number> <currency words>'`` split on the first space."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, " ", 2)
    return [F.try_element_at(parts, F.lit(1)).try_cast("double").alias("amount"),
            F.try_element_at(parts, F.lit(2)).alias("currency")]


def lower_titles(df: DataFrame, col: str, min_len: int = 6) -> DataFrame:
    """Distinct non-null lower-case titles of length >= ``min_len``."""
    t = F.lower(F.col(col))
    return (df.select(t.alias(col)).filter(F.col(col).isNotNull() & (F.length(col) >= min_len))
            .distinct())


__all__ = ["rename", "filter_equal", "keep_currency", "drop_currency", "drop_nulls",
           "fill_with_mean", "numeric_or_default", "first_per_key", "drop_groups_touching",
           "non_empty", "amount_and_currency", "lower_titles", "strip", "squeeze"]
