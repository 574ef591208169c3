"""Interaction histories.

A user's history can be arbitrarily long (one user may hold a large share of
the log), so history operators never gather a whole history into one array
or one window partition.  Positions are expressed by an order key
``struct(action_dt, event_id)`` and every per-user quantity is a grouped
aggregate (partial aggregation before the shuffle) joined back on the user.
Only bounded frames (a trailing frame of 5, a day session) are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.functions.codes import ACTION_RESPONSE, ACTION_VIEW


def order_key(ts: str = "action_dt", tie: str = "event_id") -> Column:
    return F.struct(F.col(ts).alias("t"), F.col(tie).alias("e"))


def with_salary(events: DataFrame, vacancies: DataFrame, salary: str = "compensation_from") -> DataFrame:
    """J5 in long form: attach the salary of every acted item (null when the
    item is unknown or has no salary)."""
    sal = vacancies.select("vacancy_id", F.col(salary).alias("salary"))
    return events.join(sal, "vacancy_id", "left")


def last_event(df: DataFrame, user: str = "user_id") -> DataFrame:
    """The last row per user by the order key (``max_by``: one aggregate)."""
    cols = [c for c in df.columns if c != user]
    latest = F.max_by(F.struct(*cols), order_key())
    return df.groupBy(user).agg(latest.alias("r")).select(user, "r.*")


def latest_session(df: DataFrame, user: str = "user_id") -> DataFrame:
    """The session of each user's latest action (ties: larger session id)."""
    k = F.struct(F.col("action_dt"), F.col("session_id"))
    return df.groupBy(user).agg(F.max(k)["session_id"].alias("session_id"),
                                F.max("action_dt").alias("last_dt"))


def response_cut(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user, position of the last response (0-based), the number of
    items before it, the history cut (Q31: the history ends one item before
    the item preceding the last response) and the salary of that response.

    Output: user, last_pos, n_items, hist_len, cut_key, target.
    """
    k = order_key()
    last = df.groupBy(user).agg(
        F.max(F.when(F.col("action_type") == ACTION_RESPONSE, k)).alias("last_key"),
        F.count("*").alias("n_items"))
    j = df.join(last.filter(F.col("last_key").isNotNull()), user)
    before = k < F.col("last_key")
    return j.groupBy(user).agg(
        F.count(F.when(before, 1)).alias("last_pos"),
        F.first("n_items").alias("n_items"),
        F.max(F.when(before, k)).alias("cut_key"),
        F.max(F.when(k == F.col("last_key"), F.col("salary"))).alias("target"),
    ).withColumn("hist_len", F.greatest(F.col("last_pos") - 1, F.lit(0)))


def history_before_cut(df: DataFrame, cuts: DataFrame, user: str = "user_id") -> DataFrame:
    """The history rows (strictly before the cut key)."""
    return df.join(cuts.select(user, "cut_key"), user).filter(order_key() < F.col("cut_key"))


def gated_cuts(cuts: DataFrame, min_len: int = 5, max_len: int = 50) -> DataFrame:
    """W4 gates: known target, response not first, min_len < history < max_len."""
    return cuts.filter(F.col("target").isNotNull() & (F.col("last_pos") > 0)
                       & (F.col("hist_len") > min_len) & (F.col("hist_len") < max_len))


def trailing_frame(history: DataFrame, n: int = 5, user: str = "user_id") -> DataFrame:
    """The last ``n`` history rows per user, as ordered arrays.

    ``row_number() <= n`` plans as a WindowGroupLimit, so each map task keeps
    only its own top n per user before the shuffle; the collected frame is
    bounded by n.
    """
    w = Window.partitionBy(user).orderBy(F.col("action_dt").desc(), F.col("event_id").desc())
    top = history.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    frame = top.groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct(order_key().alias("k"), "action_type", "salary"))).alias("f"))
    return frame.select(user, F.transform("f", lambda x: x["action_type"]).alias("types"),
                        F.transform("f", lambda x: x["salary"]).alias("salaries"))


def impute_row_mean(arr) -> Column:
    """W6 (Q34 fixed): nulls of a numeric array replaced by the array's mean."""
    a = F.col(arr) if isinstance(arr, str) else arr
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    n = F.size(F.filter(a, lambda x: x.isNotNull()))
    mean = F.when(n > 0, s / n)
    return F.transform(a, lambda x: F.coalesce(x, mean))


def action_type_means(history: DataFrame, user: str = "user_id", types=(1, 2, 3),
                      money: str = "decimal(18,2)", default: float | None = None) -> DataFrame:
    """Mean salary per action type over the history, missing salaries
    imputed by the user's history mean; a type with no rows gets the mean.
    Users whose history has no salary at all count with ``default`` for it
    (Q5), or are dropped when none is given, as for fitting.

    Salaries are summed as decimals (exact, order independent), so the means
    do not depend on the order in which partial sums are merged.
    """
    def exact_sum(c):
        return F.sum(c.cast(money)).cast("double")

    sal = F.col("salary")
    mean = F.try_divide(exact_sum(sal), F.count(sal))
    um = history.groupBy(user).agg((mean if default is None else F.coalesce(mean, F.lit(default))).alias("hist_mean"))
    j = history.join(um.filter(F.col("hist_mean").isNotNull()), user)
    aggs = []
    for t in types:
        is_t = F.col("action_type") == t
        aggs += [exact_sum(F.when(is_t, sal)).alias(f"s{t}"),
                 F.count(F.when(is_t & sal.isNotNull(), 1)).alias(f"k{t}"),
                 F.count(F.when(is_t & sal.isNull(), 1)).alias(f"z{t}")]
    out = j.groupBy(user).agg(F.first("hist_mean").alias("hist_mean"), *aggs)
    m = F.col("hist_mean")

    def type_mean(t):
        n = F.col(f"k{t}") + F.col(f"z{t}")
        total = F.coalesce(F.col(f"s{t}"), F.lit(0.0)) + m * F.col(f"z{t}")
        return F.when(n > 0, total / n).otherwise(m)

    return out.select(user, "hist_mean", *[type_mean(t).alias(f"mean_type{t}") for t in types])


def fold_sessions(events: DataFrame, keys=("user_id", "session_id"), skip_views: bool = False) -> DataFrame:
    """One row per session with parallel arrays (vacancy_id, action_type)
    in action order.  Sessions are bounded (one day), so the fold is bounded."""
    e = events.filter(F.col("action_type") != ACTION_VIEW) if skip_views else events
    f = e.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(order_key().alias("k"), "vacancy_id", "action_type"))).alias("s"))
    return f.select(*keys, F.transform("s", lambda x: x["vacancy_id"]).alias("vacancy_id"),
                    F.transform("s", lambda x: x["action_type"]).alias("action_type"))


def explode_parallel(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """I4: (keys, pos, a, b) rows from parallel arrays; unequal lengths raise
    instead of being padded with nulls as ``arrays_zip`` would."""
    checked = F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(
        F.raise_error(F.lit(f"parallel arrays {a} and {b} differ in length")))
    return df.select(*keys, F.posexplode(checked).alias("pos", "z")).select(
        *keys, "pos", F.col(f"z.{a}").alias(a), F.col(f"z.{b}").alias(b))


def filter_by_parallel(items: str, actions: str, keep: tuple[int, ...]) -> Column:
    """Items whose parallel action is in ``keep``, order kept."""
    z = F.arrays_zip(F.col(items).alias("i"), F.col(actions).alias("a"))
    return F.transform(F.filter(z, lambda x: x["a"].isin(*keep)), lambda x: x["i"])
