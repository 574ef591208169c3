"""Quality rules: text statistics and a learned decision list, native columns only.

The list is learned by sequential covering.  A rule is a conjunction of
threshold tests on the statistics below and says "reject"; it is grown on two
thirds of the labelled rows, test by test, by information gain on those it
still covers, until it covers no good row or no test gains; pruned on the other
third by dropping last tests while that does not lower its precision; and taken
if its precision there reaches ``PRECISION``.  Rows that it covers leave, and the
next rule is grown, until none is good enough: neither rules nor tests have a
fixed number.  The result is an ordered list of conditions, turned into one
conditional column.

All labelled rows count.  They are reduced to counts per combination of
feature bins first; a growing step reads one small table of (feature, bin)
sums, whose size is fixed by the number of features and thresholds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.blocks import stored

SPACE = r"[\x20\x09-\x0D]+"
BINS = 24
#: A rule must be right this often, and hold for so large a share of the rows.
PRECISION, SUPPORT = 0.97, 0.001
REPEAT = 5

FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "capitals_per_word": "n_capitals / n_words",
    "marks_per_word": "n_marks / n_words",
    "digits_per_word": "n_digits / n_words",
    "words": "cast(n_words as double)",
}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of the rules.  Null counts as empty.

    ``n_repeat_words`` counts the words inside 5-word windows found twice or
    more: window hashes are sorted with their places, places whose neighbour
    has the same hash are kept, and the words they cover are added up.  Texts
    whose window hashes are all distinct stop there.  The hash has 64 bits and
    is compared within one text only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    t = docs.select("*", F.array_remove(F.split(text, SPACE), "").alias("__w"), F.filter(
        F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"), text.alias("__t"))
    t = t.select(
        "*", F.size("__w").cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("__t", F.lit(r"[A-Z]{2,}")).cast("long").alias("n_capitals"),
        F.regexp_count("__t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("__t", F.lit(r"[0-9]+")).cast("long").alias("n_digits"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.when(F.size("__w") < REPEAT, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(1), F.size("__w") - REPEAT + 1),
            lambda i: F.xxhash64(F.slice("__w", i, REPEAT)))).alias("__h")).drop("__w", "__l", "__t")
    t = t.select("*", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform(
        "__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("__s")).drop("__h")
    t = t.select("*", F.sort_array(F.transform(F.filter("__s", lambda x, k: (
        F.coalesce(x["h"] == F.get("__s", k - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("__s", k + 1)["h"], F.lit(False)))), lambda x: x["i"])).alias("__p")).drop("__s")
    return t.select("*", F.coalesce(F.aggregate(F.transform(
        "__p", lambda p, k: F.least(F.lit(REPEAT), F.coalesce(F.get("__p", k + 1) - p, F.lit(REPEAT)))),
        F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long").alias("n_repeat_words")).drop("__p")


def features() -> dict[str, Column]:
    return {f"f_{k}": F.when(F.col("n_words") > 0, F.expr(v)).otherwise(0.0) for k, v in FEATURES.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def binned(self, cuts: dict[str, list[float]]) -> Column:
        at = cuts[self.feature].index(self.threshold) + 1
        c = F.col(self.feature)
        return c >= at if self.above else c < at

    def __str__(self):
        return f"{self.feature[2:]} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """Information gained on the bad rows that a test still covers."""
    if not bad or not bad0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _prefixes(table: DataFrame, left: Column, tests: list[Column]) -> list[tuple[int, int]]:
    """Bad and good rows that the first 1, 2, ... tests cover."""
    held = [_all(tests[:n]) for n in range(1, len(tests) + 1)]
    r = table.filter(left & held[0]).agg(*[F.coalesce(F.sum(F.when(h, F.col(c))), F.lit(0)) for h in held for c in ("bad", "good")]).first()
    return list(zip(r[::2], r[1::2]))


def _best_test(table: DataFrame, covers: Column, cuts: dict[str, list[float]]):
    """The test with the largest gain among all features and thresholds, and
    how many good rows it leaves."""
    sums = table.filter(covers).select("bad", "good", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in cuts])).alias("x")).groupBy(
        "x.f", "x.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    best = (0.0, None, 0)
    for f, c in sorted(cuts.items()):
        n = {r["bin"]: (r["bad"], r["good"]) for r in sums if r["f"] == f}
        all_bad, all_good = (sum(x[i] for x in n.values()) for i in (0, 1))
        for at, threshold in enumerate(c, 1):
            low_bad, low_good = (sum(x[i] for b, x in n.items() if b < at) for i in (0, 1))
            for above, bad, good in ((True, all_bad - low_bad, all_good - low_good), (False, low_bad, low_good)):
                if bad + good < all_bad + all_good and (g := _gain(bad, good, all_bad, all_good)) > best[0] + 1e-9:
                    best = (g, Test(f, above, threshold), good)
    return best[1:]


def learn(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[list[Test]]:
    """Rejecting rules, in order, from statistics of rows whose label is 0 or
    1.  No rows, or no bad rows, give no rules."""
    fs = list(features())
    rows = labelled.select(id_col, (F.col(label_col) == 0).cast("long").alias("bad"),
                           *[c.alias(f) for f, c in features().items()])
    shares = [i / BINS for i in range(1, BINS)]
    q = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in fs],
                 *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), shares, 10_000).alias(f"b_{f}")
                   for f in fs], F.count("*").alias("n")).first()
    if not q["n"]:
        return []
    cuts = {f: sorted({float(f"{x:.4g}") for x in [*(q[f] or []), *(q[f"b_{f}"] or [])]}) for f in fs}
    fold = (F.pmod(F.xxhash64(id_col), F.lit(3)) == 0).alias("prune")
    binned = stored(rows.select(fold, "bad", *[
        reduce(lambda a, b: a + b, [(F.col(f) >= c).cast("int") for c in cuts[f]], F.lit(0)).alias(f)
        for f in fs]).groupBy("prune", *fs).agg(
        F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")), "labelled")
    grow, prune = binned.filter("not prune"), binned.filter("prune")
    rules, left = [], F.lit(True)
    # every taken rule covers rows, every test takes some away: both loops end
    while True:
        tests: list[Test] = []
        covers, good_left = left, 1
        while good_left:
            test, good_left = _best_test(grow, covers, cuts)
            if test is None:
                break
            tests.append(test)
            covers = covers & test.binned(cuts)
        kept = None
        held = _prefixes(prune, left, [t.binned(cuts) for t in tests]) if tests else []
        for n in range(len(tests), 0, -1):
            bad, good = held[n - 1]
            right = bad / (bad + good) if bad + good else 0.0
            if kept is None or right >= kept[0]:
                kept = (right, bad + good, tests[:n])
        if kept is None or kept[0] < PRECISION or 3 * kept[1] < SUPPORT * q["n"]:
            return rules
        rules.append(kept[2])
        left = left & ~_all([t.binned(cuts) for t in kept[2]])


def rule_column(rules: list[list[Test]]) -> Column:
    """Number of the first rule that fires, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(_all([t.column() for t in rules[i - 1]]), F.lit(i)).otherwise(out)
    return out


def judged(stats: DataFrame, rules: list[list[Test]]) -> DataFrame:
    return stats.withColumns(features()).withColumns(
        {"base_failed": base_failed(), "rule": rule_column(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*features())


def labels_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One label an id: the commoner one, 0 if both are as common."""
    return labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(
        (F.avg(label_col) > 0.5).cast("int").alias(label_col))


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"):
    return learn(stats.join(labels_of(labels, id_col, label_col), id_col), id_col, label_col)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and the statistics of every row, ``base_failed``, ``rule`` (the first
    rule that rejects it) and ``kept``.

    Null and empty texts have zero words and fail the base rule.  Rows without a
    label, with a null id or a repeated one are judged like any other; a
    document that stands twice teaches twice.  Without usable labels only the
    base rule judges.  Other columns are left out.
    """
    stats = stored(statistics(docs.select(id_col, text_col), text_col).drop(text_col), "stats")
    return judged(stats, learn_from(stats, labels, id_col))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    Statistics are computed twice, over all rows to learn from and over all rows
    to judge them: a second reading costs less than shuffling the texts to join
    them with labels or verdicts.
    """
    learnt = stored(statistics(docs.select(id_col, text_col), text_col).drop(text_col), "stats")
    rules = learn_from(learnt, labels, id_col)
    stats = statistics(docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text")), "__text")
    # a filter on an unrepeatable column stays above the statistics; pushed
    # below them it would compute each of them once for every use
    once = stats.withColumn("__once", F.monotonically_increasing_id())
    return judged(once, rules).filter("kept and __once >= 0").select("__row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")
