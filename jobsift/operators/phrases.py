"""Dictionary matching in text by token n-gram joins.

Instead of one huge regex alternation per text, texts are split into word
tokens, n-grams up to the longest dictionary entry are generated per text,
and matched with a sort-merge join against the dictionary; neither is broadcast.  Whole texts are processed; nothing is truncated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def _dictionary(vocab: DataFrame, col: str) -> DataFrame:
    """Entries with the words they are matched by: (entry, gram, n)."""
    words = F.regexp_extract_all(F.col(col), F.lit(WORD), 0)
    return vocab.select(F.col(col).alias("entry"), F.array_join(words, " ").alias("gram"), F.size(words).alias("n")) \
        .filter(F.col("n") > 0).groupBy("gram", "n").agg(F.min("entry").alias("entry"))


def _met(grams: DataFrame, dictionary: DataFrame, on) -> DataFrame:
    """Grams joined with the dictionary entries that they are.  Both sides grow
    with the data and their sizes are guessed from the files read, too low for
    exploded grams, so neither may be broadcast: that passes through the driver."""
    return grams.join(dictionary.hint("merge"), on)


def _grams(df: DataFrame, keys: list[str], tokens, dictionary: DataFrame) -> DataFrame:
    """(keys, pos, n, gram): every run of words as long as some dictionary
    entry.  The lengths are a scalar subquery over the dictionary, so no entry
    is too long to be found."""
    lengths = dictionary.select(F.array_sort(F.collect_set("n"))).scalar()
    t = df.select(*keys, tokens.alias("__t"), F.coalesce(lengths, F.array().cast("array<int>")).alias("__lengths"))
    toks = F.col("__t")
    runs = F.transform("__lengths", lambda n: F.when(
        F.size(toks) >= n, F.transform(F.sequence(F.lit(0), F.size(toks) - n), lambda i: F.struct(
            i.alias("pos"), n.alias("n"), F.array_join(F.slice(toks, i + 1, n), " ").alias("gram"))))
        .otherwise(F.array().cast("array<struct<pos:int,n:int,gram:string>>")))
    return t.select(*keys, F.explode(F.flatten(runs)).alias("g")).select(*keys, "g.pos", "g.n", "g.gram")


def first_match(df: DataFrame, keys: list[str], text: str, dictionary: DataFrame, dict_col: str) -> DataFrame:
    """Per text, the dictionary entry that begins first, the longest if
    several do.  Entries may have several words ("Нижний Новгород") or hyphens
    ("Санкт-Петербург"): text and entries are compared word by word."""
    d = _dictionary(dictionary, dict_col)
    g = _grams(df, keys, F.regexp_extract_all(text, F.lit(WORD), 0), d)
    return _met(g, d.select("gram", "entry"), "gram").groupBy(*keys).agg(
        F.min_by("entry", F.struct("pos", (-F.col("n")).alias("n"))).alias("match"))


def extract_ngrams(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, vocab_col: str,
                   stop_words: list[str] | None = None) -> DataFrame:
    """Alphabetic tokens without stop words, their n-grams (over the
    filtered token sequence, as long as the dictionary's entries), matched in
    lower case; distinct (keys, gram) as written.  ``stop_words`` are
    compared in lower case."""
    d = _dictionary(vocab, vocab_col)
    toks = F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: w.rlike(r"^\p{L}+$"))
    if stop_words:
        stops = [w.lower() for w in stop_words]
        toks = F.filter(toks, lambda w: ~F.lower(w).isin(stops))
    g = _met(_grams(df, keys, toks, d), d.select(F.col("gram").alias("__v")), F.lower("gram") == F.col("__v"))
    return g.select(*keys, "gram").distinct()


def extract_phrases(df: DataFrame, keys: list[str], text: str, vocab: DataFrame, vocab_col: str) -> DataFrame:
    """Dictionary phrases in each text, scanned left to right without
    overlaps, the longest phrase winning at a position (Q17); distinct, in
    order of first appearance.  Output (keys, phrases array)."""
    d = _dictionary(vocab, vocab_col)
    g = _grams(df, keys, F.regexp_extract_all(text, F.lit(WORD), 0), d)
    m = _met(g, d.select("gram", "entry"), "gram")
    per_text = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos"), (-F.col("n")).alias("neg_n"), F.col("entry").alias("gram")))).alias("c"))
    init = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        take = x["pos"] >= acc["free"]
        return F.when(take, F.struct((x["pos"] - x["neg_n"]).alias("free"),
                                     F.concat(acc["out"], F.array(x["gram"])).alias("out"))).otherwise(acc)

    walked = F.aggregate("c", init, step)
    return per_text.select(*keys, F.array_distinct(walked["out"]).alias("phrases"))
