"""License scans by diagonal voting.

Every run of ``GRAM`` words of every text is hashed, and of ``LONG_GRAM`` words
for templates from ``LONG`` words on; all of these hashes are joined to the
positions at which the templates have the same run; the join also compares the
words, so a hit is exact.  A hit votes for its diagonal: the word number in the
text less that in the template.  Votes are gathered per diagonal, diagonals at
most ``DRIFT`` apart are merged into a span (words put in or left out shift the
rest of a passage to a neighbouring diagonal), and a span is verified by the
share of the template's words that its hits cover.

A span may lack a tenth of its template's words, one at least; never one that
the template has in capitals, which tells it from other licenses'.  Templates
have any length.  They are a small table whose size is checked before it is
broadcast.  Votes are gathered before they are shuffled, so a text costs one row
and one more for each diagonal it hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.words import Hashes, Powers, plain_words

GRAM, LONG_GRAM, LONG = 2, 5, 30
DRIFT = 2
COVER = 0.9
#: Template words that are broadcast at most; positions that one long tells.
TEMPLATE_WORDS, BITS = 100_000, 62

# The phrases that every place of is reported, with their labels.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Notices and whole texts of common licenses, with the labels of the
# method; words in capitals must stand.
NOTICES = [
    ("agpl", "gnu AFFERO general public license"),
    ("apache-2.0", "licensed under the APACHE license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under CC by NC 4 0"),
    ("cc-by-nd", "licensed under CC by ND 4 0"),
    ("cc-by-sa", "licensed under CC by SA 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl-3.0", "licensed under the gnu GENERAL public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect
        or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an
        action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software"""),
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the software the software
        is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("mpl-2.0", "subject to the terms of the MOZILLA public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions"""),
]

_hashes, _powers = Hashes(), Powers()


def _grams(words: list[bytes], k: int) -> np.ndarray:
    return _powers.windows(_hashes.of(words), k).view(np.int64)


def run_length(words: int, k: int = GRAM, k_long: int = LONG_GRAM) -> int:
    """Words of a run of a template of so many words."""
    return k_long if words >= LONG else k


def template_positions(spark: SparkSession, templates: list[tuple[str, str, bool]], k_short: int = GRAM,
                       k_long: int = LONG_GRAM) -> DataFrame:
    """(hash, gram, template, at) of every run of words of the templates."""
    rows = []
    for number, (label, text, _) in enumerate(templates):
        words = plain_words(text.encode())
        k = run_length(len(words), k_short, k_long)
        if len(words) < k:
            raise ValueError(f"{label}: a template has {k} words at least")
        for at, h in enumerate(_grams(words, k).tolist()):
            rows.append((h, b" ".join(words[at:at + k]).decode(), number, at))
    if len(rows) > TEMPLATE_WORDS:
        raise ValueError(f"more than {TEMPLATE_WORDS} template positions to broadcast")
    return spark.createDataFrame(rows, "hash long, gram string, template int, at int")


def rolling_grams(docs: DataFrame, id_col: str, text_col: str, ks: list[int]) -> DataFrame:
    """(row, id, n_words, words, k, grams) of every document, once for each k."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b in B.slices(batch, B.TARGET // 2):
                words = [plain_words(t) for t in B.texts_of(b, text_col)]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                flat = [w for ws in words for w in ws]
                ends = np.cumsum(counts)
                bounds = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
                held = pa.ListArray.from_arrays(bounds(counts), pa.array(flat, pa.binary()).cast(pa.string()))
                for k in ks:
                    grams = _grams(flat, k)
                    # a run that starts at one of the last k - 1 words leaves the document
                    inside = np.arange(len(grams)) <= np.repeat(ends, counts)[:len(grams)] - k
                    yield pa.RecordBatch.from_pydict({
                        "row": b.column("row"), "id": b.column(id_col), "n_words": pa.array(counts), "words": held,
                        "k": pa.array(np.full(len(counts), k, np.int32)),
                        "grams": pa.ListArray.from_arrays(bounds(np.maximum(0, counts - k + 1)), pa.array(grams[inside]))})

    return docs.select(F.monotonically_increasing_id().alias("row"), id_col, text_col).mapInArrow(
        run, f"row long, id {kind}, n_words long, words array<string>, k int, grams array<long>")


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                 text_col: str = "text", k: int = GRAM, drift: int = DRIFT, cover: float = COVER,
                 k_long: int = LONG_GRAM) -> DataFrame:
    """Id, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` and ``spans`` of every row.

    Base phrases are found where their words stand consecutively; ``n_base``
    counts all places and the first and last are the smallest and largest start.
    A span gives its label, start and end (exclusive, in words) and score, the
    covered share of the template.  Spans that lack no more than one word or the
    share that ``cover`` leaves, and none that must stand, add their labels to
    ``labels`` and stand in ``spans``.  ``score`` is the best of all spans.

    Null and empty texts, and texts too short for a run, have no hit: counts
    0, places null, labels empty, score 0.  Repeated rows are scanned one by one;
    an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    templates = [(x, t, True) for x, t in PHRASES] + [
        (x, t, False) for x, t in (NOTICES if notices is None else notices)]
    positions = F.broadcast(template_positions(spark, templates, k, k_long).alias("t"))
    about = []
    for label, text, base in templates:
        words = plain_words(text.encode())
        lower = [w == w.lower() for w in text.split()]
        about.append((label, len(words), base, run_length(len(words), k, k_long), [i for i, x in enumerate(lower) if not x]))
    ks = sorted({a[3] for a in about})
    at = rolling_grams(docs, id_col, text_col, ks).select(
        "row", "id", "n_words", "words", "k", F.posexplode_outer("grams").alias("pos", "hash")).alias("d")
    gram = F.array_join(F.slice(F.col("d.words"), F.col("d.pos") + 1, F.col("d.k")), " ")
    # words are compared where hashes are equal, not as a second key for every run
    same = F.array_contains(F.array(F.col("t.gram")), gram)
    hits = at.join(positions, (F.col("d.hash") == F.col("t.hash")) & same, "left").select(
        "row", "id", "n_words", "template", "pos", "k", "at")
    # the positions hit, as the bits of one long for each ``BITS`` of a template
    votes = hits.groupBy("row", "id", "n_words", "template", (F.col("pos") - F.col("at")).alias("diagonal"), F.floor(
        F.col("at") / BITS).alias("part")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % BITS).cast("int"))).alias("mask"),
        F.min("pos").alias("start"), F.max(F.col("pos") + F.col("k")).alias("end"))
    of = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in about]), F.col("template") + 1)
    must = F.element_at(F.array(*[F.array(*map(F.lit, a[4])).cast("array<int>") for a in about]), F.col("template") + 1)
    votes = votes.select("*", of(0).alias("label"), of(1).alias("length"), of(2).alias("base"), of(3).alias("k"))
    # neighbouring diagonals of a template become one span; a base phrase keeps to one
    line = Window.partitionBy("row", "template").orderBy("diagonal", "part")
    apart = F.col("base") | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line), F.lit(drift + 1)) > drift)
    spans = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(line)).groupBy(
        "row", "id", "n_words", "template", "label", "length", "base", "k", "span").agg(
        F.collect_list(F.struct("part", "mask")).alias("parts"), F.min("start").alias("start"), F.max("end").alias("end"))
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    ats = F.flatten(F.transform("parts", lambda p: F.transform(F.filter(bits, lambda i: F.call_function(
        "getbit", p["mask"], i) == 1), lambda i: (p["part"] * BITS + i).cast("int"))))
    covered = F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(a, a + F.col("k") - 1))))
    spans = spans.withColumn("covered", covered).withColumn("lacking", F.col("length") - F.size("covered")).withColumn(
        "score", F.when(F.col("template").isNotNull(), F.size("covered") / F.col("length")))
    whole = F.size(F.array_except(must, F.col("covered"))) == 0
    near = (F.col("lacking") <= F.greatest(F.lit(1), F.floor((1 - F.lit(cover)) * F.col("length") + 1e-9))) & whole
    is_base = F.col("base") & (F.col("score") == 1.0)
    found = is_base | (~F.col("base") & near)
    joined = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    return spans.groupBy("row", "id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(is_base).alias("base_labels"), joined(found).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, F.struct("start", "end", "label", "score")))).alias("spans"),
    ).withColumnRenamed("id", id_col).drop("row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
