"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns each block of training documents into an index segment:
for every term (64-bit word hash) the sorted list of its places in the block.
Places count words through the block with a gap between documents, so no
phrase reaches from one document into the next.  Segments are stored rows; all
tokens of all documents are in them.

``search`` sends blocks of benchmark phrases to all segments.  A segment looks up
how often it has each term, drops phrases with an absent term, and takes the
lists of the rest from the rarest term on: each list, moved back by the term's
offset, is intersected with the starts still possible.  What is left after the
last term are the exact matches.  A proximity match is a place of the rarest
term that has every other term of the phrase within ``len + slop`` words.

Segments are made and searched without a shuffle: matches of a document lie in
the segment that holds it.  The phrases are sent in pieces of a fixed number of
words, so the size of what is broadcast is bounded.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.words import Hashes, plain_words

WINDOW = 13
SLOP = 5
GAP = 4096
#: Benchmark words that one search sends to the segments at most (an item
#: longer than that is sent alone).
QUERY_WORDS = 1 << 20

_hashes = Hashes()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored segments (block, ids, n_words, payload): the block's documents,
    its terms, and each term's sorted places."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for b in B.slices(batch, B.TARGET):
                words = [plain_words(t) for t in B.texts_of(b, text_col)]
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                starts = np.cumsum(lengths + GAP) - lengths - GAP
                terms = np.concatenate([_hashes.of(w) for w in words])
                places = np.arange(len(terms)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
                order = np.argsort(terms, kind="stable")
                terms = terms[order]
                first = np.flatnonzero(np.append(np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1]))
                payload = pickle.dumps((starts, terms[first], B.small(np.append(first, len(order))),
                                        places[order].astype(np.uint32)))
                ends = pa.array([0, b.num_rows], pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number], pa.int64()),
                    "ids": pa.ListArray.from_arrays(ends, b.column(id_col)),
                    "n_words": pa.ListArray.from_arrays(ends, pa.array(lengths)),
                    "payload": pa.array([payload], pa.binary())})
                number += 1

    return B.stored(docs.select(id_col, text_col).mapInArrow(
        run, f"block long, ids array<{kind}>, n_words array<long>, payload binary"), "index")


class Segment:
    """Postings of one block."""

    def __init__(self, payload: bytes):
        self.starts, self.terms, self.first, self.places = pickle.loads(payload)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each term in the segment, and how often it occurs (0: absent)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        row = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        n = np.diff(self.first.astype(np.int64))[row]
        return row, np.where(self.terms[row] == terms, n, 0)

    def postings(self, row: int) -> np.ndarray:
        return self.places[self.first[row]:self.first[row + 1]].astype(np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def exact(segment: Segment, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Starts of a phrase, from its rarest term to its commonest."""
    starts = None
    for j in np.argsort(counts, kind="stable").tolist():
        moved = segment.postings(rows[j]) - j
        if starts is None:
            starts = moved
        elif len(starts) * 20 < len(moved):
            at = np.minimum(np.searchsorted(moved, starts), len(moved) - 1)
            starts = starts[moved[at] == starts]
        else:
            starts = np.intersect1d(starts, moved, assume_unique=True)
        if not len(starts):
            break
    return starts


def near(segment: Segment, rows: np.ndarray, counts: np.ndarray, slop: int) -> np.ndarray:
    """Places of the rarest term that have every other term within the
    phrase's length and ``slop`` words, on either side."""
    reach = len(rows) + slop
    order = np.argsort(counts, kind="stable").tolist()
    places = segment.postings(rows[order[0]])
    for j in order[1:]:
        if not len(places):
            break
        other = segment.postings(rows[j])
        at = np.searchsorted(other, places)
        after = other[np.minimum(at, len(other) - 1)] - places
        before = places - other[np.maximum(at - 1, 0)]
        places = places[((after >= 0) & (after <= reach)) | ((before >= 0) & (before <= reach))]
    return places


def _phrases(items: list[tuple[str, list[bytes]]], window: int):
    """Distinct terms of the items; and of each phrase its item, and its term
    numbers in one flat array with their bounds."""
    number: dict[int, int] = {}
    named, flat, ends = [], [], [0]
    for item, words in items:
        codes = [number.setdefault(h, len(number)) for h in _hashes.of(words).tolist()]
        for at in range(max(1, len(codes) - window + 1)):
            named.append(item)
            flat += codes[at:at + window]
            ends.append(len(flat))
    return np.array(list(number), np.uint64), named, np.array(flat), np.array(ends)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def search(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Matches of the items' windows in every document of the index: (block,
    doc: place in the block, item, kind, spans).  ``kind`` is exact or near;
    spans are [start, end) in words of the document: those that exact matches
    cover, or the rarest term of each proximity match."""
    if window + slop >= GAP:
        raise ValueError("a phrase must be shorter than the gap between documents")
    sent = index.sparkSession.sparkContext.broadcast(_phrases(items, window))

    def run(batches):
        terms, named, flat, ends = sent.value
        for block, payload in B.rows_of(batches):
            s = Segment(payload)
            rows, counts = s.find(terms)
            found: dict[tuple, list] = {}
            for i in np.flatnonzero(np.minimum.reduceat(counts[flat], ends[:-1])).tolist():
                codes = flat[ends[i]:ends[i + 1]]
                for kind, places, n in (("exact", exact(s, rows[codes], counts[codes]), len(codes)),
                                        ("near", near(s, rows[codes], counts[codes], slop), 1)):
                    docs = s.document(places)
                    for d, p in zip(docs.tolist(), (places - s.starts[docs]).tolist()):
                        found.setdefault((d, named[i], kind), []).append((p, p + n))
            if found:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * len(found), pa.int64()),
                    "doc": pa.array([k[0] for k in found], pa.int32()),
                    "item": pa.array([k[1] for k in found]),
                    "kind": pa.array([k[2] for k in found]),
                    "spans": pa.array([_merged(x) for x in found.values()],
                                      pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return index.select("block", "payload").mapInArrow(
        run, "block long, doc int, item string, kind string, spans array<struct<start:long,end:long>>")


def _pieces(benchmark: DataFrame, id_col: str, text_col: str):
    """Items as (id, words), in pieces of at most ``QUERY_WORDS`` words."""
    held, size = [], 0
    for item, text in benchmark.select(
            F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        words = plain_words((text or "").encode())
        if not words:
            continue
        if held and size + len(words) > QUERY_WORDS:
            yield held
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  slop: int = SLOP) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit`` (words inside exact matches),
    ``items`` and ``near_items`` (sorted ids of items with exact and with
    proximity matches), ``spans`` (merged [start, end) word ranges of the exact
    matches) and ``contaminated`` (n_hit > 0 and 20 n_hit >= n_words).

    A null or empty text has no words and no match; an item without words has no
    window, one shorter than a window is one phrase.  Repeated rows and repeated
    ids are judged row by row; repeated items count once, by id; an item without
    an id is named by the empty string.  An empty benchmark finds nothing.
    """
    return judge(build_index(docs, id_col, text_col), benchmark, id_col, item_col, item_text, window, slop)


def judge(index: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
          item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """``decontaminate`` with an index that is already built."""
    found = [search(index, items, window, slop) for items in _pieces(benchmark, item_col, item_text)]
    rows = index.select("block", F.posexplode(F.arrays_zip("ids", "n_words")).alias("doc", "x")).select(
        "block", "doc", F.col("x.ids").alias(id_col), F.col("x.n_words").alias("n_words"))
    empty = F.array().cast("array<string>")
    no_spans = F.array().cast("array<struct<start:long,end:long>>")
    if found:
        exactly = F.col("kind") == "exact"
        hits = reduce(DataFrame.unionByName, found).groupBy("block", "doc").agg(
            F.sort_array(F.collect_set(F.when(exactly, F.col("item")))).alias("items"),
            F.sort_array(F.collect_set(F.when(~exactly, F.col("item")))).alias("near_items"),
            F.sort_array(F.flatten(F.collect_list(F.when(exactly, F.col("spans"))))).alias("spans"))
        rows = rows.join(hits, ["block", "doc"], "left")
    else:
        rows = rows.withColumns({"items": empty, "near_items": empty, "spans": no_spans})
    # spans of several items may overlap: count words beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                          lambda a, x: F.struct(
                              (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).alias("n"),
                              F.greatest(a["end"], x["end"]).alias("end")))["n"]
    return rows.select(
        id_col, "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"), F.coalesce("items", empty).alias("items"),
        F.coalesce("near_items", empty).alias("near_items"), F.coalesce("spans", no_spans).alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns.  The
    verdict follows from the text, so rows are told by its digest; the index is
    deleted once the contaminated digests are stored."""
    keyed = docs.withColumn("__key", F.md5(F.col(text_col).cast("binary")))
    index = build_index(keyed, "__key", text_col)
    bad = B.stored(judge(index, benchmark, "__key").filter("contaminated").select("__key").distinct(), "contaminated")
    B.dropped(index)
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bs AS (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s
       FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM bs),
ds AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s
       FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n),
o AS (SELECT doc_id, s, ds.n, item FROM ds JOIN bw ON bw.n = ds.n AND bw.win = array_to_string(ws[s:s + ds.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
