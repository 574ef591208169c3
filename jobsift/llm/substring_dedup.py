"""Substring de-duplication: words inside windows that an earlier document has.

Method: a count-min prefilter, then exact grouping of what it lets through.

1. Each block of documents counts its windows in a sketch of two rows of
   saturating counters (0, 1, "2 or more").  The rows are wide - three to six
   cells a window - so the sketch is dealt out by cell range, and a block sends
   each range only the cells it sets.  A range merges the partition sketches by
   adding counters and replies one bit a cell: counted twice or more.  The
   estimate (the lesser of the rows) is never below the count, so no repeated
   window is lost; a few single ones pass.
2. Windows estimated repeated are grouped exactly by a 96-bit key, one entry
   per block and window with the block's smallest document id.  The reply is one
   bit: does another block hold a smaller id?
3. Each block marks the words covered by windows with a smaller id elsewhere.

A window in a third of all rows costs one entry per block.  Nothing is dropped,
capped or sampled; a narrow sketch would only let more windows through.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.words import Hashes, Powers, mix

WINDOW = 50
#: Cells of a sketch row that one key range holds at most.
RANGE_CELLS = 1 << 24
SECOND_BASE = 0xD1342543DE82EF95
ROWS = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
NO_ID = np.iinfo(np.int64).max
NEW = "n_words long, n_removed long, kept_text string"

_hashes, _first, _second = Hashes(), Powers(), Powers(SECOND_BASE)


def _windows(table: pa.Table, text: str, size: int):
    """Word lists, document starts, and hash, document and start of each window."""
    words = [t.split() if t else [] for t in B.texts_of(table, text)]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(counts)
    h = np.concatenate([_hashes.of(w) for w in words]) if len(words) else np.zeros(0, np.uint64)
    key = _first.windows(h, size)
    doc = np.repeat(np.arange(len(words)), np.maximum(counts - size + 1, 0))
    before = np.cumsum(np.maximum(counts - size + 1, 0)) - np.maximum(counts - size + 1, 0)
    start = np.arange(len(doc)) - before[doc] + (ends - counts)[doc]
    return words, ends - counts, h, key[start], doc, start


def _cells(key: np.ndarray, row: int, bits: int):
    return (mix(key ^ ROWS[row]) if row else key) >> np.uint64(64 - bits)


def _edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // parts for i in range(parts + 1)], np.uint64)


def _flagged(key: np.ndarray, got: dict[int, bytes], parts: int, bits: int) -> np.ndarray:
    """Windows whose cells are counted twice or more in both rows."""
    flagged = np.ones(len(key), bool)
    replies = [pickle.loads(got[p]) for p in sorted(got) if p < parts]
    for row in range(len(ROWS)):
        cells, back = np.unique(_cells(key, row, bits), return_inverse=True)
        told = [np.unpackbits(r[row][1], count=r[row][0]).astype(bool) for r in replies]
        told = np.concatenate(told) if told else np.zeros(0, bool)
        flagged &= told[back] if len(cells) else flagged
    return flagged


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _entries(key, other, ids):
    """Distinct windows in order of key, with the smallest id; and each
    window's place among them."""
    order = np.lexsort((ids, other, key))
    k, o = key[order], other[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return k[first], o[first], ids[order][first], place


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``.

    Words are runs of non-white-space.  A word is removed when it lies in a
    window of ``window`` consecutive words whose sequence also starts in a row
    with a smaller id.  ``kept_text``: the other words, joined by one space.

    Null, empty and shorter texts have no window and lose nothing (null: no
    words, ``kept_text`` empty).  A null id counts as larger than any other, so
    such rows keep nothing that an identified row has, and lose nothing to each
    other; rows with equal ids don't take from each other.  An empty table gives
    an empty result.  Input columns with the new names are replaced.
    """
    spark = docs.sparkSession
    packed = B.pack(docs)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 1
    bits = min(60, max(10, int(total // 2).bit_length()))
    parts = max(B.part_count(spark), (1 << bits) // RANGE_CELLS)
    edges = _edges(parts, bits)

    def count(block, table):
        key = _windows(table, text_col, window)[3]
        if not len(key):
            return
        rows = []
        for row in range(len(ROWS)):
            cells, n = np.unique(_cells(key, row, bits), return_counts=True)
            rows.append((cells, n > 1, np.searchsorted(cells, edges)))
        for p in range(parts):
            yield p, pickle.dumps([
                (b - a, B.small(np.diff(cells[a:b], prepend=edges[p])), np.packbits(twice[a:b]))
                for cells, twice, at in rows for a, b in [(at[p], at[p + 1])]])

    def merge(part, asked):
        rows = [[] for _ in ROWS]
        sketch = np.zeros((len(ROWS), int(edges[part + 1] - edges[part])), np.uint8)
        for _, x in asked:
            for row, (n, steps, twice) in enumerate(pickle.loads(x)):
                cells = np.cumsum(steps, dtype=np.int64)
                rows[row].append(cells)
                sketch[row, cells] = np.minimum(sketch[row, cells] + 1 + np.unpackbits(twice, count=n), 2)
        for i, (block, _) in enumerate(asked):
            yield block, pickle.dumps([
                (len(rows[r][i]), np.packbits(sketch[r, rows[r][i]] >= 2)) for r in range(len(ROWS))])

    estimates = B.stored(B.answer(B.ask(packed, count), merge), "sketch")

    def repeated(table, got):
        words, starts, h, key, doc, start = _windows(table, text_col, window)
        at = np.flatnonzero(_flagged(key, got, parts, bits))
        ids = _ids(table, id_col)[doc[at]]
        other = _second.windows(h, window)[start[at]] if len(at) else key[:0]
        return words, starts, start[at], ids, _entries(key[at], other, ids)

    def exact(block, table, got):
        _, _, _, _, (key, other, least, _) = repeated(table, got)
        bounds = B.ranges(parts, key)
        for p in range(parts):
            a, b = bounds[p], bounds[p + 1]
            if b > a:
                yield p + parts, pickle.dumps((key[a:b].astype(np.uint32), other[a:b], least[a:b]))

    def smaller(part, asked):
        got = [pickle.loads(x) for _, x in asked]
        low, other, least = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((low, other))
        first = np.ones(len(order), bool)
        first[1:] = (other[order][1:] != other[order][:-1]) | (low[order][1:] != low[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        lowest = np.minimum.reduceat(least[order], np.flatnonzero(first))
        told = lowest[group] < least
        at = 0
        for (block, _), x in zip(asked, got):
            yield block, pickle.dumps(np.packbits(told[at:at + len(x[1])]))
            at += len(x[1])

    answers = B.answer(B.ask_of(packed, estimates, exact), smaller)

    def cut(block, table, got):
        words, starts, at, ids, (key, _, least, place) = repeated(table, got)
        bounds = B.ranges(parts, key)
        told = [np.unpackbits(pickle.loads(got[p + parts]), count=bounds[p + 1] - bounds[p])
                for p in range(parts) if bounds[p + 1] > bounds[p]]
        told = np.concatenate(told).astype(bool) if told else np.zeros(0, bool)
        gone = at[told[place] | (ids > least[place])] if len(at) else at
        n = int(starts[-1]) + len(words[-1])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        stays = np.cumsum(edge[:n]) == 0
        removed, kept = [], []
        for w, s in zip(words, starts.tolist()):
            keep = stays[s:s + len(w)]
            lost = len(w) - int(keep.sum())
            removed.append(lost)
            kept.append(b" ".join([w[i] for i in np.flatnonzero(keep).tolist()] if lost else w))
        yield from B.add_columns(table, {
            "n_words": pa.array([len(w) for w in words], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return B.apply(packed, estimates.unionByName(answers), cut, B.with_columns(docs.schema, NEW))


def kept_or_text(text: Column) -> Column:
    """The cut text where words were removed, else the text as it was."""
    return F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (
  SELECT doc_id, ws[pos] AS word, pos,
         CASE WHEN pos + 49 <= len(ws) THEN array_to_string(ws[pos:pos + 49], ' ') END AS win FROM p),
g AS (SELECT *, CASE WHEN win IS NOT NULL THEN min(doc_id) OVER (PARTITION BY win) END AS low FROM k),
c AS (
  SELECT doc_id, pos, word,
         max(CASE WHEN low < doc_id THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
r AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept
  FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""
