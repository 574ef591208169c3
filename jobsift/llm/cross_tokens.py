"""Alignment of two tokenizers' tokens, by divide and conquer at shared cuts.

Each text is encoded twice, by a byte-level BPE (A) and by a piece model (B);
byte offsets where a token of both ends are shared cuts.  ``shared_cuts`` starts
from whole documents: it takes the A token in the middle of an interval, looks
its end up among the B ends by bisection, moves to the neighbours while that end
is not shared, splits the interval at the cut found and goes on with both halves.
An interval without an inner cut is a leaf: a group of A tokens and the B tokens
that spell the same bytes.  All intervals of a block of documents take a step
together, as numpy arrays, so no Python runs per token.

Corpus-wide numbers of documents that hold an (A id, B id) pair linked come from
Spark: a block writes each distinct pair once with its number of documents, the
pairs are summed and joined back to the blocks that hold them.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.packed_ids import PATTERN, _arrow_type

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block; characters after which a text is cut for encoding;
#: a run of that many characters goes to the library whose cost stays linear.
TARGET, CUT, RUN = 4 << 20, 1 << 20, 20_000
COUNTS = "n_a long, n_b long, n_groups long, n_links long"


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for:
    printable Latin-1 characters are themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """A: ids of ``byte_bpe`` without special tokens."""

    def __init__(self, data: str):
        import tiktoken
        spec = json.loads(data)
        special = {t["content"] for t in spec["added_tokens"]}
        of = byte_symbols()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids must rise with the merges' ranks")
        self.bytes = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for t, i in ranks.items():
            self.bytes[i] = t
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.data, self.long = data, re.compile(r"\s{%d}|\S{%d}" % (RUN, RUN))

    def linear(self, text: str) -> list[int]:
        """The same ids by the library that long runs do not trouble."""
        if isinstance(self.data, str):
            from tokenizers import Tokenizer
            self.data = Tokenizer.from_str(self.data)
            self.data.encode_special_tokens = True
        return self.data.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self.linear(text) if len(text) >= RUN and self.long.search(text) else self.fast.encode_ordinary(text)


class PieceBpe:
    """B: ids of ``pieces``, which puts a space before a text itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else
                      p.replace("▁", " ").encode() for p in names]
        #: no piece goes on over a space after a word: texts may be cut there
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)


class Pair:
    """Both tokenizers, with the byte length of every id."""

    def __init__(self, byte_bpe: str, pieces: bytes):
        self.a, self.b = ByteBpe(byte_bpe), PieceBpe(pieces)
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        #: all tokens' bytes in a row, and where each begins
        self.blobs = [(np.frombuffer(b"".join(t.bytes), np.uint8), np.cumsum(n) - n)
                      for t, n in zip((self.a, self.b), self.lengths)]

    def parts(self, text: str) -> list[str]:
        """A long text, cut before spaces that follow a word: each part but the
        first had a space before it, which both tokenizers see again."""
        out, at = [], 0
        while self.b.cuts and len(text) - at > CUT:
            m = _CUT.search(text, at + CUT)
            if m is None:
                break
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B for all texts in a row, and their numbers a text;
        none where a text has no tokens."""
        parts = [self.parts(t) if t else [] for t in texts]
        flat = iter(self.b.model.encode([p for ps in parts for p in ps], num_threads=1))
        a, b = [], []
        for ps in parts:
            a.append([i for p in ps for i in self.a.encode(" " + p)] if len(ps) != 1 else self.a.encode(" " + ps[0]))
            b.append([i for _ in ps for i in next(flat)] if len(ps) != 1 else next(flat))
        raw = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array(list(map(len, raw)), np.int64)
        ids, counts, same = [], [], np.ones(len(texts), bool)
        for side, lists in enumerate((a, b)):
            n = np.array(list(map(len, lists)), np.int64)
            flat_ids = np.fromiter(chain.from_iterable(lists), np.uint16, int(n.sum()))
            same &= self._spells(side, flat_ids, n, raw, size)
            ids.append(flat_ids)
            counts.append(n)
        for side in (0, 1):
            if not same.all():
                ids[side] = ids[side][np.repeat(same, counts[side])]
                counts[side] = np.where(same, counts[side], 0)
        return (*ids, *counts)

    def _spells(self, side: int, ids: np.ndarray, n: np.ndarray, raw: list[bytes], size: np.ndarray) -> np.ndarray:
        """For each text: do its tokens' bytes make up ``raw``?"""
        blob, start = self.blobs[side]
        length = self.lengths[side][ids]
        upto = np.append(0, np.cumsum(length))
        bounds = upto[np.append(0, np.cumsum(n))]
        spelt = blob[np.repeat(start[ids] - upto[:-1], length) + np.arange(upto[-1])]
        if (np.diff(bounds) == size).all() and np.array_equal(spelt, np.frombuffer(b"".join(raw), np.uint8)):
            return np.ones(len(raw), bool)
        return np.array([spelt[x:y].tobytes() == r for x, y, r in zip(bounds[:-1], bounds[1:], raw)], bool)


_CUT = re.compile(r"(?<=\w) ")


@lru_cache(maxsize=1)
def _pair(byte_bpe: str, pieces: bytes) -> Pair:
    return Pair(byte_bpe, pieces)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> np.ndarray:
    """Is the end of each A token a cut?  ``ends``: rising byte offsets of token
    ends; ``bounds``: token numbers where documents begin, and the total."""
    cut = np.zeros(len(ends_a), bool)
    some = bounds_a[1:] > bounds_a[:-1]
    a0, a1, b0, b1 = bounds_a[:-1][some], bounds_a[1:][some], bounds_b[:-1][some], bounds_b[1:][some]
    cut[a1 - 1] = True
    while len(a0):
        # of one token on a side nothing can be split off
        wide = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[wide], a1[wide], b0[wide], b1[wide]
        middle = (a0 + a1 - 1) // 2
        at, found = np.full(len(a0), -1), np.full(len(a0), -1)
        open_, step = np.arange(len(a0)), 0
        while len(open_):
            # the middle, then one to the right, one to the left, two to the right ...
            m = middle[open_] + ((step + 1) // 2 if step % 2 else -(step // 2))
            inside = (m >= a0[open_]) & (m < a1[open_] - 1)
            i, m = open_[inside], m[inside]
            k = np.searchsorted(ends_b, ends_a[m])
            hit = ends_b[k] == ends_a[m]
            at[i[hit]], found[i[hit]] = m[hit], k[hit]
            step += 1
            reach = (step + 1) // 2
            open_ = open_[(at[open_] < 0) & ((middle[open_] + reach < a1[open_] - 1) | (middle[open_] - reach >= a0[open_]))]
        split = at >= 0
        m, k = at[split], found[split]
        cut[m] = True
        both = [np.stack(x, 1).ravel() for x in ((a0[split], m + 1), (m + 1, a1[split]), (b0[split], k + 1), (k + 1, b1[split]))]
        a0, a1, b0, b1 = both
    return cut


class Aligned:
    """Tokens, groups and links of a run of texts."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        self.a, self.b, self.n_a, self.n_b = pair.encode(texts)
        self.bounds_a, self.bounds_b = (np.append(0, np.cumsum(n)) for n in (self.n_a, self.n_b))
        self.ends_a, self.ends_b = (np.cumsum(n[i]) for n, i in zip(pair.lengths, (self.a, self.b)))
        self.cut = shared_cuts(self.ends_a, self.ends_b, self.bounds_a, self.bounds_b)
        #: per group: numbers of A and B tokens up to its end
        self.upto_a = np.flatnonzero(self.cut) + 1
        self.upto_b = np.searchsorted(self.ends_b, self.ends_a[self.upto_a - 1]) + 1
        self.bounds = np.searchsorted(self.upto_a, self.bounds_a, side="right")
        self.n_groups = np.diff(self.bounds)
        self.n_links = self.n_a + self.n_b - self.n_groups

    def links(self) -> np.ndarray:
        """(A id << 16 | B id) of every link, in text order: each stretch
        between two neighbouring token ends lies in one token of each side."""
        inner = np.ones(len(self.ends_b), bool)
        inner[self.upto_b - 1] = False
        ends = np.sort(np.concatenate((self.ends_a, self.ends_b[inner])), kind="stable")
        a, b = self.a[np.searchsorted(self.ends_a, ends)], self.b[np.searchsorted(self.ends_b, ends)]
        return a.astype(np.uint32) << np.uint32(16) | b

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        n = len(self.a)
        start_a, start_b = np.append(0, self.upto_a)[:-1], np.append(0, self.upto_b)[:-1]
        # a group's A tokens, then its B tokens, each with the mark that follows it
        place_a = np.arange(n) + np.repeat(start_b, self.upto_a - start_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.upto_a, self.upto_b - start_b)
        code = np.zeros(n + len(self.b), np.int64)
        code[place_a], code[place_b] = self.a, self.b
        code[place_a[self.upto_a - 1]] += 1 << 16
        code[place_b[self.upto_b - 1]] += 2 << 16
        table, size = _marked()
        length = size[code]
        flat = table[code][np.arange(table.shape[1]) < length[:, None]].tobytes().decode("ascii")
        at = np.append(0, np.cumsum(length))[self.bounds_a + self.bounds_b].tolist()
        return [flat[x:y - 1] if y > x else "" for x, y in zip(at, at[1:])]


@lru_cache(maxsize=1)
def _marked() -> tuple[np.ndarray, np.ndarray]:
    """Each id followed by each mark: bytes in rows of equal width, and lengths."""
    words = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(1 << 16)]
    return (np.array(words).view(np.uint8).reshape(len(words), -1), np.array([len(w) for w in words], np.int64))


def _vocabularies(spark: SparkSession, byte_bpe: str, pieces: str):
    """Both files (some MB) as the driver has them, for every task."""
    with open(byte_bpe, encoding="utf-8") as f, open(pieces, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def _texts(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: the id, ``ids_a``, ``ids_b`` and ``groups`` (struct of ``n_a``
    and ``n_b``, the tokens of each group in order).

    A null or empty text, and one whose tokens of A or B do not spell a space and
    the text, has no tokens.  Repeated rows are aligned one by one; an empty table
    gives no rows; other columns are left out.
    """
    files = _vocabularies(docs.sparkSession, byte_bpe, pieces)

    def run(batches):
        pair = _pair(*files.value)
        for batch in batches:
            for s in B.slices(batch, TARGET):
                x = Aligned(pair, _texts(s, text_col))
                n_a = np.diff(np.append(0, x.upto_a)).astype(np.int32)
                n_b = np.diff(np.append(0, x.upto_b)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    s.column(id_col), _lists(x.a.astype(np.int32), x.bounds_a), _lists(x.b.astype(np.int32), x.bounds_b),
                    pa.ListArray.from_arrays(pa.array(x.bounds, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(n_a), pa.array(n_b)], ["n_a", "n_b"]))], [id_col, "ids_a", "ids_b", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, ids_a array<int>, ids_b array<int>, groups array<struct<n_a:int,n_b:int>>")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _blocks(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str, text_col: str) -> DataFrame:
    """Stored blocks: ``keys`` and ``docs`` (each distinct pair of the block and
    its number of documents) and ``payload`` (the rows' own numbers, and which of
    the keys each row links how often)."""
    files = _vocabularies(docs.sparkSession, byte_bpe, pieces)

    def run(batches):
        from pyspark import TaskContext
        pair, block = _pair(*files.value), TaskContext.get().partitionId() << 24
        for batch in batches:
            for s in B.slices(batch, TARGET):
                x = Aligned(pair, _texts(s, text_col))
                row = np.repeat(np.arange(len(x.n_a), dtype=np.uint64), x.n_links)
                held, times = np.unique(row << np.uint64(32) | x.links(), return_counts=True)
                keys, index, n = np.unique(held.astype(np.uint32), return_inverse=True, return_counts=True)
                rows = np.searchsorted(held >> np.uint64(32), np.arange(len(x.n_a) + 1, dtype=np.uint64))
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.groups()]
                payload = pa.RecordBatch.from_arrays(
                    [s.column(id_col), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links)), pa.array(digest, pa.string()),
                     _lists(B.small(index), rows), _lists(B.small(times), rows)],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "index", "times"])
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block], pa.int64()), "keys": pa.array([keys.astype(np.int64)], pa.list_(pa.int64())),
                    "docs": pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                    "payload": pa.array([B._dump([payload])], pa.binary())})
                block += 1

    return B.stored(docs.select(id_col, text_col).mapInArrow(
        run, "block long, keys array<long>, docs array<int>, payload binary"), "aligned")


def alignment_counts(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links`` (pairs of
    tokens whose bytes overlap), ``n_best`` (links whose pair is in as many
    documents as any pair of its A id), ``count_sum`` (numbers of documents that
    hold the pair, over the links) and ``groups_sha256``.

    Rows without tokens (``alignments``) have zeros and an empty digest.  Every
    row counts as a document, repeated ones too; an empty table gives no rows.
    """
    blocks = _blocks(docs, byte_bpe, pieces, id_col, text_col)
    asked = blocks.select("block", F.posexplode(F.arrays_zip("keys", "docs")).alias("i", "p")).select(
        "block", "i", F.col("p.keys").alias("key"), F.col("p.docs").alias("n"))
    # at most as many rows to an A id as B has ids
    of_a = Window.partitionBy(F.shiftright("key", 16))
    counts = asked.groupBy("key").agg(F.sum("n").alias("c")).select(
        F.col("key").alias("__key"), "c", (F.col("c") == F.max("c").over(of_a)).alias("best"))
    answers = asked.join(counts, F.col("key") == F.col("__key")).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("i", "c", "best"))).alias("got")).select(
        F.col("block").alias("__block"), F.col("got.c").alias("c"), F.col("got.best").alias("best"))
    both = blocks.select("block", "payload").join(answers, F.col("block") == F.col("__block"), "left").select(
        "payload", "c", "best")
    kind = _arrow_type(docs, id_col)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                payload, c, best = (batch.column(k)[at] for k in range(3))
                t = B.load(payload.as_py())
                c, best = ((x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)) for x in (c, best))
                index, times = (t.column(n).combine_chunks() for n in ("index", "times"))
                bounds = index.offsets.to_numpy().astype(np.int64)
                index = index.values.to_numpy().astype(np.int64)
                times = times.values.to_numpy().astype(np.int64)
                sums = [np.diff(np.append(0, np.cumsum(times * x[index]))[bounds]) if len(index) else np.zeros(t.num_rows, np.int64)
                        for x in (best.astype(np.int64), c)]
                yield pa.RecordBatch.from_arrays(
                    [t.column("id").combine_chunks().cast(kind), *(t.column(n).combine_chunks() for n in ("n_a", "n_b", "n_groups", "n_links")),
                     *map(pa.array, sums), t.column("groups_sha256").combine_chunks()],
                    [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return both.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {COUNTS}, n_best long, "
                                "count_sum long, groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
