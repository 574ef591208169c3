"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints within ``d = 3`` bits agree on one of four 16-bit blocks and, in
the other 48 bits, on one of four 12-bit blocks, so each distinct fingerprint
is dealt to 16 buckets in which every linked pair meets at least once.  The
fingerprints of a bucket are sorted by Gray rank (neighbours in that order
differ in few bits) and cut into runs of 16, runs of runs, and so on.  A node
keeps the bits that all below it share, less those its parent has factored out;
a search walks down, adds up differences in the shared bits only, and drops a
node with all below it as soon as the sum exceeds ``d``.  At the leaves the sum
is the Hamming distance itself.  Bucket links are thinned to a spanning star at
once, and components join them across buckets.

Copies meet as one fingerprint: a group of copies costs one row after a
partial aggregation, however large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsift.llm import blocks as B
from jobsift.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
FAN_OUT = 16
QUERIES_AT_ONCE = 1024


def fingerprint(text: bytes | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: those set in over half of the shingles' XXH64 values."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, seed)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0] + after[:len(words) - k].tolist()
    ends = (after[k - 1:] - 1).tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 50_000):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:at + 50_000], ends[at:at + 50_000])),
                        ">u8", min(50_000, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``__fp`` (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            for b in B.slices(batch, B.TARGET):
                fp = np.fromiter((fingerprint(t, shingle) for t in B.texts_of(b, text_col)), np.uint64, b.num_rows)
                yield from B.add_columns(pa.Table.from_batches([b]), {"__fp": pa.array(fp.view(np.int64))})

    return docs.mapInArrow(run, B.with_columns(docs.schema, "__fp long"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over codes sorted by (bucket, Gray rank)."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fan_out: int = FAN_OUT):
        self.fan_out = fan_out
        self.order = np.lexsort((gray_rank(codes), bucket))
        self.codes, b = codes[self.order], bucket[self.order]
        self.first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(self.first, len(b)))
        self.of = np.repeat(np.arange(len(sizes)), sizes)  # bucket of each item
        # levels[0] are the items: (start of a bucket's nodes, count, shared bits, their values, last item + 1)
        full = np.full(len(b), ~np.uint64(0))
        self.levels = [(self.first, sizes, full, self.codes, np.arange(1, len(b) + 1))]
        both, some = self.codes, self.codes
        while len(sizes) and self.levels[-1][1].max() > 1:
            start, count, _, _, last = self.levels[-1]
            n = -(-count // fan_out)
            at = np.concatenate(([0], np.cumsum(n)[:-1]))
            own = np.repeat(np.arange(len(n)), n)
            local = np.arange(len(own)) - at[own]
            child = start[own] + local * fan_out
            both, some = np.bitwise_and.reduceat(both, child), np.bitwise_or.reduceat(some, child)
            end = last[np.minimum(start[own] + count[own], child + fan_out) - 1]
            self.levels.append((at, n, both | ~some, both, end))

    def links(self, d: int, queries: np.ndarray):
        """Pairs (i, j), i < j in index order, within ``d`` bits, for items i."""
        i = queries
        top = len(self.levels) - 1
        start, _, mask, value, _ = self.levels[top]
        node = start[self.of[i]]
        diff = np.bitwise_count((self.codes[i] ^ value[node]) & mask[node]).astype(np.int64)
        for level in range(top - 1, -1, -1):
            start, count, mask, value, last = self.levels[level]
            up_start, _, up_mask, _, _ = self.levels[level + 1]
            own = self.of[i]
            child = start[own] + (node - up_start[own]) * self.fan_out
            n = np.minimum(self.fan_out, start[own] + count[own] - child)
            again = np.repeat(np.arange(len(i)), n)
            step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            parent, node = node[again], child[again] + step
            later = last[node] > i[again] + 1 if level else node > i[again]
            again, parent, node = again[later], parent[later], node[later]
            i, diff = i[again], diff[again]
            fresh = mask[node] & ~up_mask[parent]  # bits that the parent has not yet compared
            diff = diff + np.bitwise_count((self.codes[i] ^ value[node]) & fresh)
            near = diff <= d
            i, node, diff = i[near], node[near], diff[near]
        return (i, node) if top else (i[:0], node[:0])


def _stars(bucket: np.ndarray, codes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each class of codes linked within some bucket."""
    b, inverse, n = np.unique(bucket, return_inverse=True, return_counts=True)
    shared = n[inverse] > 1
    index = GrayIndex(bucket[shared], codes[shared])
    values, node = np.unique(index.codes, return_inverse=True)
    label = np.arange(len(values))
    for at in range(0, len(index.codes), QUERIES_AT_ONCE):
        i, j = index.links(d, np.arange(at, min(at + QUERIES_AT_ONCE, len(index.codes))))
        a, c = node[i], node[j]
        while True:
            la, lc = label[a], label[c]
            apart = la != lc
            if not apart.any():
                break
            a, c, la, lc = a[apart], c[apart], la[apart], lc[apart]
            np.minimum.at(label, np.maximum(la, lc), np.minimum(la, lc))
            while (label[label] != label).any():
                label = label[label]
    hung = np.flatnonzero(label != np.arange(len(label)))
    return values[hung], values[label[hung]]


def _buckets(fp):
    """The 16 buckets of a fingerprint, each as one long: which blocks were
    taken (8 bits) and their 28 bits."""
    out = []
    for block in range(4):
        high = F.shiftrightunsigned(fp, 16 * block).bitwiseAND(F.lit(0xFFFF))
        # the 48 bits left when the block is cut out
        low = fp.bitwiseAND(F.lit((1 << 16 * block) - 1))
        rest = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * block), 16), 16 * block).bitwiseOR(low)
        for part in range(4):
            value = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            out.append(F.shiftleft(F.lit(4 * block + part).cast("long"), 28).bitwiseOR(
                F.shiftleft(high, 12)).bitwiseOR(value))
    return F.array(*out)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (``__fp``) -> links (a, b) that join exactly the
    classes of fingerprints linked by ``distance`` or fewer differing bits."""
    if not 0 <= distance <= 3:
        raise ValueError("the blocks find pairs within three bits at most")
    dealt = prints.select(F.explode(_buckets(F.col("__fp"))).alias("bucket"), "__fp").repartition("bucket")

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        bucket, codes = (np.concatenate(x) for x in zip(*got))
        a, b = _stars(bucket, codes.view(np.uint64), distance)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return dealt.mapInArrow(run, "a long, b long")


def classes(slim: DataFrame, id_col: str, distance: int = DISTANCE) -> DataFrame:
    """Stored rows with ``__fp`` -> the same rows with ``__root`` (one value a
    class) and ``component_id``."""
    prints = slim.groupBy("__fp").agg(F.min(id_col).alias("__least"))
    hung = components(links(prints, distance)).withColumnRenamed("a", "__fp")
    rooted = B.stored(prints.join(hung, "__fp", "left").select(
        "__fp", "__least", F.coalesce("root", "__fp").alias("__root")), "rooted")
    least = rooted.groupBy("__root").agg(F.min("__least").alias("component_id"))
    return slim.join(rooted.select("__fp", "__root").join(least, "__root"), "__fp")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Null and white-space-only texts have the fingerprint zero and are linked
    like any other; a text of fewer words than a shingle is one shingle.  The
    component is the smallest id reachable; null ids are passed over (null when
    a class has no other).  Repeated rows stay, each with the same class.  An
    empty table gives an empty result.
    """
    slim = B.stored(fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, "__fp"), "prints")
    return classes(slim, id_col, distance).select(
        id_col, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id (null
    last; of rows that repeat an id, the one with the smallest hash of its
    text, and one of those that repeat the text as well).

    Only ids, text hashes and fingerprints are stored; the rows are picked from
    ``docs`` by id and text hash.
    """
    keyed = docs.withColumn("__hash", F.xxhash64(text_col))
    slim = B.stored(fingerprints(keyed.select(id_col, text_col, "__hash"), text_col).select(
        id_col, "__hash", "__fp"), "prints")
    first = classes(slim, id_col).groupBy("__root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("x"), F.col(id_col).alias("y"), F.col("__hash").alias("z"))).alias("k"))
    # null ids are joined as a value of their own
    key = {"__id": F.coalesce(F.col(id_col), F.lit(0)), "__none": F.col(id_col).isNull()}
    kept = first.select(F.coalesce("k.y", F.lit(0)).alias("__id"), F.col("k.x").alias("__none"), F.col("k.z").alias("__hash"))
    keys = ["__id", "__none", "__hash"]
    repeat = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    return keyed.withColumns(key).join(kept, keys, "left_semi").withColumn("__repeat", repeat).filter(
        "__repeat = 1").select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
