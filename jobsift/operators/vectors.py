"""Dense vectors: exact blocked top-k (K1, K4), LSH (K6), k-means (K7),
mean similarity to a history (K9) and embedding reuse (K10).

Exact top-k compares every query with every corpus vector.  Queries lie in
blocks, a task each; the corpus streams through every task in record batches,
one float64 matrix product at a time, against a running top-k per query.  What a
task holds and what it writes is bounded by its queries, not by the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.functions.text import let, tokens
from jobsift.operators.running import overall_ranks
from jobsift.session import materialize

RANK_DIGITS = 9


def l2_normalise(v) -> Column:
    """Unit vector (float64); a zero vector stays zero."""
    v = (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    # bound once: inside the lambda it would be worked out for every element
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def dot(a, b) -> Column:
    """Inner product of two equal-length numeric arrays (JVM side)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


#: queries that one task holds, and (queries x k) entries of its running result
ROWS_PER_BLOCK, KEPT_PER_BLOCK = 10_000, 2_500_000
_FOUND = "qid long, cid long, score double, rank int"


def _rows(batch: pa.RecordBatch, normalise: bool):
    """(ids, float64 rows, bucket numbers) of a record batch."""
    ids = batch.column("__id").to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(batch.column("__v").flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(ids), -1)
    norm = pc.fill_null(batch.column("__n"), 0.0).to_numpy(zero_copy_only=False)[:, None]
    if normalise:
        x = np.divide(x, norm, out=np.zeros_like(x), where=(norm > 0) | np.isnan(norm))
    at = None
    if "__at" in batch.schema.names:
        at = batch.column("__at").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), -1)
        # an inner product that is 1 - d^2 / 2 of the euclidean distance d, for zero vectors too
        gap = (1.0 - (norm > 0)) / 2
        one, role = np.ones((len(ids), 1)), batch.column("__role")[0].as_py()
        x = np.hstack([x, one, gap] if role == 0 else [x, gap, one])
    return ids, x, at


def _best(row, key, cid, score, k):
    """Per row the k best by (key falling, cid): sorted (row, key, cid, score)."""
    order = np.lexsort((cid, -key, row))
    row = row[order]
    starts = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(starts, np.arange(len(row)), 0))
    keep = place < k
    order = order[keep]
    return row[keep], key[order], cid[order], score[order], place[keep] + 1


def _search(k: int, largest: bool, exclude_self: bool, normalise: bool, above: float | None = None, q_chunk: int = 256):
    """One task: its queries come first, then corpus vectors by rising id.

    A running top-k per query is held, nothing of the corpus but one batch.  Ids
    rise, so a later vector counts only if its rounded score is above the k-th
    best so far; those few are put aside and merged when they have grown to as
    many as the result holds.
    """
    sign = 1.0 if largest else -1.0

    def run(batches):
        qids, qx, qat, parts = None, None, None, []
        kept = pend = thr = None
        waiting = 0

        def merge():
            nonlocal kept, pend, waiting
            kept = _best(*[np.concatenate([c, *[p[i] for p in pend]]) for i, c in enumerate(kept[:4])], k)
            pend, waiting = [], 0
            full = kept[4] == k
            thr[kept[0][full]] = kept[1][full]

        def meet(ids, x, at):
            nonlocal waiting
            xt = np.ascontiguousarray(x.T)
            for lo in range(0, len(qids), q_chunk):
                hi = min(lo + q_chunk, len(qids))
                s = (qx[lo:hi] @ xt) * sign if sign < 0 else qx[lo:hi] @ xt
                if exclude_self:
                    left, right = np.searchsorted(ids, qids[lo:hi]), np.searchsorted(ids, qids[lo:hi], "right")
                    while (own := np.flatnonzero(left < right)).size:
                        s[own, left[own]] = -np.inf
                        left[own] += 1
                if above is not None:
                    s[s <= above] = -np.inf
                t = thr[lo:hi]
                if at is not None and np.isneginf(t).any():
                    share = np.zeros(s.shape, bool)
                    for j in range(at.shape[1]):
                        share |= qat[lo:hi, j][:, None] == at[:, j][None, :]
                    s[~share] = -np.inf
                first = np.flatnonzero(np.isneginf(t))
                low = t + 0.4 * 10.0 ** -RANK_DIGITS
                if first.size and s.shape[1] > k:  # only what can be among the k best of this batch
                    clean = np.where(np.isfinite(s[first]), s[first], -np.inf)
                    low[first] = np.partition(clean, -k, axis=1)[:, -k] - 2 * 10.0 ** -RANK_DIGITS
                r, c = np.divmod(np.flatnonzero(s > low[:, None]), s.shape[1])
                got = s[r, c]
                key = np.round(got, RANK_DIGITS)
                ok = (key > t[r]) & np.isfinite(got)
                if at is not None:
                    ok &= (qat[lo + r] == at[c]).any(axis=1)
                r, c, got, key = r[ok], c[ok], got[ok], key[ok]
                if len(r) > 2 * k * (hi - lo):
                    r, key, cid, got, _ = _best(r, key, ids[c], got, k)
                else:
                    cid = ids[c]
                pend.append((r + lo, key, cid, got))
                waiting += len(r)
            if waiting >= len(qids) * k or np.isneginf(thr).any():
                merge()

        for batch in batches:
            role = batch.column("__role").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(role, 1))
            if cut:
                parts.append(_rows(batch.slice(0, cut), normalise))
            if cut == batch.num_rows or not parts and qids is None:
                continue
            if qids is None:
                qids, qx = np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])
                qat = np.vstack([p[2] for p in parts]) if parts[0][2] is not None else None
                thr, pend, parts = np.full(len(qids), -np.inf), [], []
                kept = tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.float64, np.int64))
            meet(*_rows(batch.slice(cut), normalise))
        if qids is None:
            return
        merge()
        # rows that share a query id share its k places
        numbers, back = np.unique(qids, return_inverse=True)
        row, _, cid, score, place = _best(back[kept[0]], *kept[1:4], k)
        for lo in range(0, len(row), 100_000):
            hi = lo + 100_000
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers[row[lo:hi]]), pa.array(cid[lo:hi]), pa.array(score[lo:hi] * sign + 0.0),
                pa.array(place[lo:hi].astype(np.int32))], names=["qid", "cid", "score", "rank"])
    return run


def _cell_top_k(k: int, largest: bool, exclude_self: bool, q_chunk: int = 256, c_chunk: int = 8192):
    """A task's search over one pandas cell: rows of ``__role`` 0 (queries) and 1."""
    search = _search(k, largest, exclude_self, False, q_chunk=q_chunk)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pa.RecordBatch.from_pandas(pdf.sort_values(["__role", "__id"]).assign(__n=1.0), preserve_index=False)
        found = list(search(rows.slice(lo, c_chunk) for lo in range(0, rows.num_rows, c_chunk)))
        empty = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])
        return pa.Table.from_batches(found, empty).to_pandas()
    return run


def blocks_for(df: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """Number of blocks so that one block holds about ``rows_per_block`` rows
    (one count; the block size, not the data, bounds a task's memory)."""
    n = df.count()
    return max(1, -(-n // rows_per_block))


def _vectors(df: DataFrame, ident: str, vec: str, normalise: bool, *more: Column) -> DataFrame:
    """(__id, __v, __n, more...): vectors as they are, floats staying floats, and
    their norm.  A row without a vector takes no part."""
    double = F.col(vec).cast("array<double>")
    kind = df.schema[vec].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda acc, x: acc + x * x)) if normalise else F.lit(1.0)
    return df.filter(F.col(vec).isNotNull()).select(F.col(ident).cast("long").alias("__id"), (F.col(vec) if plain else double).alias("__v"),
                                                    norm.alias("__n"), *more)


def _searched(q: DataFrame, c: DataFrame, blocks: int, run) -> DataFrame:
    """Blocks of queries and the corpus rows sent to them (``__b``), a task each."""
    cells = q.withColumn("__role", F.lit(0)).unionByName(c.withColumn("__role", F.lit(1)))
    return cells.repartitionById(blocks, "__b").sortWithinPartitions("__role", "__id").drop("__b").mapInArrow(run, _FOUND)


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "query_id",
                cid: str = "vacancy_id", vec: str = "vec", query_blocks: int | None = None,
                corpus_blocks: int | None = None, largest: bool = True, exclude_self: bool = False,
                normalise: bool = True, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """K1 (largest) / K4 (smallest) exact top-k by inner product.

    Output (qid, cid, score, rank).  Ties break by candidate id.  Block counts
    default to what keeps a block of queries under ``rows_per_block`` rows and
    the cluster busy; a task's memory depends on the block, not on the corpus,
    which streams through.  (Exact search still compares every pair; its time
    is quadratic, the longest task's grows as the corpus.)
    """
    most = max(1, min(rows_per_block, KEPT_PER_BLOCK // k))
    if query_blocks is None:
        query_blocks = default_blocks(queries.sparkSession, queries, most)
    if corpus_blocks is None:  # few queries: the corpus is shared out as well
        busy = 2 * queries.sparkSession.sparkContext.defaultParallelism
        corpus_blocks = 1 if 2 * query_blocks > busy else max(1, min(-(-busy // query_blocks), blocks_for(corpus, rows_per_block)))
    q = _vectors(queries, qid, vec, normalise)
    c = _vectors(corpus, cid, vec, normalise)
    own = [F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int") for n in (query_blocks, corpus_blocks)]
    every = [F.sequence(F.lit(0), F.lit(n - 1)) for n in (query_blocks, corpus_blocks)]
    q = q.withColumn("__b", F.explode(F.transform(every[1], lambda x: x * query_blocks + own[0])))
    c = c.withColumn("__b", F.explode(F.transform(every[0], lambda x: own[1] * query_blocks + x)))
    out = _searched(q, c, query_blocks * corpus_blocks, _search(k, largest, exclude_self, normalise))
    if corpus_blocks > 1:
        order = F.round("score", RANK_DIGITS)
        w = Window.partitionBy("qid").orderBy(order.desc() if largest else order.asc(), F.col("cid").asc())
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("qid").alias(qid), F.col("cid").alias(cid), "score", "rank")


def lsh_top_k(queries: DataFrame, corpus: DataFrame, k: int, *, qid: str = "query_id", cid: str = "vacancy_id",
              vec: str = "vec", bucket_length: float = 0.7, num_tables: int = 6, seed: int = 42,
              max_distance: float = 2.0, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """K6: approximate top-k by cosine with random-projection LSH on unit
    vectors (euclidean d^2 = 2 - 2 cos), candidates re-ranked exactly.

    A candidate shares a bucket of some table with the query.  Queries lie in
    blocks along their buckets; a corpus vector goes once to each block that has
    one of its buckets, and meets there the queries that share one.  So no
    candidate pair is written out, or found once per table.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def prep(df, idc):
        return _vectors(df, idc, vec, True, array_to_vector(l2_normalise(vec)).alias("features"))

    qa, ca = prep(queries, qid), prep(corpus, cid)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                        numHashTables=num_tables, seed=seed).fit(ca)
    at = F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("long")).alias("__at")
    # as in MLlib's join, rows that repeat count once
    q, c = [materialize(model.transform(x).select("__id", "__v", "__n", at).distinct()) for x in (qa, ca)]
    most = max(1, min(rows_per_block, KEPT_PER_BLOCK // k))
    blocks = default_blocks(queries.sparkSession, q, most)
    size = F.greatest(F.ceil(q.select(F.count("*")).scalar() / blocks), F.lit(1))
    q = overall_ranks(q, ["__at", "__id", "__v"], "__rank")
    q = materialize(q.withColumn("__b", F.floor((F.col("__rank") - 1) / size).cast("int")).drop("__rank"))
    bucket = F.posexplode("__at").alias("__table", "__bucket")
    held = q.select("__b", bucket).distinct()
    sent = c.select("__id", "__at").distinct().select("__id", "__at", bucket).join(held, ["__table", "__bucket"]) \
        .select("__id", "__at", "__b").distinct()
    c = c.join(sent, ["__id", "__at"]).select(*q.columns)
    # MLlib's join is below the distance, not at it
    out = _searched(q, c, blocks, _search(k, True, False, True, above=1 - max_distance * max_distance / 2))
    # rows of one query id may lie in several blocks
    w = Window.partitionBy("qid").orderBy(F.round("score", RANK_DIGITS).desc(), F.col("cid").asc())
    out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("qid").alias(qid), F.col("cid").alias(cid), "score", "rank")


def kmeans_labels(df: DataFrame, features: list[str], k: int, seed: int = 42, id_col: str = "vacancy_id",
                  max_iter: int = 20) -> DataFrame:
    """K7: MLlib k-means over assembled features; (id, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select(id_col, "cluster")


def mean_similarity_to_history(candidates: DataFrame, history: DataFrame, vectors: DataFrame,
                               user: str = "user_id", item: str = "vacancy_id") -> DataFrame:
    """K9: average cosine of each candidate to the user's history, every acted
    row counting, the first row of the candidate itself left out; 0 when
    nothing is left.

    The mean of the products is the product with the sum: a user's history
    becomes one summed vector, less the candidate's own where it was acted on,
    so vectors are copied once per user and not once per history row.
    """
    v = vectors.select(F.col(item).alias(item), l2_normalise("vec").alias("__v"))
    # three branches read the counts: the history is grouped once
    acts = materialize(history.groupBy(user, item).agg(F.count("*").alias("__n"))).join(v, item)
    sums = acts.select(user, "__n", F.posexplode("__v").alias("__i", "__x")).groupBy(user, "__i").agg(
        F.sum(F.col("__n") * F.col("__x")).alias("__x")).groupBy(user).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias("__sum"))
    total = acts.groupBy(user).agg(F.sum("__n").alias("__rows"))
    c = candidates.select(user, item).distinct()
    j = c.join(v, item).join(sums.join(total, user), user, "left") \
        .join(acts.select(user, item, F.lit(1).alias("__own")), [user, item], "left")
    own = F.coalesce(F.col("__own"), F.lit(0))
    left = F.col("__rows") - own
    mean = F.when(left > 0, (dot("__v", "__sum") - own * dot("__v", "__v")) / left).otherwise(F.lit(0.0))
    return c.join(j.select(user, item, mean.alias("mean_sim")), [user, item], "left") \
        .select(user, item, F.coalesce(F.col("mean_sim"), F.lit(0.0)).alias("mean_sim"))


def texts_to_embed(texts: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts (keyed by md5) that the embedding store lacks."""
    keyed = texts.select(F.md5(F.col(text)).alias("text_hash"), text).filter(F.col(text).isNotNull())
    return keyed.groupBy("text_hash").agg(F.count("*").alias("n_rows")) \
        .join(store.select("text_hash").distinct(), "text_hash", "left_anti")


def default_blocks(spark, df: DataFrame | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """Blocks of queries: as many as keep the cluster's cores busy twice, if
    there are rows enough, and never fewer than the size bound needs."""
    busy = 2 * spark.sparkContext.defaultParallelism
    return max(blocks_for(df, rows_per_block), min(busy, blocks_for(df, 200))) if df is not None else busy


def embed_texts(df: DataFrame, text: str, encoder=None, batch_size: int = 256, prefix: str = "",
                dim: int = 64) -> DataFrame:
    """K8: vectors of the distinct texts of ``text``: (text, vec), each text
    encoded once, with ``prefix`` put before it.

    Without an encoder: word counts hashed into ``dim`` buckets, unit length
    (MLlib's HashingTF and Normalizer; a text without words is a zero vector).
    A caller's encoder (list[str] -> 2-D array) runs in Arrow batches inside
    ``mapInPandas`` on the executors.
    """
    distinct = df.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).distinct()
    if encoder is None:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array
        words = distinct.select("text", tokens(F.concat(F.lit(prefix), F.col("text"))).alias("__w"))
        counted = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dim).transform(words)
        return Normalizer(inputCol="__tf", outputCol="__n").transform(counted).select(
            "text", vector_to_array("__n").alias("vec"))

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[s:s + batch_size]
                vecs = encoder([prefix + t for t in chunk["text"].tolist()])
                yield pd.DataFrame({"text": chunk["text"].to_numpy(), "vec": list(np.asarray(vecs, dtype=np.float64))})

    return distinct.mapInPandas(run, schema="text string, vec array<double>")
