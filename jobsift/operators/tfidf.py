"""TF-IDF cosine similarity as joins on a long token table (K2, K3).

Weights follow the usual smoothed TF-IDF: raw term counts times
``ln((1 + n) / (1 + df)) + 1``, L2-normalised per document (MLlib's IDF
lacks the ``+ 1``, so it is not used).  Tokens are lower-cased runs of two or
more word characters.

Top-k search never builds a document x document matrix: documents meet only
through shared tokens.  Queries with few candidates meet them in an equi join on
``(scope, token)``; for others the candidates of the scope stream past blocks of
queries, which keep their best (``best_pairs``), so pairs are not written.  Each
distinct text is scored once under its smallest id (titles and skill strings
repeat heavily); only ids are shuffled, and of a text's ids only those that can
reach a top k are joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.functions.text import let, tokens
from jobsift.session import materialize

# ranking uses scores rounded to this many places, so that sums of the same
# products merged in another order cannot swap tied candidates
RANK_DIGITS = 9


def _toks(text: str, tokens_col: str | None):
    return F.col(tokens_col) if tokens_col else tokens(text)


def token_counts(docs: DataFrame, key: list[str], text: str, tokens_col: str | None = None) -> DataFrame:
    """(key..., token, tf) for every token of every document (``tokens_col``:
    an already tokenised array column to use instead of ``text``)."""
    return (docs.select(*key, F.explode(_toks(text, tokens_col)).alias("token"))
            .groupBy(*key, "token").agg(F.count("*").alias("tf")))


def fit_idf(corpus: DataFrame, doc_id: str, text: str, scope: list[str] | None = None,
            tokens_col: str | None = None) -> DataFrame:
    """(scope..., token, idf) fitted on the corpus."""
    scope = list(scope or [])
    d = corpus.select(*scope, doc_id, text, *([tokens_col] if tokens_col else [])).filter(F.col(text).isNotNull())
    df_ = (d.select(*scope, doc_id, F.explode(F.array_distinct(_toks(text, tokens_col))).alias("token"))
           .groupBy(*scope, "token").agg(F.count("*").alias("__df")))
    if scope and scope != ["__scope"]:
        j = df_.join(d.groupBy(*scope).agg(F.count("*").alias("__n")), scope)
    else:  # one corpus: the document count is a scalar subquery, not a join
        j = df_.withColumn("__n", d.select(F.count("*")).scalar())
    return j.select(*scope, "token", (F.log((1 + F.col("__n")) / (1 + F.col("__df"))) + 1).alias("idf"))


def weigh(docs: DataFrame, doc_key: list[str], text: str, idf: DataFrame,
          scope: list[str] | None = None, tokens_col: str | None = None) -> DataFrame:
    """Normalised weights of ``docs`` under a fitted ``idf``: (doc_key..., token, w)."""
    scope = list(scope or [])
    tc = token_counts(docs.filter(F.col(text).isNotNull()), doc_key, text, tokens_col)
    w = tc.join(idf, scope + ["token"]).select(*doc_key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    # the norm is a window over one document's tokens (bounded), one shuffle
    # instead of an aggregate joined back
    doc = Window.partitionBy(*doc_key)
    return w.select(*doc_key, "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc))).alias("w"))


#: products of a token's queries and candidates that one task makes at most
PAIRS_PER_TASK = 2_000_000


def dealt(q: DataFrame, c: DataFrame, keys: list[str], by: str,
          pairs_per_task: int = PAIRS_PER_TASK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys`` with ``__part``, and the keys with it.

    The join output of a key is the product of its rows on both sides, not the
    bytes shuffled.  A key whose product exceeds ``pairs_per_task`` is split into
    as many parts as that needs: its rows of ``c`` are dealt out by ``by`` and its
    rows of ``q`` copied to each part.  Other keys, which are nearly all, are
    neither dealt nor copied.  Both sides are repartitioned to a fixed count, so
    that AQE, which sees bytes, can't put the parts of a key back into one task.
    """
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = F.ceil(F.col("__nq") / pairs_per_task * F.col("__nc")).cast("int")
    hot = q.groupBy(*keys).agg(F.count("*").alias("__nq")).join(
        c.groupBy(*keys).agg(F.count("*").alias("__nc")), keys).select(*keys, parts.alias("__parts")).filter("__parts > 1")
    q = q.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    c = c.join(hot, keys, "left").withColumn("__part", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int"))
    keys = [*keys, "__part"]
    return q.drop("__parts").repartition(n, *keys), c.drop("__parts").repartition(n, *keys), keys


def cosine_pairs(qw: DataFrame, cw: DataFrame, qid: str, cid: str, scope: list[str],
                 pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """Cosine of every (query, candidate) pair sharing at least one token; hot
    tokens are split (``dealt``), partial sums are aggregated map-side."""
    q, c, keys = dealt(qw.select(*scope, F.col(qid).alias("__q"), "token", F.col("w").alias("__wq")),
                       cw.select(*scope, F.col(cid).alias("__c"), "token", F.col("w").alias("__wc")),
                       [*scope, "token"], "__c", pairs_per_task)
    return (q.join(c, keys).groupBy(*scope, "__q", "__c").agg(F.sum(F.col("__wq") * F.col("__wc")).alias("score"))
            .withColumnRenamed("__q", qid).withColumnRenamed("__c", cid))


#: candidates that a query's tokens bring in at most to be scored by a join
FIRST = 100
#: scores closer than this may swap when they are rounded for ranking
CLOSE = 10.0 ** (1 - RANK_DIGITS)
#: queries that a block holds at most, and at least where a scope is cut up to keep all cores busy
MOST_QUERIES, LEAST_QUERIES = 100_000, 200


def _entries(weights: DataFrame, key: list[str]) -> DataFrame:
    """(key..., __tokens, __weights), a row for each document."""
    e = weights.groupBy(*key).agg(F.collect_list(F.struct("token", "w")).alias("__e"))
    return e.select(*key, F.transform("__e", lambda x: x["token"]).alias("__tokens"),
                    F.transform("__e", lambda x: x["w"]).alias("__weights"))


def _search(k: int):
    """One task: of every cell its queries come first, then candidates by rising
    id.  Held are the queries, their ``k`` best so far and one batch of
    candidates, by token."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def flat(rows, name):
            lists = rows.column(name).combine_chunks() if isinstance(rows, pa.Table) else rows.column(name)
            return lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)

        class Cell:
            def __init__(self, key, queries):
                rows = pa.Table.from_batches(queries)
                tokens, self.ends = flat(rows, "__tokens")
                words = tokens.dictionary_encode()
                self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
                self.w = flat(rows, "__weights")[0].to_numpy(zero_copy_only=False)
                self.key, self.ids, self.seen = key, rows.column("__q").combine_chunks(), 0
                none = np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
                self.kept, self.least = [none] * len(self.ids), np.full(len(self.ids), -np.inf)

            def meet(self, rows):
                tokens, ends = flat(rows, "__tokens")
                words = tokens.dictionary_encode()
                code = words.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[order]
                w = flat(rows, "__weights")[0].to_numpy(zero_copy_only=False)[order]
                cut = np.r_[0, np.cumsum(np.bincount(code, minlength=len(words.dictionary)))]
                place = pc.fill_null(pc.index_in(self.words, value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)[self.word]
                ids = rows.column("__c").to_numpy(zero_copy_only=False)
                score = np.zeros(rows.num_rows)
                for q in range(len(self.ids)):
                    score[:] = 0.0
                    for i in range(self.ends[q], self.ends[q + 1]):
                        at = place[i]
                        if at >= 0:
                            score[doc[cut[at]:cut[at + 1]]] += self.w[i] * w[cut[at]:cut[at + 1]]
                    found = np.flatnonzero(score > max(0.0, self.least[q] - CLOSE))
                    if not len(found):
                        continue
                    got = score[found]
                    if len(found) > k:
                        near = got >= np.partition(got, -k)[-k] - CLOSE
                        found, got = found[near], got[near]
                    key, at, kept, cid = self.kept[q]
                    key, at = np.r_[key, np.round(got, RANK_DIGITS)], np.r_[at, found + self.seen]
                    kept, cid = np.r_[kept, got], np.r_[cid, ids[found].astype(object)]
                    best = np.lexsort((at, -key))[:k]
                    self.kept[q] = key[best], at[best], kept[best], cid[best]
                    if len(best) == k:
                        self.least[q] = key[best[-1]]
                self.seen += rows.num_rows

            def result(self, kind):
                step = max(1, 100_000 // k)
                for lo in range(0, len(self.ids), step):
                    some = self.kept[lo:lo + step]
                    row = np.repeat(np.arange(lo, lo + len(some)), [len(x[0]) for x in some])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), self.key[0])), self.ids.take(pa.array(row)),
                        pa.array(np.concatenate([x[3] for x in some]), kind), pa.array(np.concatenate([x[2] for x in some]))],
                        names=["__s", "__q", "__c", "score"])

        cell, queries, key, kind = None, [], None, None
        for batch in batches:
            kind = batch.schema.field("__c").type
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("__s", "__b", "__role")], 1)
            edges = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)] if len(at) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                rows, now = batch.slice(lo, hi - lo), tuple(at[lo, :2])
                if now != key:
                    if cell:
                        yield from cell.result(kind)
                    cell, queries, key = None, [], now
                if at[lo, 2] == 0:
                    queries.append(rows)
                elif cell or queries:
                    cell = cell or Cell(now, queries)
                    cell.meet(rows)
        if cell:
            yield from cell.result(kind)
    return run


def blocked_pairs(qw: DataFrame, cw: DataFrame, qid: str, cid: str, scope: list[str], k: int,
                  most: int = MOST_QUERIES, least: int = LEAST_QUERIES) -> DataFrame:
    """(scope..., qid, cid, score): for every query the ``k`` best of the
    candidates that share a token, by rounded score and id.

    A scope's queries lie in blocks, a task's work each; its candidates stream
    past every block.  No pair is written but those of a block's result, and a
    candidate is sent twice the number of cores at most, as long as a block does
    not hold ``most`` queries.  (Time stays queries x candidates of a scope.)
    """
    spark = qw.sparkSession
    busy = 2 * spark.sparkContext.defaultParallelism
    q = materialize(_entries(qw, [*scope, qid]))
    c = materialize(_entries(cw.join(q.select(*scope).distinct(), scope, "left_semi"), [*scope, cid]))
    sizes = q.groupBy(*scope).agg(F.count("*").alias("__nq")).join(c.groupBy(*scope).agg(F.count("*").alias("__nc")), scope)
    sizes = materialize(sizes.withColumn("__work", F.col("__nq").cast("double") * F.col("__nc")).withColumn(
        "__s", F.monotonically_increasing_id()))
    share = F.ceil(busy * F.col("__work") / (sizes.agg(F.sum("__work")).first()[0] or 1.0))
    blocks = F.greatest(F.ceil(F.col("__nq") / most), F.least(F.ceil(F.col("__nq") / least), share)).cast("int")
    cells = sizes.select(*scope, "__s", blocks.alias("__blocks"))
    block, every = F.pmod(F.xxhash64(qid), F.col("__blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    rest = ["__tokens", "__weights"]
    q = q.join(cells, scope).select("__s", block.alias("__b"), F.lit(0).alias("__role"), F.col(qid).alias("__q"),
                                    F.lit(None).cast(c.schema[cid].dataType).alias("__c"), *rest)
    c = c.join(cells, scope).select("__s", every.alias("__b"), F.lit(1).alias("__role"),
                                    F.lit(None).cast(q.schema["__q"].dataType).alias("__q"), F.col(cid).alias("__c"), *rest)
    n = max(busy, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    found = q.unionByName(c).repartition(n, "__s", "__b").sortWithinPartitions("__s", "__b", "__role", "__c").mapInArrow(
        _search(k), f"__s long, __q {q.schema['__q'].dataType.simpleString()}, "
                    f"__c {c.schema['__c'].dataType.simpleString()}, score double")
    return found.join(sizes.select(*scope, "__s"), "__s").select(
        *scope, F.col("__q").alias(qid), F.col("__c").alias(cid), "score")


def best_pairs(qw: DataFrame, cw: DataFrame, qid: str, cid: str, scope: list[str], k: int,
               first: int = FIRST) -> DataFrame:
    """(scope..., qid, cid, score): pairs that hold the ``k`` best candidates of
    every query, each with its exact cosine.

    A query whose tokens bring in ``first`` candidates or fewer is scored by a
    join on the tokens, others in blocks (``blocked_pairs``), so that the pairs
    written are bounded by the queries however common a token is.
    """
    keys = [*scope, "token"]
    every = Window.partitionBy(*scope, qid)
    q = materialize(qw.join(cw.groupBy(*keys).agg(F.count("*").alias("__nc")), keys).select(
        *scope, qid, "token", "w", (F.sum("__nc").over(every) <= first).alias("__few")))
    cw = materialize(cw)
    few = cosine_pairs(q.filter("__few"), cw, qid, cid, scope)
    many = q.filter("NOT __few").drop("__few")
    return few.select(*scope, qid, cid, "score").unionByName(blocked_pairs(many, cw, qid, cid, scope, k))


def tfidf_top_k(queries: DataFrame | None, corpus: DataFrame, k: int, *, qid: str = "query_id",
                cid: str = "vacancy_id", text: str = "text", scope: list[str] | None = None,
                exclude_self: bool = False, tokens_col: str | None = None, k_col: str | None = None,
                first: int = FIRST) -> DataFrame:
    """K2: the k most cosine-similar corpus documents per query.

    ``queries`` (scope..., qid, text) and ``corpus`` (scope..., cid, text);
    candidates are matched inside the same scope and IDF is fitted on the
    corpus of the scope.  When fewer than k candidates share a token, the
    rest are filled with zero-score candidates in id order, as a brute-force
    k-NN would return.  ``k_col``: a column of ``queries`` with the query's own k,
    ``k`` at most.  Output: (scope..., qid, cid, score, rank), rank from 1.
    """
    scope = list(scope or [])
    if not scope:  # one global scope: a constant key keeps every join an equi join
        q = queries.withColumn("__scope", F.lit(0)) if queries is not None else None
        out = tfidf_top_k(q, corpus.withColumn("__scope", F.lit(0)), k, qid=qid, cid=cid, text=text,
                          scope=["__scope"], exclude_self=exclude_self, tokens_col=tokens_col, k_col=k_col, first=first)
        return out.drop("__scope")
    extra = [tokens_col] if tokens_col else []
    corpus = corpus.select(*scope, F.col(cid).alias("__cid"), F.col(text).alias("__text"), *extra) \
        .filter(F.col("__text").isNotNull())
    self_search = queries is None
    own_k = (F.col(k_col) if k_col else F.lit(k)).alias("__k")
    queries = corpus.select(*scope, F.col("__cid").alias("__qid"), "__text", F.lit(k).alias("__k")) if self_search else \
        queries.select(*scope, F.col(qid).alias("__qid"), F.col(text).alias("__text"), own_k).filter(F.col("__text").isNotNull())
    idf = fit_idf(corpus, "__cid", "__text", scope, tokens_col)

    # a text goes by its smallest id
    ctexts = corpus.groupBy(*scope, "__text").agg(
        F.min("__cid").alias("__c"), *([F.first(tokens_col).alias("__toks")] if tokens_col else []))
    qtexts = queries.groupBy(*scope, "__text").agg(F.min("__qid").alias("__q"))
    cw = weigh(ctexts, [*scope, "__c"], "__text", idf, scope, "__toks" if tokens_col else None)
    qw = cw.withColumnRenamed("__c", "__q") if self_search else weigh(qtexts, [*scope, "__q"], "__text", idf, scope)
    best = F.round("score", RANK_DIGITS).desc()

    def top(df, by, second, n, rank):
        w = Window.partitionBy(*scope, by).orderBy(best, F.col(second).asc())
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)

    # ordered by (score desc, smallest id of the text), an id in a query's top
    # k belongs to one of the first k texts (k + 1 when the query's own id is
    # left out), and is among the k (k + 1) smallest ids of that text
    keep = k + (1 if exclude_self else 0)
    texts = top(best_pairs(qw, cw, "__q", "__c", scope, keep, first), "__q", "__c", keep, "__t").drop("__t")
    lowest = Window.partitionBy(*scope, "__text").orderBy("__cid")
    ids = corpus.select(*scope, "__text", "__cid").withColumn("__r", F.row_number().over(lowest)) \
        .filter(F.col("__r") <= keep).join(ctexts.select(*scope, "__text", "__c"), [*scope, "__text"]) \
        .select(*scope, "__c", "__cid")
    scored = texts.join(ids, [*scope, "__c"]).select(*scope, "__q", "__cid", "score")
    # zero-overlap padding: the lowest ids of the scope
    first = Window.partitionBy(*scope).orderBy("__cid")
    pads = qtexts.select(*scope, "__q").join(corpus.select(*scope, "__cid").withColumn(
        "__r", F.row_number().over(first)).filter(F.col("__r") <= keep).drop("__r"), scope).select(
        *scope, "__q", "__cid", F.lit(0.0).alias("score"))
    found = scored.unionByName(pads).groupBy(*scope, "__q", "__cid").agg(F.max("score").alias("score"))
    found = top(found, "__q", "__cid", keep, "rank")
    # texts are expanded to their queries last
    out = queries.join(qtexts, [*scope, "__text"]).select(*scope, "__qid", "__q", "__k").join(found, [*scope, "__q"])
    if exclude_self:
        out = top(out.filter(F.col("__qid") != F.col("__cid")).drop("rank"), "__qid", "__cid", k, "rank")
    return out.filter(F.col("rank") <= F.col("__k")).select(*scope, F.col("__qid").alias(qid), F.col("__cid").alias(cid), "score", "rank")


def _counted(toks) -> Column:
    """Entries (token, count) of an array of tokens: runs of the sorted array."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(st, lambda p, n: F.struct(
            F.get(s, p).alias("token"), (F.coalesce(F.get(st, n + 1), F.size(s)) - p).cast("double").alias("n"))))

    none = F.array().cast("array<struct<token:string,n:double>>")
    return F.when(F.size(toks) > 0, let(F.sort_array(toks), runs)).otherwise(none)


def text_cosine(left, right, empty_vocab_null: bool = True) -> Column:
    """K3: TF-IDF cosine of two texts with the vectoriser fitted on the pair.

    With two documents a shared token has idf 1 and any other token
    ``1 + ln(1.5)``, so the cosine has a closed form over the two token counts:
    one expression per pair, no token table.  A side without tokens (a null text
    has none) gives 0; both sides without tokens give null (the vectoriser would
    fail: empty vocabulary) unless ``empty_vocab_null`` is False.
    """
    other = 1.0 + math.log(1.5)

    def toks(c):
        return F.coalesce(tokens(c), F.array().cast("array<string>"))

    def cosine(ab):
        a, b = ab["a"], ab["b"]

        def norm(x, y):
            shared = F.transform(y, lambda e: e["token"])
            return F.aggregate(x, F.lit(0.0), lambda acc, e: acc + F.pow(e["n"] * F.when(
                F.array_contains(shared, e["token"]), 1.0).otherwise(other), 2))

        both = F.map_from_entries(b)
        dot = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["n"] * F.coalesce(
            F.try_element_at(both, e["token"]), F.lit(0.0)))
        empty = F.lit(None).cast("double") if empty_vocab_null else F.lit(0.0)
        return F.when((F.size(a) == 0) & (F.size(b) == 0), empty).when(
            (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / F.sqrt(norm(a, b) * norm(b, a)))

    return let(F.struct(_counted(toks(left)).alias("a"), _counted(toks(right)).alias("b")), cosine)


def pair_cosine(pairs: DataFrame, left_text: str, right_text: str, key: list[str],
                empty_vocab_null: bool = True) -> DataFrame:
    """K3 for every row of ``pairs``: key..., cos."""
    return pairs.select(*key, text_cosine(left_text, right_text, empty_vocab_null).alias("cos"))
