"""Running sums, rank correlations, pruned search, ranking metrics and stores
against brute force, with bins and parts made small enough to be used."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.operators import encoders, running, stats, tfidf
from jobsift.plans import evaluate as ev
from jobsift.plans import recommend as rc
from jobsift.plans import training as tr
from jobsift.sources import io
from jobsift.sources.embeddings import EmbeddingStore


def brute_running(rows):
    out, sums = [], {}
    for k, a, b, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        out.append((k, a, b, sums[k]))
    return out


@pytest.mark.parametrize("per_task", [1, 7, 1000])
def test_running_sums_of_a_hot_group(spark, per_task):
    rng = random.Random(per_task)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randint(0, 40) / 2, i, rng.randint(-5, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, a double, b int, v long").repartition(5)
    got = running.running_sums(df, ["k"], ["a", "b"], {"s": F.col("v"), "n": F.lit(1).cast("long")}, per_task)
    assert got.columns == ["k", "a", "b", "v", "s", "n"]
    got = sorted((r.k, r.a, r.b, r.s) for r in got.collect())
    assert got == sorted(brute_running(rows))


def test_bins_follow_the_order_and_are_even(spark):
    df = spark.range(4000).select(F.lit(0).alias("k"), (F.col("id") * 7919 % 4001).alias("x"))
    b = running.binned(df, ["k"], ["x"], per_task=100).groupBy("__bin").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("__bin").collect()
    assert len(b) == 40 and sum(r.n for r in b) == 4000
    assert all(p.hi < q.lo for p, q in zip(b, b[1:])) and max(r.n for r in b) < 800


def test_ranks_of_empty_and_single_rows(spark):
    empty = spark.createDataFrame([], "k int, x int")
    assert running.group_ranks(empty, ["k"], ["x"]).collect() == []
    assert [tuple(r) for r in running.overall_ranks(spark.createDataFrame([(5,)], "x int"), ["x"], "r").collect()] == [(5, 1)]


def test_label_codes_over_bins(spark, monkeypatch):
    monkeypatch.setattr(running.group_ranks, "__defaults__", ("rank", 3))
    df = spark.createDataFrame([(f"v{i % 23:02d}",) for i in range(60)] + [(None,)], "c string")
    got = {r.c: r.c_encoder for r in encoders.label_encode(df, "c").collect()}
    assert got.pop(None) is None and got == {f"v{i:02d}": i for i in range(23)}


def brute_tau(x, y):
    n, lead, tx, ty = len(x), 0, 0, 0
    for i, j in itertools.combinations(range(n), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        lead, tx, ty = lead + a * b, tx + (a == 0), ty + (b == 0)
    n0 = n * (n - 1) / 2
    return lead / math.sqrt((n0 - tx) * (n0 - ty))


def brute_rho(x, y):
    def ranks(v):
        return [(sum(b < a for b in v) + sum(b <= a for b in v) + 1) / 2 for a in v]
    return float(np.corrcoef(ranks(x), ranks(y))[0, 1])


@pytest.mark.parametrize("per_task", [11, 100000])
def test_rank_correlations_of_continuous_columns(spark, per_task):
    rng = random.Random(9)
    rows = []
    for i in range(220):
        a = round(rng.gauss(0, 1), 2)
        rows.append((a, None if i % 9 == 0 else round(a + rng.gauss(0, 2), 1), rng.randint(1, 4), 1.0))
    df = spark.createDataFrame(rows, "a double, b double, c int, flat double")
    tau = {(r.col_a, r.col_b): r.tau_b for r in stats.kendall_tau_b(df, ["a", "b", "c", "flat"], per_task).collect()}
    rho = {(r.col_a, r.col_b): r.rho for r in stats.spearman(df, ["a", "b", "c", "flat"], per_task).collect()}
    for i, j in itertools.combinations(range(4), 2):
        names = ("a", "b", "c", "flat")[i], ("a", "b", "c", "flat")[j]
        known = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        x, y = zip(*known)
        if "flat" in names:
            assert tau[names] is None and rho[names] is None
        else:
            assert abs(tau[names] - brute_tau(x, y)) < 1e-9 and abs(rho[names] - brute_rho(x, y)) < 1e-9


def test_rank_correlations_without_rows_run_no_job_early(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert [tuple(r) for r in stats.spearman(df, ["a", "b"]).collect()] == [("a", "b", None)]
    assert [tuple(r) for r in stats.kendall_tau_b(df, ["a", "b"]).collect()] == [("a", "b", None)]
    bad = df.select(F.raise_error(F.lit("evaluated")).cast("double").alias("a"), "b")
    stats.spearman(bad, ["a", "b"]), stats.kendall_tau_b(bad, ["a", "b"])  # nothing runs before an action


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 200):
        u, v, w = rng.integers(0, 30, n), rng.integers(0, 20, n), rng.integers(1, 1 << 30, n)
        want = sum(int(w[i]) * int(w[j]) for i in range(n) for j in range(n) if u[i] < u[j] and v[i] > v[j])
        assert stats.inversions(u, v, w) == want


def search(spark, first, k=4, **options):
    rng = random.Random(12)
    words = [f"rare{i}" for i in range(60)] + ["common"] * 40 + ["usual"] * 25 + ["often"] * 10
    docs = [(i, i % 2, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(300)]
    docs += [(300 + i, 1, docs[5][2]) for i in range(20)]
    c = spark.createDataFrame(docs, "vacancy_id long, area int, text string")
    q = c.filter("vacancy_id % 3 = 0").select(F.col("vacancy_id").alias("query_id"), "area", "text", F.lit(2).alias("own"))
    out = tfidf.tfidf_top_k(q, c, k, scope=["area"], first=first, **options)
    return sorted((r.area, r.query_id, r.rank, r.vacancy_id, round(r.score, 9)) for r in out.collect())


def test_pruned_search_gives_the_same_rows(spark):
    plain = search(spark, 10 ** 9)
    for first in (0, 5, 60):
        assert search(spark, first) == plain
    assert search(spark, 5, k_col="own") == [r for r in plain if r[2] <= 2]


def test_pruned_search_scores_fewer_pairs(spark, monkeypatch):
    made = []
    pairs = tfidf.cosine_pairs

    def counted(*args, **kwargs):
        out = pairs(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(tfidf, "cosine_pairs", counted)
    search(spark, 10 ** 9)
    whole = sum(made)
    made.clear()
    search(spark, 30)
    assert sum(made) < whole


def test_ranking_metrics(spark):
    rows = [(u, i, float((i * 7 + u) % 5), bool((i + u) % 3 == 0)) for u in range(4) for i in range(25)] + [(9, 1, 1.0, False), (9, 2, None, None)]
    df = spark.createDataFrame(rows, "user_id int, vacancy_id int, score double, relevant boolean")
    aps, ndcgs = [], []
    for u in range(4):
        rel = [r for _, _, r in sorted((-s, i, r) for x, i, s, r in rows if x == u)]
        hits = [n for n, r in enumerate(rel, 1) if r]
        aps.append(sum((j + 1) / n for j, n in enumerate(hits)) / len(hits))
        ndcgs.append(sum(1 / math.log2(n + 1) for n in hits if n <= 10) / sum(1 / math.log2(n + 1) for n in range(1, min(10, len(hits)) + 1)))
    got = ev.ranking_metrics(df).first()
    assert got.n_users == 4 and abs(got.map - np.mean(aps)) < 1e-12 and abs(got.ndcg - np.mean(ndcgs)) < 1e-12
    assert tuple(ev.ranking_metrics(df.filter("user_id = 9")).first()) == (0, None, None)


def test_pairs_of_a_user_with_many_true_items(spark):
    pred = spark.createDataFrame([(u, v, r) for u in (1, 2) for r, v in enumerate((7, 8), 1)], "user_id int, vacancy_id int, rank int")
    truth = spark.createDataFrame([(1, i, i) for i in range(40)] + [(2, 5, 1), (3, 5, 1)], "user_id int, vacancy_id int, pos int")
    got = ev.truth_pred_pairs(pred, truth, per_task=9)
    want = [(u, i, p, v, r) for u, i, p in [(1, i, i) for i in range(40)] + [(2, 5, 1)] for r, v in enumerate((7, 8), 1)]
    assert sorted((r.user_id, r.a, r.true_pos, r.b, r.pred_rank) for r in got.collect()) == sorted(want)


def test_threshold_sweep_counts_strictly_greater_distances(spark):
    sims = [0.5, 0.49, 0.3, 0.2, 0.0, 0.31]
    feats = spark.createDataFrame([(1, i, True, *[s] * 6) for i, s in enumerate(sims)],
                                  "a int, b int, found boolean, " + ", ".join(f"{c} double" for c in ev.FEATURES))
    pairs = spark.createDataFrame([(u, 1, i) for u in (1, 2, 3) for i in range(len(sims)) if i % u == 0], "user_id int, a int, b int")
    got = {round(r.threshold, 2): r.median_rate for r in ev.threshold_sweep(pairs, feats).collect()}
    for t, rate in got.items():
        rates = sorted(sum(1 - sims[i] > t for i in range(6) if i % u == 0) / sum(i % u == 0 for i in range(6)) for u in (1, 2, 3))
        assert rate == pytest.approx(rates[1])


def test_candidate_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rc.running_sums, "__defaults__", (5,))
    rng = random.Random(1)
    cat = [(i, rng.choice(["a", "b", None]), rng.randint(1, 4), rng.randint(1, 20) * 1000) for i in range(200)]
    req = [(i, rng.choice(["a", "b", "c", rc.EVERYWHERE]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 5000.0, 5000.5, 20000.0, 30000.0])) for i in range(60)]
    got = rc.candidate_counts(spark.createDataFrame(req, "request_id int, area string, max_code int, floor double"),
                              spark.createDataFrame(cat, "vacancy_id int, area_id string, exp_code int, salary long"))
    want = {r: sum((a == rc.EVERYWHERE or a == x) and (m is None or c <= m) and (f is None or s >= f) for _, x, c, s in cat) for r, a, m, f in req}
    assert {r.request_id: r.n_cand for r in got.collect()} == want


def test_embedding_store_encodes_only_what_is_new(spark):
    store, seen = EmbeddingStore(spark, io.scratch_path(spark, "store")), []

    def texts(*t):
        return spark.createDataFrame([(x,) for x in t], "text string")

    assert store.load().count() == 0 and store.update(texts("a one", "a one", "b two", None), dim=8) == 2
    first = store.load().collect()
    assert store.update(texts("b two", "c three"), dim=8) == 1 and store.update(texts("a one", None), dim=8) == 0
    assert store.versions() == [1, 2] and store.load(1).count() == 2 and store.load().count() == 3
    assert {r.text: r.vec is not None for r in store.vectors(texts("a one", "zzz")).collect()} == {"a one": True, "zzz": False}
    store.compact()
    assert store.versions() == [3] and store.load().count() == 3
    assert {tuple(r.vec) for r in first} <= {tuple(r.vec) for r in store.load().collect()}
    with pytest.raises(ValueError):
        store.load(1)


def test_prefix_file_is_joined_on_dataset_names(spark):
    path, prefixes = io.scratch_path(spark, "data"), io.scratch_path(spark, "prefixes")
    spark.createDataFrame([(i, f"d{i % 3}", "t") for i in range(9)], "id long, source string, text string").write.partitionBy("source").json(path)
    spark.createDataFrame([('{"d0": "query: ", "d1": "", "gone": "x"}',)], "value string").write.text(prefixes)
    rows = io.read_by_prefix(spark, path, prefixes, 2, "id", "id BIGINT, text STRING").collect()
    assert sorted((r.name, r.prefix) for r in rows) == [("d0", "query: ")] * 2 + [("d1", "")] * 2


def test_train_test_pairs(spark):
    acts = [(1, 1, 10, 3), (1, 1, 11, 1), (1, 2, 12, 3), (1, 2, 12, 1), (2, 3, 10, 3), (2, 3, 11, 3), (2, 3, 12, 1), (3, 4, 13, 3), (3, 4, 13, 1)]
    def frame(rows):
        return spark.createDataFrame([(u, s, v, a, n) for n, (u, s, v, a) in enumerate(rows)], "user_id int, session_id int, vacancy_id int, action_type int, event_id int") \
            .withColumn("action_dt", F.timestamp_seconds(F.col("event_id")))
    test = [(1, 7, 20, 3), (1, 7, 21, 3), (1, 7, 22, 1), (1, 8, 20, 3), (2, 9, 20, 3), (2, 9, 20, 1), (3, 5, 1, 3), (3, 5, 1, 1)]
    cat = spark.createDataFrame([(12, 5.0), (13, None)], "vacancy_id int, compensation_from double")
    rows = [tuple(r) for r in tr.train_test_pairs(frame(acts), frame(test), cat).collect()]
    assert rows == [(1, 7, 12, 12, [20, 21], [22])]
