"""Every registered query against its DuckDB oracle on the smallest data, and
those whose filters, fills and bins only larger data exercise on ten times that."""

import hashlib
import math

import duckdb
import pytest

from conftest import SMALL
from jobsift.catalog import ORACLE, QUERIES, load_all
from jobsift.sources.tables import TABLES

load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    keys = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.md5("\n".join(keys).encode()).hexdigest()


# Plans allowed to contain a single-partition exchange, and why (scale review):
# the rest must keep every shuffle partitioned by a key.
SINGLE_PARTITION_OK = {
    "a9_distinct_counts": "global aggregate after partial aggregation",
    "a15_vocabulary_reduction": "global aggregate of the merged skills; one global corpus as n4",
    "a16_metric_mean_median": "global aggregate of per-user rates",
    "a17_null_counts": "global aggregate after partial aggregation",
    "i16_job_structs": "lengths of the dictionary entries, a scalar subquery",
    "i9_first_dictionary_match": "lengths of the dictionary entries, a scalar subquery",
    "i10_skill_extraction": "lengths of the dictionary entries, a scalar subquery",
    "i11_phrase_extraction": "lengths of the dictionary entries, a scalar subquery",
    "m5b_ranking_metrics": "global aggregate of per-user metrics",
    "m14_prefix_stratification": "the prefix file's entries, one a dataset",
    "m7_hard_negatives": "prefix sums over at most 4,096 bin sizes of the pad order",
    "m8_candidate_corpus": "prefix sums over at most 4,096 bin sizes of the pad order",
    "m10_training_groups": "prefix sums over at most 4,096 bin sizes of the pad order",
    "m10b_prefixed_groups": "prefix sums over at most 4,096 bin sizes of the pad order",
    "n4_skill_neighbours": "one global corpus: document count as a scalar subquery",
    "n5_skill_merging": "one global corpus: document count as a scalar subquery",
    "n6_replace_skills": "one global corpus: document count as a scalar subquery",
    "n7_fill_missing_skills": "one global corpus: document count as a scalar subquery",
    "p7_fill_mean": "global mean as a scalar subquery",
    "v11_threshold_sweep": "window over the 51-row threshold grid",
    "v12_v13_retrieval_metrics": "global aggregate of per-query metrics",
    "v14_triplet_accuracy": "global aggregate of per-triplet flags",
}


# Nested-loop joins, and why they are bounded.
NESTED_LOOP_OK = {
    "n4_skill_neighbours": "one global scope: its k padding ids for every query",
    "n5_skill_merging": "one global scope: its k padding ids for every query",
    "n6_replace_skills": "one global scope: its k padding ids for every query",
    "a15_vocabulary_reduction": "one global scope: its k padding ids for every query",
    "n7_fill_missing_skills": "one global scope: its k padding ids for every query",
}


@pytest.fixture(autouse=True, scope="module")
def own_plans(spark):
    """Without Spark's own Bloom filters, each a global aggregate of fixed size."""
    key = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


@pytest.fixture
def stages(monkeypatch):
    """Executed plans of everything that a query checkpoints on its way."""
    from pyspark.sql.classic.dataframe import DataFrame
    plans, checkpoint = [], DataFrame.checkpoint

    def recorded(self, *args, **kwargs):
        out = checkpoint(self, *args, **kwargs)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(DataFrame, "checkpoint", recorded)
    return plans


def _check_plan(name, df, stages):
    for plan in [*stages, df._jdf.queryExecution().executedPlan().toString()]:
        assert "CartesianProduct" not in plan, name
        if name not in NESTED_LOOP_OK:
            assert "NestedLoopJoin" not in plan, name
        if name not in SINGLE_PARTITION_OK:
            assert "SinglePartition" not in plan, name


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.fixture(scope="module")
def larger_duck():
    return connect(LARGER)


LARGER = "/root/testdata/sf0.01"
ALSO_LARGER = ["r1_gated_candidates", "r2_candidate_set", "r5_blend", "r6_recommend_initial",
               "r8_two_stage_knn", "k2_skill_neighbours", "k10_embedding_store", "v8_similarity_mrr",
               "n5_skill_merging", "m5b_ranking_metrics", "m13b_train_test_pairs"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, stages, name):
    df = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in df.collect()]
    _check_plan(name, df, stages)
    cur = duck.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


@pytest.mark.parametrize("name", ALSO_LARGER)
def test_matches_oracle_on_larger_data(spark, larger_duck, name):
    df = QUERIES[name](spark, LARGER)
    srows = [tuple(r) for r in df.collect()]
    cur = larger_duck.execute(ORACLE[name])
    drows = cur.fetchall()
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest([d[0] for d in cur.description], drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    assert any(v is not None for r in rows for v in r)
