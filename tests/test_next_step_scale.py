"""One case per finding of the fourth review: work that was done again and again."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobsift.operators import vectors as vx
from jobsift.plans import nextstep as ns
from jobsift.plans import recommend as rc


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_f3_a_norm_is_worked_out_once_a_vector(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "i int, v array<double>")
    unit = df.select("i", vx.l2_normalise("v").alias("u"))
    assert {r.i: r.u for r in unit.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [0.0, 0.0]}
    text = unit._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("aggregate(") == 1


def test_f2_features_of_pairs_are_worked_out_once(spark):
    """m5, r12, r13b: both similarities read the stored features."""
    v = spark.createDataFrame([(i, f"title{i % 3} word", [f"s{i % 4}"], 100.0 * i, None) for i in range(12)],
                              "vacancy_id long, name_raw string, keySkills array<string>, compensation_from double, compensation_to double")
    h = spark.createDataFrame([(u, (u + i) % 12, 1 + i % 3, f"2024-01-{10 + i}", i) for u in range(4) for i in range(6)],
                              "user_id long, vacancy_id long, action_type int, action_dt string, event_id long")
    vec = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(12)], "vacancy_id long, vec array<double>")
    pairs = spark.createDataFrame([(u, i) for u in range(4) for i in range(12)], "user_id long, vacancy_id long")
    out = ns.ranking_features(pairs, h, v, vec)
    assert plan(out).count("Join") <= 24
    rows = {(r.user_id, r.vacancy_id): r for r in out.collect()}
    assert len(rows) == 48
    acted = [(x.vacancy_id, x.action_type) for x in h.filter("user_id = 1").collect()]
    unit = lambda i: np.array([1.0, i % 2]) / np.sqrt(1 + i % 2)
    kept = [i for i, t in acted if t != 2]
    for i in range(12):
        left = [x for x in kept if x != i]  # the candidate's own row is left out
        assert rows[1, i].mean_desc == pytest.approx(np.mean([unit(i) @ unit(x) for x in left]))


def _cell(n, floors, text):
    """Batches of one cell: scopes with a text each, then ``n`` rows sent twice."""
    texts = pa.list_(pa.struct([("query_id", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    schema = pa.schema([("__a", pa.int64()), ("__b", pa.int32()), ("__role", pa.int32()), ("scope", pa.int64()), ("max_code", pa.int32()),
                        ("floor", pa.float64()), ("titles", pa.list_(pa.string())), ("texts", texts), ("title", pa.string()),
                        ("vacancy_id", pa.int64()), ("exp_code", pa.int32()), ("salary", pa.int64()),
                        ("__lists", pa.list_(pa.list_(pa.string()))), ("__m", pa.int64())])
    none = dict.fromkeys(schema.names)
    cell = [none | dict(__a=0, __b=0, __role=0, scope=s, max_code=c, floor=f, titles=["t0", "t1"], texts=[dict(query_id=s, tokens=text)])
            for s, (c, f) in enumerate(floors)]
    docs = [(i, ["common", "usual" if i % 2 else "plain"] + ["rare"] * (i % 97 == 0) + [f"w{i % 7}"]) for i in range(n)]
    rows = [none | dict(__a=0, __b=0, title=f"t{i % 3}", vacancy_id=i, exp_code=1 + i % 4, salary=i * 37 % 1000, __lists=[d], __m=1) for i, d in docs]
    twice = [r | dict(__role=role) for role in (1, 2) for r in rows]
    return docs, pa.Table.from_pylist(cell + twice, schema).combine_chunks().to_batches(1000)


@pytest.mark.parametrize("at_once", [100_000, 700])
def test_f5_f6_f7_a_text_meets_the_rows_of_its_heaviest_tokens(monkeypatch, at_once):
    monkeypatch.setattr(rc, "ROWS_AT_ONCE", at_once)
    kind = {"scope": pa.int64(), "query_id": pa.int64(), "vacancy_id": pa.int64(), "exp_code": pa.int32(), "score": pa.float64(), "rank": pa.int32()}
    floors = [(None, None), (2, None), (None, 500.0), (3, 250.5), (None, 250.0), (4, float("nan")), (1, 5000.0)]
    text = ["common", "rare", "usual", "w3"]
    docs, batches = _cell(6000, floors, text)
    scored = []
    out = pa.Table.from_batches(list(rc._search(5, kind, scored)(iter(batches)))).to_pylist()
    assert sum(scored) < 0.1 * 6000 * 5  # each of the five scopes with rows has all 'common' ones
    for s, (code, floor) in enumerate(floors):
        here = [(i, d) for i, d in docs if i % 3 < 2 and (code is None or 1 + i % 4 <= code) and (floor is None or i * 37 % 1000 >= floor)]
        df = {t: sum(t in d for _, d in here) for t in {t for _, d in here for t in d}}
        idf = {t: np.log((1 + len(here)) / (1 + x)) + 1 for t, x in df.items()}
        size = lambda x: np.sqrt(sum(idf[t] ** 2 for t in x))
        own = [t for t in text if t in idf]
        score = {i: sum(idf[t] ** 2 for t in d if t in own) / size(own) / size(d) for i, d in here}
        want = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert [r["vacancy_id"] for r in sorted((r for r in out if r["scope"] == s), key=lambda r: r["rank"])] == want


def test_f1_titles_are_stored_and_moved_once_a_scope(spark, monkeypatch):
    cat = spark.createDataFrame([(i, "AB"[i % 2], f"sql tool{i % 5}" if i % 9 else None, f"title{i}", "noExperience", 100.0 + i) for i in range(40)],
                                "vacancy_id long, area_id string, keySkills_str string, name_raw string, workExperience string, compensation_from double")
    asks = [(i % 60, "title3", 100.0 + i % 5, ("A", "B", None)[i % 3], "noExperience", "sql", False, True) for i in range(90)]
    req = spark.createDataFrame(asks, "request_id long, title string, compensation_from double, area_id string, "
                                      "workExperience string, skills string, by_experience boolean, by_salary boolean")
    stored, keep = [], rc.materialize
    monkeypatch.setattr(rc, "materialize", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(rc, "REQUESTS_PER_ROW", 2, raising=False)
    _, st = rc.recommend_initial(req, cat, stages=True)
    got = sorted((r.request_id, r.vacancy_id) for r in st["candidates"].select("request_id", "vacancy_id").collect())
    want = sorted((a[0], i) for a in asks for i in range(40) if i % 9 and a[3] in ("AB"[i % 2], None) and 100 + i >= 0.8 * a[2])
    assert got == want
    assert max(df.count() for df in stored) <= 90  # requests; a row for each scope's title would be more
