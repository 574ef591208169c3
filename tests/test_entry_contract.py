"""The driver contract of __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_oracles_belong_to_queries():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150
    own = [name for name in q if not name.startswith("op") and name != "pipeline"]
    assert len(own) >= 150
    assert all(name[0] in "aeijklmnprstuvw" for name in own)


def test_entry_runs_on_smallest_data(spark):
    df = _entry().entry(spark)
    rows = df.collect()
    assert rows and {r["rank"] for r in rows} == {1, 2, 3, 4, 5}
    assert df.columns == ["request_id", "vacancy_id", "rank"]
