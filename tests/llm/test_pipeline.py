"""The pipeline's stages against brute force, and the queries against their SQL."""

import os

import duckdb
import pytest
from cases import TEXTS, by_rows, docs, plain
from test_dedup import brute_classes, brute_fingerprint, brute_matches, brute_substring
from test_oracle_parity import _digest

import corpus_pipeline as C
from jobsift.llm.blocks import stored
from jobsift.llm.queries import ORACLE, QUERIES
from jobsift.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in C.STAGES:
        after = stored(stage(spark, docs, SMALL), name)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {n: x for n, *x in out}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in C.STAGES] == list(stages) and len(stages) == 5
    for name, _ in C.STAGES[:-1]:
        assert stages[name][2] == stages[name][3] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(stages[n][1] for n in stages)


def test_quality_stage_keeps_what_the_query_keeps(spark, stages):
    before, after = stages["quality_rules"][:2]
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, SMALL).filter("kept").collect()}
    assert by_rows(after) == by_rows(r for r in before if r.doc_id in kept) and len(after) < len(before)


def test_one_document_of_each_class_stays(stages):
    before, after = stages["simhash_near_dedup"][:2]
    root = brute_classes([brute_fingerprint(r.text) for r in before])
    least = {}
    for r, row in zip(root, before):
        least[r] = min(least.get(r, row.doc_id), row.doc_id)
    assert by_rows(after) == by_rows(r for r in before if r.doc_id in set(least.values()))


def test_repeated_passages_go(stages):
    before, after = stages["substring_dedup"][:2]
    want = {i: (n, cut) for i, _, n, cut in brute_substring([(r.doc_id, r.text, r.lang) for r in before], 50)}
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        n, cut = want[r.doc_id]
        assert r.text == (cut if n else old[r.doc_id].text) and (not n or r.n_chars == len(cut))


def test_contaminated_documents_go(spark, stages):
    before, after = stages["benchmark_decontamination"][:2]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [r for r in before if not (
        n := len(set().union(*[brute_matches(r.text, x) for x in items]))) or 20 * n < len(plain(r.text))]
    assert by_rows(after) == by_rows(clean)


def test_pieces_restore_every_text(stages):
    before, after = stages["sentencepiece"][:2]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before) and all(r.round_trip for r in after)


def test_awkward_rows_and_empty_tables_pass_every_stage(spark):
    """Nulls in any column, repeated ids, columns with clashing names, then none."""
    table = docs(spark, TEXTS)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, table, SMALL)
        assert out.columns == table.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= len(TEXTS), name
        if name == "substring_dedup":
            assert len(rows) == len(TEXTS)
        elif name == "simhash_near_dedup":
            assert len({r.text for r in rows}) == len(rows)
        assert stage(spark, table.limit(0), SMALL).collect() == [], name
    last = C.STAGES[-1][1](spark, table, SMALL).collect()
    assert len(last) == len(TEXTS) and all(r.round_trip for r in last)
    assert C.STAGES[-1][1](spark, table.limit(0), SMALL).collect() == []
    kept = table
    for name, stage in C.STAGES:
        kept = stored(stage(spark, kept, SMALL), name)
    assert kept.count() > 0


def test_run_gives_the_last_stage(spark, stages):
    rows = C.run(spark, SMALL).select("doc_id", "ids").collect()
    assert by_rows(rows) == by_rows((type(rows[0])(doc_id=r.doc_id, ids=r["ids"]) for r in stages["sentencepiece"][1]))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLE[name])
    assert _digest(df.columns, [tuple(r) for r in df.collect()]) == _digest(
        [c[0] for c in cur.description], cur.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
