"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SAMPLE = ["batch_report", "publish_state", "guard_full", "run_next_state", "robots_decisions",
          "match_excluded", "resolve_names", "chunk_documents", "lexical_search", "freshness_report",
          "stream_sessions", "paginate_all"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130


@needs_data
def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity_type", "slug", "class", "field", "old_value", "new_value",
                          "confidence"]
    assert df.count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check_oracle import rows_of
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@needs_data
def test_no_plan_pairs_everything_with_everything(spark):
    """Neither cross joins nor nested loops in any batch query."""
    for name, run in entry.queries().items():
        if name.startswith("stream_"):
            continue
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
