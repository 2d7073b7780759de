"""Every query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import workload
from tests.shared import counted

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, sql, name):
    df = workload.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in workload.ORACLES:
        assert rows
        return
    want = sql.sql(workload.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    assert counted(rows, columns) == counted([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


#: Queries whose repositories are whole days.
WHOLE_DAYS = ("scc", "scc_joined", "scc_fingerprint", "shortest_loop", "cycle_findings", "cycle_cut")


@pytest.mark.parametrize("name", WHOLE_DAYS)
def test_cycles_of_a_day_cross_its_quarters(spark, tmp_path, name):
    made = "SELECT k AS event_id, TIMESTAMP '2024-01-03 00:00:00' + INTERVAL (k * 5) HOUR AS ts, [7, 8, 7][k + 1] AS user_id, 'click' AS event_type, 1.5 AS value, '{}' AS props FROM range(3) AS r(k)"
    duckdb.sql(f"COPY ({made}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    rows = workload.QUERIES[name](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = c.sql(workload.ORACLES[name])
    columns = sorted(want.columns)
    assert rows and {r["repo_id"] for r in rows} == {"d3"}
    assert counted(rows, columns) == counted([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["repo_id", "rule", "severity", "message", "files"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    columns = ["run_id", "node", "status", "duration_ms", "first_seq"]
    batch = workload.QUERIES["progress_fold"](spark, DATA).collect()
    assert counted(workload.QUERIES["stream_progress"](spark, DATA).collect(), columns) == counted(batch, columns)
