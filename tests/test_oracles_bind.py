"""Every oracle SQL binds in DuckDB against the driver tables (no Spark)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_CHECK
from tessera.sources.tables import TABLES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    return c


def test_every_oracle_binds(con):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    bad = {}
    for k, sql in o.items():
        try:
            cols = [r[0] for r in con.execute("DESCRIBE " + sql).fetchall()]
            assert len(cols) == len(set(cols)), "duplicate column names"
        except Exception as e:  # noqa: BLE001
            bad[k] = str(e)[:200]
    assert not bad, bad
