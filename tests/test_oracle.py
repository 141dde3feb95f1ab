"""Layer 1: every registered query against its DuckDB oracle on the
smallest driver tables (the driver repeats this at sf0.01)."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from reviewlens.plans.registry import ORACLES, QUERIES  # the library's own; the corpus operators have theirs
from tools.check_oracle import TABLES, digest


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
    # strict: raw values identical too (no rounding), whatever normalisation a checker applies
    raw = lambda cols, rs: sorted("|".join(repr(r[i]) for i in sorted(range(len(cols)), key=lambda j: cols[j]))
                                  for r in rs)
    assert raw(df.columns, rows) == raw(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 4
