"""Every query of the catalog runs, and gives its SQL's rows."""

import math
import os

import duckdb
import pytest

from veilgrid import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert plain(rows, df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_findings_hold_no_values(spark):
    """Audits and diagnoses name columns and numbers, never cells."""
    values = {r.c_name for r in spark.read.parquet(f"{SF}/customer.parquet").collect()} | {r.n_name for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    for name in ("e3_diagnose", "e5_audit_classes", "e6_audit_drop_one", "e8_derived_relations", "e11_leaks"):
        assert not values & {str(v) for r in catalog.queries()[name](spark, SF).collect() for v in r}
