import math

import duckdb
import pytest

from textquarry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def shown(v):
    return "" if v is None else repr(round(v, 8)) if isinstance(v, float) and math.isfinite(v) else str(v)


def table(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(shown(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    got = table(df.columns, df.collect())
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0 or name == "module_relevance"


def test_plans_have_no_unbounded_pairing(spark, sf, capsys):
    for name in ("snapshot_diff", "requests_in_windows", "line_evidence", "imported_by", "stratified_sample"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name
