"""Every registered query against its DuckDB twin on the smallest test tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as ep
from ledgerlake.plans import registry
from ledgerlake.sources.tables import RAW_TABLES
from tools.check_oracle import digest

registry.load_all()
QUERIES = {k: v for k, v in ep.queries().items() if k in registry.QUERIES}
ORACLE = dict(registry.ORACLE)


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(ORACLE[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_oracle(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    assert df.count() >= 0
    assert len(df.columns) > 0


def test_entry_smoke(spark):
    df = ep.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "name", "value"]


def test_every_query_has_survey_id():
    import re
    for name in QUERIES:
        assert re.match(r"^[a-z]+\d+[a-z]?_[a-z0-9_]+$", name), name
