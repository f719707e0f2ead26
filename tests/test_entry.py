from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vouchline.plans import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", list(core.QUERIES))
def test_core_query_equals_its_sql(spark, name):
    df = core.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in core.ORACLES:
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
    want = con.execute(core.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == sorted(map(repr, want.fetchall()))


def test_entry_names_every_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert core.FLAGSHIP in core.QUERIES
