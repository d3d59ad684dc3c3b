"""Every catalogue query equals its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from foliant.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted((plain(tuple(r)) for r in rs), key=repr)
    assert rows(df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_driver_contract(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and "faceted_search" in known
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["facet", "value", "n"]
