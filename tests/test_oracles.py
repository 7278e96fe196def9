"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stemwise.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert name not in registry.ORACLES or len(got)
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
        assert len(a) == len(b)
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        assert not odd, odd[:3]
