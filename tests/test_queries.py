"""Every query of the main library runs, and equals its SQL where it has one, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from gridlore.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages documents".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.7g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in ORACLES:
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
