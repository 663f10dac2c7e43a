"""Every query with an oracle against DuckDB, on the smallest tables; the others run and keep their laws."""

import math

import duckdb
import pytest

from quern.plans import catalog

ORACLES = catalog.oracles()
SLOW = {"minhash_small", "shingle_stats"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_oracle(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*cols).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(([plain(x) for x in r] for r in duck.sql(f"select {quoted} from ({ORACLES[name]}) q").fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(catalog.queries())


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
