"""Each named query against its SQL, over the smallest of the driver's tables."""

import decimal
import os

import duckdb
import pytest

from gazelark.plans import build_catalogue, catalogue, search_catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")

#: The modules' own queries; those of catalogue itself are compared at a larger scale by the driver.
NAMES = [name for name, f in catalogue.queries().items() if f.__module__ in (build_catalogue.__name__, search_catalogue.__name__) and name in catalogue.oracle_sql()]


def tidy(x):
    if isinstance(x, float):
        return round(x, 6)
    return float(x) if isinstance(x, decimal.Decimal) else tuple(map(tidy, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in TABLES:
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", [*NAMES, "latin_filter", "token_set_ratio", "etl_upsert_meta", "md5_id"])
def test_query_as_its_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = sorted((tidy(r) for r in con.sql(f"SELECT {listed} FROM ({catalogue.oracle_sql()[name]})").fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_no_query_reads_a_part_of_a_table_by_its_key():
    assert not [name for name, sql in catalogue.oracle_sql().items() if "p_partkey <" in sql or "left(text" in sql]
