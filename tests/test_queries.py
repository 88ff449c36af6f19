"""Every registered query of the engine against its SQL oracle."""

from __future__ import annotations

import glob
import os

import pytest

from tracklode.plans import catalog, catalog_more, catalog_source  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return float(f"{float(value):.9g}") if isinstance(value, float) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_readable_sizes_keep_large_ids(spark, tmp_path):
    keys = [1, 99_999_999, 100_000_000, 1_100_000_000, 1_200_000_000, 1_000_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["size"] for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect()}
    assert sorted(got) == keys
    assert got[1] == "7 B" and got[1_000_000_000_000] == f"{7 * 10**24 // 2**60} EiB"
    assert got[1_100_000_000].startswith("7.3") and got[1_200_000_000].startswith("8.7") and got[1_200_000_000].endswith(" EiB")


def test_sizes_beyond_a_gib_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    keys = [3869, 3870, 3871, 12385, 12386, 12387, 14_999, 900_000, 300_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = dict(con.execute(catalog.ORACLE["readable_sizes"]).fetchall())
    assert {r["c_custkey"]: r["size"] for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect()} == want


def test_years_beyond_9999_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    keys = [0, 2_932_930, 2_932_931, 2_933_000, 9_000_000, 54_000_000]
    spark.createDataFrame([(k, "1-URGENT", "O") for k in keys], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {r[0]: r[1] for r in con.execute(catalog.ORACLE["text_columns"]).fetchall()}
    assert {r["o_orderkey"]: r["at"] for r in catalog.QUERIES["text_columns"](spark, str(tmp_path)).collect()} == want
