"""Queries against DuckDB on tables of the size, or with the keys, at which they once differed."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

from tests.test_oracle import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares a query with its SQL over tables of which some are made anew: {table: select over sf0.001's}."""

    def check(name, made):
        duck = duckdb.connect()
        for f in os.listdir(SF):
            t = f.removesuffix(".parquet")
            duck.execute(f"create view {t} as select * from '{SF}/{f}'")
            if t in made:
                duck.execute(f"copy ({made[t]}) to '{tmp_path}/{f}' (format parquet)")
                duck.execute(f"create or replace view {t} as select * from '{tmp_path}/{f}'")
            else:
                os.symlink(f"{SF}/{f}", tmp_path / f)
        df = entry.queries()[name](spark, str(tmp_path))
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        cur = duck.execute(entry.oracle_sql()[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())

    return check


#: Part keys on both sides of a million, where made-up names and keys begin.
PARTS = "select part.* replace (p_partkey + r * 1000000 as p_partkey) from part, range(4) x(r)"


def test_existing_keys_beyond_a_million(against_sql):
    against_sql("existing_keys", {"part": PARTS})


def test_touched_objects_beyond_a_million(against_sql):
    against_sql("touched_objects", {"part": PARTS, "lineitem": "select lineitem.* replace (l_partkey + r * 1000000 as l_partkey, l_orderkey + r * 1000000 as l_orderkey) from lineitem, range(3) x(r)"})


def test_followed_names_beyond_a_million(against_sql):
    against_sql("followed_names", {"part": PARTS})


def test_relation_digest_of_many_rows(against_sql):
    # equal rows stand in several blocks
    many = "select customer.* replace (c_custkey + r % 50 * 1000000 as c_custkey) from customer, range(100) x(r)"
    against_sql("relation_digest", {"customer": f"{many} union all select customer.* from customer, range(300) where c_custkey = 1"})


def test_relation_digest_of_no_rows(against_sql):
    against_sql("relation_digest", {"customer": "select * from customer where false"})
