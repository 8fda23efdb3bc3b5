"""Every query that has SQL gives DuckDB's rows; all others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from affinix.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, str)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(f) else f"{f:.6g}" if f else "0"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = df.collect()
    if name in catalogue.ORACLE_SQL:
        rel = duck.sql(catalogue.ORACLE_SQL[name])
        names = sorted(rel.columns)
        assert sorted(df.columns) == names
        place = [rel.columns.index(n) for n in names]
        assert sorted(tuple(plain(r[n]) for n in names) for r in got) == sorted(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    else:
        assert got


@pytest.mark.parametrize("partitions", ["4", "8"])
def test_metric_validation_on_more_rows(spark, partitions):
    """Lists of many systems are put together whatever the partitions of each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.system: r.recall for r in entry.queries()["metric_validation"](spark, "/root/testdata/sf0.01").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 7 and got["oracle"] > got["oracle_drop5"] > got["oracle_drop10"] >= got["random"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
