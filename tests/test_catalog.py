"""Every named query against DuckDB on the same tables, where SQL can say the same."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_topk_is_no_full_sort(spark):
    plan = catalog.QUERIES["topk_cosine"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange range" not in plan


def test_area_counts_read_one_column(spark):
    plan = catalog.QUERIES["module_map"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_pages_of_parts_are_parsed_by_many_tasks(spark, tmp_path):
    """A part table in one row group, which one task reads."""
    spark.range(2000).selectExpr("id AS p_partkey", "'old plate' AS p_name", "'Brand#1' AS p_brand", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["html_tables_md"](spark, str(tmp_path))
    for format in ("html", "md"):
        counts = [r["count"] for r in got.where(got["format"] == format).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 2000 and len(counts) >= 4 and max(counts) <= 1000
