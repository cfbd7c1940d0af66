"""Closes that equal their mean: whether they are above it doesn't hang on the order in which a sum adds."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_queries import rows
from tidemark.operators.indicators import compensated_sma
from tidemark.plans import registry

#: Queries that compare a close with the mean of its 50.
QUERIES = ("conditional_forecast", "coverage", "coverage_by_symbol", "rare_keys", "transition_coverage")


@pytest.fixture(scope="module")
def steady(tmp_path_factory):
    """Orders of two symbols, one a day, whose closes stay at 0.5, then at another price. 50 of that, added one after another,
    fall short of it; neither a sum rounded once nor the SQL's does (at many other prices the SQL's falls short, too)."""
    found = []
    for symbol, price in (("a", 0.0451), ("b", 0.0986)):
        step = np.zeros(500)
        step[0], step[250] = np.log(0.5 / 100), np.log(price / 0.5)
        found.append(pd.DataFrame({"o_orderpriority": symbol, "o_totalprice": 252500 * (1 + 50 * step), "o_orderdate": pd.date_range(datetime.date(1995, 1, 1), periods=500)}))
    orders = pd.concat(found, ignore_index=True)
    orders.insert(0, "o_orderkey", range(len(orders)))
    folder = tmp_path_factory.mktemp("steady")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(o_orderdate AS TIMESTAMP) AS o_orderdate) FROM orders) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


def test_compensated_sma(spark):
    rng = np.random.default_rng(3)
    closes = [float(x) for x in np.round(np.exp(rng.normal(0, 0.02, 400).cumsum()) * 0.002, 4)] + [float("inf")]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(closes)], "symbol string, pos int, close double")
    got = df.select("pos", compensated_sma("close", 50).alias("m"), (F.col("close") > compensated_sma("close", 50)).alias("above")).orderBy("pos").collect()
    assert [r.m for r in got[:49]] == [None] * 49 and not got[400].above
    assert [r.m for r in got[49:400]] == [math.fsum(closes[i - 49 : i + 1]) / 50 for i in range(49, 400)]


@pytest.mark.parametrize("name", QUERIES)
def test_equal_mean(spark, steady, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{steady}/orders.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, steady).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
