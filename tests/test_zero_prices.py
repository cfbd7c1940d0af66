"""Bars whose price is zero for a while: a return from it is infinite or undefined, as in the SQL."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_queries import rows
from tidemark.functions.windows import quotient
from tidemark.plans import registry

#: Queries that follow from the volatility states.
QUERIES = ("volatility_states", "conditioned_expectancy", "volatility_bars", "regime_signal", "conditional_forecast", "conditional_transitions", "coverage", "coverage_by_symbol", "rare_keys", "transition_coverage")


@pytest.fixture(scope="module")
def fallen(tmp_path_factory):
    """Orders of two symbols, one a day: a walk around 100 that twice falls to zero, for one day and for two."""
    rng = np.random.default_rng(7)
    found = []
    for symbol in ("a", "b"):
        step = rng.normal(0, 0.015, 420)
        step[[200, 300]] -= 20
        step[[201, 302]] += 20
        found.append(pd.DataFrame({"o_orderpriority": symbol, "o_totalprice": 252500 * (1 + 50 * step), "o_orderdate": pd.date_range(datetime.date(1995, 1, 1), periods=420)}))
    orders = pd.concat(found, ignore_index=True)
    orders.insert(0, "o_orderkey", range(len(orders)))
    folder = tmp_path_factory.mktemp("fallen")
    duckdb.sql(f"COPY (SELECT * REPLACE (CAST(o_orderdate AS TIMESTAMP) AS o_orderdate) FROM orders) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


def test_quotient(spark):
    pairs = [(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None)]
    got = [r.q for r in spark.createDataFrame(pairs, "a double, b double").select(quotient(F.col("a"), F.col("b")).alias("q")).collect()]
    assert got[:3] == [0.5, float("inf"), float("-inf")] and np.isnan(got[3]) and got[4:] == [None, None]


@pytest.mark.parametrize("name", QUERIES)
def test_zero_price(spark, fallen, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{fallen}/orders.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, fallen).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["bootstrap_mean", "change_points", "hidden_regimes"])
def test_fits_leave_infinite_returns_out(spark, fallen, name):
    got = registry.QUERIES[name](spark, fallen).toPandas()
    assert len(got) and np.isfinite(got.select_dtypes("number").dropna().to_numpy(dtype=float)).all()
    assert not got.select_dtypes("number").isna().all().any()
