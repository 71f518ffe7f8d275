"""Queries against DuckDB on the smallest tables, plans, strategies and small edge cases."""

import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest

from barloom.operators import patterns, strategy_language
from barloom.operators.window_indicators import INDICATORS
from barloom.plans import catalog
from barloom.plans.staged import apply_stages

D = "/root/testdata/sf0.001"
ALL = sorted(catalog.SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(D):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", ALL)
def test_same_as_duckdb(spark, con, name):
    a, b = catalog.QUERIES[name](spark, D).toPandas(), con.sql(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) > 0
    cols = sorted(a.columns)
    keys = [c for c in cols if a[c].dtype.kind not in "f"] or cols
    a, b = (x[cols].sort_values(keys + [c for c in cols if c not in keys]).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            x, y = a[c].astype(float), b[c].astype(float)
            np.testing.assert_allclose(x, y, rtol=1e-5, atol=1.01e-4, err_msg=c)
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_every_query_has_a_name_of_its_own_and_runs_lazily():
    assert len(catalog.QUERIES) > 150 and set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(patterns.RULES) == 61


def _bars(spark, closes):
    rows = [("k", datetime(2024, 1, 1) + timedelta(days=i), i, c, c, c, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "key string, ts timestamp, bar long, open double, high double, low double, close double, volume double")


def test_degenerate_constants(spark):
    flat = _bars(spark, [5.0] * 40)
    for name, col, want in (("WILLR", "willr", -50.0), ("CCI", "cci", 0.0), ("BOP", "bop", 0.0), ("STOCH", "slowk", 0.0), ("MFI", "mfi", 0.0), ("LINEARREG_SLOPE", "linearreg_slope", 0.0)):
        got = apply_stages(flat, INDICATORS[name]).orderBy("ts").collect()[-1][col]
        assert got == pytest.approx(want), name
    assert apply_stages(flat, INDICATORS["ZSCORE"]).orderBy("ts").collect()[-1]["zscore"] is None


def test_gaps_give_null_and_empty_tables_work(spark):
    got = [r["sma"] for r in apply_stages(_bars(spark, [1.0, None, 3.0] + [1.0] * 40), INDICATORS["SMA"]).orderBy("ts").collect()]
    assert got[30] is None and got[31] is not None and len(got) == 43
    assert apply_stages(_bars(spark, [1.0]).limit(0), INDICATORS["ICHIMOKU"]).count() == 0


def test_one_shuffle_for_many_windows(spark):
    df = apply_stages(_bars(spark, [1.0] * 5).repartition(3), INDICATORS["STOCH"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_strategy_errors(spark):
    for bad in ("close >", "foo(3) > 1", "close > 1 extra", "", "rsi(14) <", "(close > 1", "close # 1", "macd_nope > 1", "and > 1"):
        with pytest.raises(ValueError):
            strategy_language.evaluate(bad, _bars(spark, [1.0]))


def _parts(con, path, rows):
    """A part table of (key, brand, size, price) as the only file of a folder, and a connection that sees it."""
    listed = ", ".join(f"({k}, '{b}', {n}, {p})" for k, b, n, p in rows)
    con.sql(f"copy (select k::bigint p_partkey, 'x' p_name, b p_brand, 'x' p_type, n::int p_size, p::double p_retailprice from (values {listed}) v(k, b, n, p)) to '{path}/part.parquet' (format parquet)")
    con.sql(f"create view part as select * from '{path}/part.parquet'")
    return str(path)


def test_smiles_with_quotes_of_one_strike(spark, tmp_path):
    """Also where two keys make the same strike: the slope between them must not stop the query."""
    from barloom.functions.option_strategies import smile_metrics

    con = duckdb.connect()
    d = _parts(con, tmp_path, [(0, "a", 3, 1000.0), (25000, "a", 2, 1000.0), (1, "a", 2, 1000.0), (2, "a", 1, 1000.0), (3, "a", 5, 1000.0)])
    a, b = catalog.QUERIES["opt_smile_metrics"](spark, d).toPandas(), con.sql(catalog.SQL["opt_smile_metrics"]).df()
    assert a.shape == (1, 6) and (a == b[a.columns]).all().all()
    made = [("far", 90.0, 0.2), ("far", 100.0, 0.3), ("far", 110.0, 0.25), ("far", 120.0, 0.2), ("far", 120.0, 0.4)]
    made += [("near", 90.0, 0.2), ("near", 100.0, 0.4), ("near", 100.0, 0.3), ("near", 110.0, 0.25), ("same", 90.0, 0.2), ("same", 100.0, 0.3), ("same", 100.0, 0.3)]
    chain = spark.createDataFrame(made, "chain string, strike double, vol double").selectExpr("*", "100D AS spot", "0.03D AS rate", "0.01D AS carry", "0.25D AS t")
    got = {r["chain"]: (r["atm_iv"], r["convexity"]) for r in smile_metrics(chain).collect()}
    assert got["far"] == (0.3, pytest.approx(-0.05 / np.log(1.1) + 0.1 / np.log(0.9)))
    assert got["near"] == (0.3, np.inf) and got["same"][0] == 0.3 and np.isnan(got["same"][1])


def test_spreads_do_not_hang_on_the_order_of_rows(spark):
    from barloom.functions.option_strategies import calendar_spreads

    rows = [("a", 0.1, 5.0, 1), ("a", 0.2, 9.0, 2), ("a", 0.2, 6.0, 4), ("a", 0.2, 6.0, 3), ("a", 0.3, 7.0, 5)]
    for made in (rows, rows[::-1], rows[2:] + rows[:2]):
        got = calendar_spreads(spark.createDataFrame(made, "curve string, tenor double, price double, id int").coalesce(1)).collect()
        assert sorted((r["id"], r["spread"]) for r in got) == [(2, 3.0), (3, 1.0), (4, 0.0), (5, -2.0)]


def test_implied_volatility_far_from_the_money(spark, tmp_path):
    """There the price holds little but what rounding leaves, and its last digits determine the root."""
    con = duckdb.connect()
    far = [(9470, 947.0), (29473, 947.0), (7950, 995.0), (10930, 993.0), (10920, 992.0), (380, 938.0), (5350, 935.0), (1, 944.0), (31, 901.0), (2, 940.0)]
    d = _parts(con, tmp_path, [(k, "a", 1, p) for k, p in far] + [(100 + i, "a", 1 + i % 50, 900.0 + i) for i in range(90)])
    a, b = catalog.QUERIES["opt_implied_volatility"](spark, d).toPandas(), con.sql(catalog.SQL["opt_implied_volatility"]).df()
    a, b = (x[["key", "iv", "price"]].sort_values("key").reset_index(drop=True) for x in (a, b))
    assert len(a) == 100 and (a == b).all().all() and (np.signbit(a["price"]) == np.signbit(b["price"])).all()
    assert a.set_index("key")["iv"][9470] == 0
