"""The account, portfolios, regimes, adjustments, options, optimizers, sources and the named surface, against plain readings and SQL."""

import math
import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import alerts, config, errors, info, pipeline
from barloom.functions import cycles, derivatives, kernels
from barloom.functions import option_strategies as O
from barloom.functions.account import Account, Rules, simulate
from barloom.functions.commission import PRESETS, Commission, resolve
from barloom.functions.currency import CURRENCIES, Currency, format_currency
from barloom.operators import adjust, execution, features, optimize, regimes, series_pairs
from barloom.operators.window_indicators import sma, stoch
from barloom.plans.account_sql import account_sql
from barloom.sources import adapters
from barloom.sources import bars as B
from barloom.streaming.trading import PaperTrader, StreamingBacktest

T0 = datetime(2024, 1, 1)
NAN = float("nan")


def walk(n, seed=1, key="k"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = np.concatenate(([100], close[:-1])) * (1 + rng.normal(0, 0.005, n))
    high, low = np.maximum(open_, close) * (1 + abs(rng.normal(0, 0.01, n))), np.minimum(open_, close) * (1 - abs(rng.normal(0, 0.01, n)))
    signal = np.repeat(rng.choice([1, -1, 0, 0.5, np.nan, -0.5], n // 4 + 1), 4)[:n]
    limit = np.where(rng.random(n) < 0.3, close * (1 + rng.normal(0, 0.01, n)), np.nan)
    return pd.DataFrame({"key": key, "ts": [T0 + timedelta(days=i) for i in range(n)], "bar": range(n), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 99, n).astype(float), "signal": signal, "limit_price": limit})


def table(spark, *frames):
    df = pd.concat(frames)
    df["ts"] = pd.Series([t.to_pydatetime() for t in df.ts], index=df.index, dtype=object)
    for c in ("signal", "limit_price"):
        df[c] = df[c].astype(object).where(df[c].notna(), None)
    return spark.createDataFrame(df.to_dict("records"), "key string, ts timestamp, bar long, open double, high double, low double, close double, volume double, signal double, limit_price double")


FEES = replace(Commission.preset("equity_intraday_india"), flat_per_order=2.0, per_lot=0.01, spread_bps=3.0, short_borrow_rate_annual=0.03)
ALL_RULES = [
    Rules(), Rules(stop_loss_pct=0.03, take_profit_pct=0.04, slippage_bps=5), Rules(trailing_stop_pct=0.03, breakeven_pct=0.02, max_hold_bars=6, stop_loss_pct=0.05, commission=FEES),
    Rules(daily_loss_limit=0.06, stop_loss_pct=0.2, commission=FEES), Rules(total_loss_limit=0.2, trailing_stop_pct=0.05), Rules(margin_ratio=0.2, margin_call_pct=0.7, slippage_pct_range=0.05, total_loss_limit=0.9),
    Rules(fill_mode="market_close", commission=FEES, stop_loss_pct=0.05, max_hold_bars=5, slippage_bps=3), Rules(fill_mode="market_close", margin_ratio=0.1, commission=FEES, trailing_stop_pct=0.05, daily_loss_limit=0.2),
]


@pytest.mark.parametrize("rules", ALL_RULES)
def test_account_is_the_recursive_query(rules):
    df = pd.concat([walk(250, 3, "a"), walk(180, 4, "b")])
    for c in ("signal", "limit_price"):
        df[c] = df[c].astype("Float64")
    want = duckdb.sql(account_sql("SELECT * FROM df", rules, 12)).df().sort_values(["key", "ts"])
    for key, g in df.groupby("key"):
        got, w = simulate(g.open, g.high, g.low, g.close, g.signal.astype(float), rules, g.limit_price.astype(float)), want[want.key == key]
        for mine, theirs in (("position", "position"), ("fill_price", "fill_price"), ("bar_return", "bar_return"), ("strategy_return", "strategy_return"), ("equity", "equity")):
            np.testing.assert_allclose(got[mine], w[theirs].astype(float), rtol=1e-9, atol=1e-11)


def run(rules, bars, signals):
    """bars: (open, high, low, close)."""
    o, h, l, c = (np.array(x, dtype=float) for x in zip(*bars, strict=True))
    return simulate(o, h, l, c, np.array(signals, dtype=float), rules)


def test_account_by_hand():
    flat = [(100, 101, 99, 100)]
    # A stop fills at its price; the next bar may enter again.
    got = run(Rules(stop_loss_pct=0.05), [*flat, (100, 104, 100, 102), (100, 101, 90, 92), (90, 91, 89, 90)], [1, 1, 0, 0])
    assert got["position"].tolist() == [0, 1, 0, 0] and got["fill_price"][1] == 100 and got["fill_price"][2] == 95
    assert got["strategy_return"][1] == pytest.approx(0.02) and got["strategy_return"][2] == pytest.approx((95 - 102) / 102)
    # Both stop and goal in one bar: the one nearer to the open.
    both = [*flat, (100, 100, 100, 100), (104, 111, 89, 100)]
    assert run(Rules(stop_loss_pct=0.1, take_profit_pct=0.1), both, [1, 1, 1])["fill_price"][2] == pytest.approx(110)
    both[2] = (96, 111, 89, 100)
    assert run(Rules(stop_loss_pct=0.1, take_profit_pct=0.1), both, [1, 1, 1])["fill_price"][2] == pytest.approx(90)
    # Trailing for a short position: from its low.
    got = run(Rules(trailing_stop_pct=0.1), [*flat, (100, 100, 100, 100), (90, 91, 80, 85), (86, 89, 85, 88)], [-1, -1, -1, 0])
    assert got["fill_price"][2] == pytest.approx(88) and got["position"][2] == 0
    # Break-even: armed by the gain, leaves at the entry.
    got = run(Rules(breakeven_pct=0.05), [*flat, (100, 100, 100, 100), (103, 106, 102, 105), (102, 103, 99, 101)], [1, 1, 1, 1])
    assert got["fill_price"][3] == 100 and got["position"][3] == 0
    # Held for two bars at most; slippage is against the trade.
    got = run(Rules(max_hold_bars=2, slippage_bps=100), [*flat, *[(100, 100, 100, 100)] * 4], [1, 1, 1, 1, 1])
    assert got["position"].tolist() == [0, 1, 1, 0, 1] and got["fill_price"][1] == pytest.approx(101) and got["fill_price"][3] == pytest.approx(99)
    # A halt after a day's loss closes and stays flat.
    got = run(Rules(daily_loss_limit=0.1), [*flat, (100, 100, 80, 80), (80, 81, 79, 80), (80, 80, 80, 80)], [1, 1, 1, 1])
    assert got["position"].tolist() == [0, 1, 0, 0] and got["fill_price"][2] == 80
    # A margin call at the open.
    got = run(Rules(margin_ratio=0.2, margin_call_pct=0.5), [*flat, (100, 100, 100, 100), (89, 90, 88, 89)], [1, 1, 1])
    assert got["fill_price"][2] == 89 and got["bar_return"][2] == 0 and got["strategy_return"][2] == pytest.approx(-0.11)
    with pytest.raises(ValueError):
        Rules(fill_mode="noon")
    with pytest.raises(ValueError):
        Rules(stop_loss_pct=-1)
    assert Account(Rules()).step(1, 1, 1, 1, 1.0).position == 0 and not len(simulate([], [], [], [], [], Rules())["equity"])


def test_commission_models():
    fee = Commission(flat_per_order=10, rate_of_value=0.001, max_brokerage=15, stt_rate=0.0002, stt_on_sell=True, gst_rate=0.18, exchange_charges_rate=0.00003, stamp_duty_rate=0.0001, spread_bps=4)
    brokerage, value = 15, 100_000
    assert fee.total_cost(value, 1, True) == pytest.approx(brokerage + 3 + 0.18 * (brokerage + 3) + 10 + 20)
    assert fee.total_cost(value, 1, False) == pytest.approx(brokerage + 3 + 0.18 * (brokerage + 3) + 20 + 20)
    said = duckdb.sql(f"SELECT {fee.cost('100000.0', '1', 'true')}, {fee.cost('100000.0', '1', 'false')}").fetchall()[0]
    assert [float(x) for x in said] == pytest.approx([fee.total_cost(value, 1, True), fee.total_cost(value, 1, False)])
    assert Commission.from_json(fee.to_json()) == fee and Commission.proportional(0.1).total_cost(10, 1, True) == pytest.approx(1)
    assert Commission(lot_size=25, per_lot=2).of_weight(100, 0.5, True, 100_000) == pytest.approx(2 * 20 / 100_000)
    assert resolve(None, 3).flat_per_order == 3 and resolve(fee, 3) is fee and Commission.zero().total_cost(1e6, 9, True) == 0
    assert all(Commission.preset(p).total_cost(1e5, 1, False) > 0 for p in PRESETS) and FEES.short_borrow_cost(252, 252) == pytest.approx(0.03)


def test_trades_are_a_plain_reading(spark):
    frames = [walk(120, 8, "a"), walk(90, 9, "b")]
    result = execution.run_account(table(spark, *frames), Rules(stop_loss_pct=0.03, take_profit_pct=0.05))
    got = {(r.key, r.entry_bar): r for r in execution.trades(result).collect()}
    want = 0
    for key, g in result.toPandas().sort_values("ts").groupby("key"):
        rows = g.to_dict("records")
        side, entry = 0, None
        price = lambda r, other: r["fill_price"] if r["fill_price"] == r["fill_price"] and r["fill_price"] else r[other]
        for i, r in enumerate(rows):
            now = int(np.sign(r["position"]))
            last = i == len(rows) - 1
            if side and (now != side or last):
                closed = now != side
                e, x = price(rows[entry], "high"), price(r, "low" if closed else "high")
                t = got[key, entry]
                moves = [side * (rows[k][p] - e) / e for k in range(entry + 1, i + 1) for p in ("high", "low")]
                assert (t.exit_bar, t.direction, t.duration_bars) == (i, side, i - entry)
                assert [t.entry_price, t.exit_price, t.pnl_pct, t.mae, t.mfe] == pytest.approx([e, x, side * (x - e) / e, min(0, *moves), max(0, *moves)])
                want += 1
                side = 0 if closed else side
            if now and now != side:
                side, entry = now, i
                want += last
    assert len(got) == want


def test_engine_settings_and_sizing(spark):
    bars = table(spark, walk(300, 5))
    e = execution.Engine().with_slippage(5).with_stop_loss(0.05).with_take_profit(0.1).with_trailing_stop(0.08).with_commission_model(FEES).with_initial_capital(5e4).with_max_hold(9).with_loss_limits(0.3, 0.9).with_leverage(0.3).with_calendar(365)
    assert e.rules.stop_loss_pct == 0.05 and e.rules.periods_per_year == 365 and execution.Engine().rules.stop_loss_pct == 0
    out = e.run(bars, "sma_crossover", fast=5, slow=15)
    assert e.metrics(out).count() == 1 and e.trades(out).count() > 3
    half = execution.Engine().with_position_sizing("fixed_fractional", 0.5).run(bars, "bb_mean_revert").filter("position <> 0")
    assert {abs(r.position) for r in half.collect()} == {0.5}
    scaled = execution.Engine().with_position_sizing("volatility_target", target_vol=0.2).run(bars, "macd_crossover").toPandas()
    assert 0 < scaled.position.abs().max() <= 3 and scaled.position.abs().nunique() > 20
    whole, kelly = (execution.Engine().with_position_sizing(m).run(bars, "sma_crossover", fast=5, slow=15).agg(F.max(F.abs("position"))).first()[0] for m in ("kelly", "half_kelly"))
    assert 0 <= kelly <= whole <= 1 and kelly == pytest.approx(whole / 2)
    with pytest.raises(ValueError):
        execution.Engine().with_position_sizing("all of it")
    with pytest.raises(ValueError):
        execution.sma_crossover(bars, 30, 10)


def test_portfolio_constraints(spark):
    rows = [("a", 0, 0.9), ("b", 0, 0.9), ("c", 0, -0.2), ("a", 1, 0.1), ("b", 1, 0.1), ("c", 1, 0.1)]
    df = spark.createDataFrame(rows, "key string, ts int, weight double")
    got = {(r.key, r.ts): r.weight for r in execution.constrain(df, execution.Constraints(0.5, 0.6, 0.3)).collect()}
    clamped = [0.5, 0.5, -0.2]
    scaled = [w * 0.6 / 1.2 for w in clamped]
    net = sum(scaled) - 0.3
    assert [got[k, 0] for k in "abc"] == pytest.approx([w - net / 3 for w in scaled]) and [got[k, 1] for k in "abc"] == pytest.approx([0.1] * 3)
    assert execution.constrain(df, execution.Constraints()) is df


def test_walk_forward_picks_the_best(spark):
    bars = table(spark, walk(200, 6))
    grid = [(3, 8), (5, 20), (10, 30)]
    best, tested = execution.walk_forward_search(bars, grid, 80, 40, metric="total_return")
    close = np.array([r.close for r in bars.orderBy("bar").collect()])

    def growth(c, fast, slow):
        avg = lambda p: np.array([c[i - p + 1 : i + 1].mean() if i >= p - 1 else np.nan for i in range(len(c))])
        s = np.where(np.isnan(avg(slow)), 0, np.where(avg(fast) > avg(slow), 1.0, -1.0))
        r = np.concatenate(([0], s[:-1] * (c[1:] / c[:-1] - 1)))
        return np.prod(1 + r) / (1 + r[0]) - 1

    rows = best.orderBy("fold").collect()
    assert len(rows) == 3
    for k, r in enumerate(rows):
        scores = [growth(close[40 * k : 40 * k + 80], *p) for p in grid]
        assert (r.fast, r.slow) == grid[int(np.argmax(scores))] and r.score == pytest.approx(max(scores), abs=2e-6)
    assert tested.count() == 120


def test_bootstrap_bands(spark):
    df = table(spark, walk(60, 7)).withColumn("strategy_return", F.col("close") / F.col("open") - 1)
    bands, risk = execution.bootstrap_bands(df, 25, 0.9, block=4)
    from barloom.operators.backtest import bootstrap_path

    r = np.array([x.strategy_return for x in df.orderBy("bar").collect()])
    curves = np.array([bootstrap_path(r, s, 42, 4) for s in range(25)])
    got = bands.orderBy("bar").collect()
    np.testing.assert_allclose([[b.lower, b.median, b.upper] for b in got], np.percentile(curves, [5, 50, 95], axis=0).T)
    var = np.percentile(curves[:, -1], 10)
    one = risk.first()
    assert one["var"] == pytest.approx(var) and one["cvar"] == pytest.approx(curves[:, -1][curves[:, -1] <= var].mean()) and one["prob_profit"] == pytest.approx((curves[:, -1] > 1).mean())


# --- regimes, adjustments, coarse bars -------------------------------------------------------------


def test_regimes(spark):
    bars = table(spark, walk(300, 2))
    close = np.array([r.close for r in bars.orderBy("bar").collect()])
    lr = np.concatenate(([np.nan], np.diff(np.log(close))))
    vol = np.array([lr[i - 19 : i + 1].std() if i >= 20 else np.nan for i in range(300)])
    ends = np.percentile(vol[20:], [25, 50, 75])
    want = np.where(np.isnan(vol), -1, np.digitize(vol, ends))
    assert [r.vol_regime for r in regimes.volatility_regime(bars, 20, 4).orderBy("bar").collect()] == want.tolist()
    held = regimes.RegimeFilter((0, 4), 20, 10, 40).filter(bars.withColumn("signal", F.lit(1.0))).orderBy("bar").collect()
    label = regimes.combined_regime(bars, 20, 10, 40).orderBy("bar").collect()
    assert [r.signal for r in held] == [1.0 if r.regime in (0, 4) else 0.0 for r in label] and {r.regime for r in label} >= {-1, 0, 3}
    for bad in (lambda: regimes.regime(bars, "x"), lambda: regimes.structural_breaks(bars, "x")):
        with pytest.raises(ValueError):
            bad()


def test_cusum_skips_what_has_no_score():
    x = np.array([*[5.0] * 12, 6.0, *[5.0] * 3, 9.0, 9.5, NAN, 30.0, 31.0, *np.arange(20.0)])
    up = down = 0.0
    want = np.zeros(len(x))
    for i in range(10, len(x)):
        part = x[i - 10 : i]
        sd = part.std(ddof=1)
        if sd == 0 or np.isnan(sd) or np.isnan(x[i]):
            continue
        z = (x[i] - part.mean()) / sd
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        if up > 3 or down > 3:
            want[i], up, down = 1, 0.0, 0.0
    assert kernels.cusum_breaks(x, 10).tolist() == want.tolist() and want.sum() > 0


def test_adjustments_one_by_one(spark):
    bars = table(spark, walk(40, 3), walk(30, 4, "j"))
    at = lambda i: T0 + timedelta(days=i)
    splits = [("k", at(10), 2.0), ("k", at(20), 3.0), ("k", at(20), 0.5), ("j", at(5), 1.5)]
    paid = [("k", at(0), 1.0), ("k", at(15), 2.0), ("k", at(20), 1.0), ("k", at(30), 0.5), ("k", at(33), 1e9), ("j", at(29) + timedelta(hours=3), 4.0)]
    got = adjust.adjust_ohlcv(bars, spark.createDataFrame(splits, "key string, ts timestamp, ratio double"), spark.createDataFrame(paid, "key string, ts timestamp, amount double")).toPandas()
    for key, g in bars.toPandas().sort_values("ts").groupby("key"):
        price, volume, c = np.ones(len(g)), np.ones(len(g)), g.close.to_numpy()
        for k, t, r in splits:
            if k == key:
                price[: (t - T0).days] /= r
                volume[: (t - T0).days] *= r
        for k, t, d in paid:
            i = math.ceil((t - T0) / timedelta(days=1))
            if k == key and i:
                f = (c[i - 1] * price[i - 1] - d) / (c[i - 1] * price[i - 1])
                if f > 0:
                    price[:i] *= f
        mine = got[got.key == key].sort_values("ts")
        np.testing.assert_allclose(mine.close, c * price)
        np.testing.assert_allclose(mine.low, g.low * price)
        np.testing.assert_allclose(mine.volume, g.volume * volume)
    assert adjust.adjust_ohlcv(bars).count() == 70
    with pytest.raises(Exception, match="above 0"):
        adjust.adjust_for_splits(bars, spark.createDataFrame([("k", at(3), 0.0)], "key string, ts timestamp, ratio double")).collect()


def test_coarse_bars(spark):
    bars = table(spark, walk(23, 3))
    aligned = adjust.align_to_coarse(bars.select("key", "ts", "bar"), B.resample(bars, 5), 5, ["close"]).orderBy("bar").collect()
    close = [r.close for r in bars.orderBy("bar").collect()]
    assert [r.close for r in aligned] == [close[min(i // 5, 3) * 5 + 4] for i in range(23)]
    with pytest.raises(ValueError):
        adjust.align_to_coarse(bars, bars, 0, [])
    pdf = bars.toPandas().set_index("ts")[["open", "high", "low", "close", "volume"]]
    agg = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
    for label in ("left", "right"):
        for closed in ("left", "right"):
            want = pdf.resample("4D", label=label, closed=closed, origin="epoch").agg(agg).dropna(how="all")
            got = B.resample_time(bars, "4d", label, closed).orderBy("ts").toPandas()
            assert got.ts.tolist() == want.index.tolist()
            np.testing.assert_allclose(got[list(agg)], want[list(agg)])
    assert [B.interval(x) for x in ("5min", "1h", "2 days", "W", "30S")] == ["5 minutes", "1 hours", "2 days", "1 weeks", "30 seconds"]
    for bad in ("", "5", "0min", "3 moons"):
        with pytest.raises(ValueError):
            B.interval(bad)
    for bad in ("tick", "tick:0", "tick:x", "money:3", "volume:-1"):
        with pytest.raises(ValueError):
            B.parse_tick_rule(bad)
    assert set(B.multi_timeframe(bars, ["2d", "1w"])) == {"2d", "1w"} and B.TickAggregator("time:60").rule == "time:60"


# --- names, defaults, chunks -----------------------------------------------------------------------


def test_many_indicators_in_one_plan(spark):
    bars = table(spark, walk(80, 3), walk(50, 4, "j")).drop("signal", "limit_price")
    out = features.compute_many(bars, ["SMA", ("sma", {"timeperiod": 5}), ("BBANDS", {"timeperiod": 7}), "STOCH", ("RSI", {"timeperiod": 9}), "ATR", "CDLDOJI"])
    assert out.columns[8:] == ["sma", "sma_2", "bbands_upper", "bbands_middle", "bbands_lower", "stoch_slowk", "stoch_slowd", "rsi", "atr", "cdldoji"]
    one = features.run_indicator("RSI", bars, timeperiod=9).orderBy("key", "bar").collect()
    assert [r.rsi for r in one] == [r.rsi for r in out.orderBy("key", "bar").collect()]
    plan = features.compute_many(bars.repartition(3), ["SMA", "BBANDS", "STOCH", "CCI"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    kept, dropped, filled = (features.feature_matrix(bars, [("SMA", {"timeperiod": 5}), "MOM"], p) for p in ("keep", "drop", "fill"))
    assert kept.count() == 130 and dropped.count() == 110 and filled.columns == ["key", "ts", "sma", "mom"]
    for bad, error in (([("SMA", {"timeperiod": 0})], errors.PeriodError), ([("SMA", {"timeperiod": 2.5})], errors.PeriodError), (["NOPE"], errors.RegistryError), ([("SMA", {"x": 1})], errors.ParameterError), ([("BOP", {"timeperiod": 3})], errors.ParameterError)):
        with pytest.raises(error):
            features.compute_many(bars, bad)
    with pytest.raises(errors.ParameterError):
        features.feature_matrix(bars, ["SMA"], "forget")
    features.register_indicator("twice", lambda df, by=2.0: df.withColumn("twice", F.col("close") * by))
    assert "TWICE" in features.list_indicators() and features.run_indicator("twice", bars, by=3.0).first().twice == pytest.approx(3 * bars.first().close)
    features.unregister_indicator("TWICE")
    with pytest.raises(errors.RegistryError):
        features.unregister_indicator("TWICE")


def test_small_helpers(spark):
    df = spark.createDataFrame([(NAN, 1.0), (None, 2.0), (float("inf"), 3.0), (-2.5, 4.0)], "x double, y double")
    most = float(np.finfo(float).max)
    assert [r.x for r in df.select(execution.nan_to_num(F.col("x")).alias("x")).collect()] == [0.0, 0.0, most, -2.5]
    assert [r.y for r in features.batch_apply(df, lambda c: c * 2, ["y"]).collect()] == [2.0, 4.0, 6.0, 8.0]
    assert features.trim_overlap([1, 2, 3], 1) == [2, 3] and features.trim_overlap([1], 0) == [1]
    grid = spark.createDataFrame([(90.0,), (110.0,)], "spot double")
    assert [r.payoff for r in O.leg_payoff(grid, "future", entry_price=100.0, side="short", quantity=2.0).orderBy("spot").collect()] == [20.0, -20.0]
    assert [r.payoff for r in O.leg_payoff(grid, strike=100.0, premium=3.0).orderBy("spot").collect()] == [-3.0, 7.0]


def test_defaults():
    config.reset()
    with config.Config(timeperiod=20, RSI__timeperiod=7):
        assert config.get_default("RSI.timeperiod") == 7 and config.get_default("ATR.timeperiod") == 20 and config.get_defaults_for("rsi") == {"timeperiod": 7}
    assert config.list_defaults() == {} and config.get_default("x", 4) == 4
    config.set_default("timeperiod", 3)
    config.set_default("SMA.timeperiod", 4)
    config.reset("timeperiod")
    assert config.list_defaults() == {"SMA.timeperiod": 4}
    config.reset()
    with pytest.raises(ValueError):
        config.set_default("", 1)


def test_defaults_reach_indicators(spark):
    bars = table(spark, walk(30, 3)).drop("signal", "limit_price")
    with config.Config(SMA__timeperiod=4):
        assert features.run_indicator("SMA", bars).filter("sma is not null").count() == 27
    assert features.run_indicator("SMA", bars).filter("sma is not null").count() == 1


def test_chunks_are_exact(spark):
    bars = table(spark, walk(203, 3), walk(57, 4, "j")).drop("signal", "limit_price")
    stages = [*sma(p=20), *stoch()]
    from barloom.plans.staged import apply_stages

    whole, parts = (x.orderBy("key", "bar").toPandas() for x in (apply_stages(bars, stages), features.chunk_apply(bars, stages, 50, 24)))
    pd.testing.assert_frame_equal(whole, parts)
    assert features.chunk_ranges(25, 10, 3) == [(0, 10), (7, 20), (17, 25)] and features.chunk_ranges(0, 10, 3) == []
    with pytest.raises(errors.ParameterError):
        features.split_chunks(bars, 10, 11)


def test_checks(spark):
    bars = table(spark, walk(9, 3))
    errors.check_timeperiod(2)
    errors.check_equal_length(a=[1], b=[2], c=None)
    errors.check_finite(bars, "close")
    errors.check_min_length(bars, 9)
    for f, e in ((lambda: errors.check_timeperiod(0), errors.PeriodError), (lambda: errors.check_timeperiod(True), errors.PeriodError), (lambda: errors.check_equal_length(a=[1], b=[]), errors.LengthMismatchError),
                 (lambda: errors.check_finite(bars, "signal"), errors.InvalidInputError), (lambda: errors.check_min_length(bars, 10), errors.TooShortError)):
        with pytest.raises(e):
            f()
    assert issubclass(errors.PeriodError, ValueError) and "E003" in str(errors.PeriodError("x", "y"))


def test_information():
    assert len(info.indicators()) > 150 and "RSI" in info.indicators("recurrence") and "CDLDOJI" in info.indicators("pattern")
    assert info.describe_indicator("rsi") == {"name": "RSI", "kind": "recurrence", "parameters": {"timeperiod": 14}, "outputs": ["rsi"]}
    assert info.info("BBANDS")["outputs"] == ["upper", "middle", "lower"] and info.info(sma)["signature"].startswith("(x=") and "operators.execution" in info.methods("operators")
    assert info.about()["name"] == "barloom"
    with pytest.raises(ValueError):
        info.indicators("none")


def test_currency(spark):
    want = {("INR", 12345678.0): "₹1,23,45,678.00", ("USD", 1234567.891): "$1,234,567.89", ("JPY", 1234.5): "¥1,235", ("INR", 0.999): "₹1.00", ("EUR", -12.3): "-€12.30", ("INR", 100.0): "₹100.00", ("GBP", 0.0): "£0.00", ("INR", -1e5): "-₹1,00,000.00"}
    rows = spark.createDataFrame([(c, a) for c, a in want] + [("USD", None)], "code string, amount double")
    for (code, amount), text in want.items():
        assert format_currency(amount, code) == text
        assert rows.filter((F.col("code") == code) & (F.col("amount") == amount)).select(CURRENCIES[code].column(F.col("amount"))).first()[0] == text
    assert rows.filter("amount is null").select(CURRENCIES["USD"].column(F.col("amount"))).first()[0] is None
    assert Currency.from_code("usd").symbol == "$" and Currency.from_code("XYZ") is None
    with pytest.raises(ValueError):
        format_currency(1, "XYZ")


def test_adapters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,HIGH,low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\n2024-01-02,2,3,1,,20\n")
    got = adapters.get_adapter("csv")(str(tmp_path / "a.csv"), rename={"Date": "ts"}, key="x").fetch(spark).orderBy("ts").collect()
    assert [(r.key, r.ts.day, r.open, r.high, r.low, r.close, r.volume) for r in got] == [("x", 1, 1.0, 2.0, 0.5, 1.5, 10.0), ("x", 2, 2.0, 3.0, 1.0, None, 20.0)]
    made = adapters.InMemoryAdapter({"key": ["a", "a"], "ts": [T0, T0 + timedelta(1)], **{c: [1.0, 2.0] for c in ("open", "high", "low", "close")}}).fetch(spark)
    assert made.columns == list(adapters.COLUMNS) and made.filter("volume is null").count() == 2
    adapters.write_bars(table(spark, walk(5), walk(4, 2, "j")).select(*adapters.COLUMNS), str(tmp_path / "bars"))
    back = adapters.ParquetAdapter(str(tmp_path / "bars")).fetch(spark)
    assert back.count() == 9 and "PartitionFilters: [isnotnull(key" in back.filter("key = 'j'")._jdf.queryExecution().executedPlan().toString()

    class Mine(adapters.DataAdapter):
        def fetch(self, spark, **options):
            return made

    adapters.register_adapter("Mine", Mine)
    assert adapters.get_adapter("mine")().fetch(spark) is made
    for bad in (lambda: adapters.get_adapter("nope"), lambda: adapters.InMemoryAdapter({"ts": [T0]}).fetch(spark), lambda: adapters.InMemoryAdapter({"ts": [T0]}, key="k").fetch(spark)):
        with pytest.raises(errors.BarloomError):
            bad()
    with pytest.raises(TypeError):
        adapters.register_adapter("x", dict)


def test_pipeline_and_workflow(spark):
    bars = table(spark, walk(120, 3)).drop("signal", "limit_price")
    pipe = pipeline.make_pipeline(mean=("SMA", {"timeperiod": 5}), band=("BBANDS", {}), gap=(lambda df: df.withColumn("gap", F.col("close") - F.col("mean")), {}))
    assert pipe.run(bars).columns[8:] == ["mean", "band_upper", "band_middle", "band_lower", "gap"] and len(pipe) == 3
    assert pipe.remove("band").names() == ["mean", "gap"]
    for bad in (lambda: pipe.add("mean", "SMA"), lambda: pipe.remove("x"), lambda: pipe.add("y", 3), lambda: pipeline.Workflow().add_strategy("x")):
        with pytest.raises(errors.ParameterError):
            bad()
    out = pipeline.run_pipeline(bars, {"rsi": ("RSI", {"timeperiod": 5})}, "sma_crossover", {"fast": 3, "slow": 9}, ("rsi", 70.0, 1))
    assert set(out) == {"indicators", "backtest", "alerts"} and out["alerts"].count() > 0
    assert pipeline.run_backtest("sma_crossover", bars, fast=3, slow=9).count() == 1


def test_alerts(spark):
    bars = table(spark, walk(60, 3), walk(40, 4, "j")).drop("signal", "limit_price")
    heard = []
    m = alerts.AlertManager("SYM").add_threshold_condition("up", "close", 101.0, 1, callback=heard.append, note="n").add_cross_condition("x", "close", "open")
    events = m.events(bars)
    for key, g in bars.toPandas().groupby("key"):
        c, o = g.close.to_numpy(), g.open.to_numpy()
        up = [i for i in range(1, len(c)) if c[i - 1] <= 101 < c[i]]
        cross = [(i, 1 if c[i] > o[i] else -1) for i in range(1, len(c)) if (c[i - 1] <= o[i - 1] and c[i] > o[i]) or (c[i - 1] >= o[i - 1] and c[i] < o[i])]
        mine = events.filter(F.col("key") == key).collect()
        assert sorted(r.bar for r in mine if r.condition_id == "up") == up and sorted((r.bar, r.direction) for r in mine if r.condition_id == "x") == cross
    assert m.send(events) == events.count() and all(e.payload["symbol"] == "SYM" and e.payload["note"] == "n" for e in heard) and len(heard) == events.filter("condition_id = 'up'").count()
    assert alerts.AlertManager().events(bars).count() == 0
    for bad in (lambda: m.add_threshold_condition("up", "close", 1.0), lambda: alerts.AlertManager().add_threshold_condition("a", "close", 1.0, 0)):
        with pytest.raises(errors.ParameterError):
            bad()


# --- options, futures, optimizers ------------------------------------------------------------------


def test_strikes_and_presets(spark):
    chain = spark.createDataFrame([("c", float(k), 101.0, 0.01, 0.0, 0.5, 0.2 + abs(k - 100) / 500) for k in (80, 90, 100, 110, 120)], "chain string, strike double, spot double, rate double, carry double, t double, vol double")
    pick = lambda s, call=True: O.select_strike(chain, s, call).first().strike
    assert [pick("ATM"), pick("OTM1"), pick("ITM2"), pick("OTM1", False), pick("ITM", False), pick("OTM9")] == [100, 110, 80, 90, 110, None]
    assert pick("DELTA0.9") == 80 and pick("DELTA-0.1", False) in (80, 90)
    for bad in ("", "XTM1", "DELTA", "OTMx"):
        with pytest.raises(errors.ParameterError):
            O.selector_of(bad, True)
    expiry = O.ExpirySelector()
    condor = O.build_strategy_preset("iron_condor", name="n", underlying="u", expiry_selector=expiry)
    assert len(condor.legs) == 4 and condor.to_dict()["preset"] == "iron_condor"
    legs = O.legs_of(condor, chain, 0.5)
    assert [(leg.strike, leg.side) for leg in legs] == [(90, "short"), (80, "long"), (110, "short"), (120, "long")]
    pay = {r.spot: r.payoff for r in O.strategy_payoff(spark.createDataFrame([(60.0,), (100.0,), (150.0,)], "spot double"), legs).collect()}
    credit = sum(leg.premium * (1 if leg.side == "short" else -1) for leg in legs)
    assert credit > 0 and pay == pytest.approx({60.0: credit - 10, 100.0: credit, 150.0: credit - 10})
    now = O.strategy_value(spark.createDataFrame([(101.0,)], "spot double"), legs).first().value
    assert now == pytest.approx(0, abs=1e-9)
    for bad in (lambda: O.build_strategy_preset("custom", name="n", underlying="u", expiry_selector=expiry), lambda: O.StrikeSelector("otm", steps=-1), lambda: O.ExpirySelector("explicit_date"), lambda: O.RiskControl(stop_loss_value=-1.0), lambda: O.SimulationLimits(cooldown_bars=-1),
                lambda: O.StrategyLeg("u", expiry, O.StrikeSelector(), "call", "flat"), lambda: O.PayoffLeg("bond"), lambda: O.PayoffLeg(strike=0), lambda: replace(condor, commission=-1), lambda: O.StrikeSelector("delta", delta=2)):
        with pytest.raises(ValueError):
            bad()


def test_expiries():
    days = [date(2024, 1, 4), date(2024, 1, 11), date(2024, 1, 25), date(2024, 2, 1), date(2024, 2, 29)]
    pick = lambda kind, today, **kw: O.ExpirySelector(kind, **kw).pick(days, today)
    assert [pick(k, date(2024, 1, 5)) for k in ("current_week", "next_week", "current_month", "next_month")] == [days[1], days[2], days[2], days[4]]
    assert pick("current_month", date(2024, 1, 26)) == days[4] and pick("explicit_date", date(2024, 1, 1), explicit_date=days[3]) == days[3]
    with pytest.raises(ValueError):
        pick("next_month", date(2024, 2, 2))


def test_greeks_are_slopes(spark):
    df = spark.createDataFrame([(100.0, float(k), 0.03, 0.0, 0.5, 0.25, c) for k in (90, 100, 115) for c in (0, 1)], "spot double, strike double, rate double, carry double, t double, vol double, is_call int")
    from barloom.plans.staged import apply_stages

    got = O.black76_greeks(df).orderBy("strike", "is_call").collect()
    price = lambda **kw: [r.price for r in apply_stages(df.withColumns({k: F.col(k) + v for k, v in kw.items()}), derivatives.black76()).orderBy("strike", "is_call").collect()]
    h = 1e-3
    for name, kw, scale in (("delta", {"spot": h}, 1), ("vega", {"vol": h}, 1), ("rho", {"rate": h}, 1)):
        slope = [(a - b) / (2 * h) for a, b in zip(price(**kw), price(**{k: -v for k, v in kw.items()}), strict=True)]
        assert [r[name] for r in got] == pytest.approx(slope, abs=2e-3), name
    cash = O.digital_greeks(df).collect()
    assert all(r.delta > 0 for r in cash if r.is_call) and all(r.delta < 0 for r in cash if not r.is_call)
    assert O.digital_greeks(df, "asset").count() == 6


def test_optimizers(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(5, 5))
    cov, mean = a @ a.T / 50 + 0.01 * np.eye(5), rng.normal(0.05, 0.05, 5)
    tries = rng.dirichlet(np.ones(5), 40_000)
    risk = np.einsum("ij,jk,ik->i", tries, cov, tries)
    w = optimize.mean_variance(mean, cov)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and w @ cov @ w <= risk.min() + 1e-12
    goal = float(np.median(mean))
    w = optimize.mean_variance(mean, cov, goal)
    assert w @ mean == pytest.approx(goal) and (w >= 0).all() and w @ cov @ w <= risk[np.abs(tries @ mean - goal) < 1e-3].min() * 1.01
    w = optimize.max_sharpe(mean, cov)
    assert (w >= -1e-12).all() and w @ mean / np.sqrt(w @ cov @ w) >= (tries @ mean / np.sqrt(risk)).max() - 1e-9
    w = optimize.risk_parity(cov, np.array([1, 2, 3, 4, 5]))
    share = w * (cov @ w)
    assert share / share.sum() == pytest.approx(np.arange(1, 6) / 15)
    assert optimize.max_sharpe(-abs(mean) - 0.1, cov).sum() == pytest.approx(1)
    bars = table(spark, walk(80, 1, "a"), walk(80, 2, "b"), walk(80, 3, "c"))
    rets = optimize.simple_returns(bars)
    keys, m, c = optimize.moments(rets, 50)
    wide = rets.toPandas().dropna().pivot(index="ts", columns="key", values="ret").tail(50)
    np.testing.assert_allclose(c, wide.cov().to_numpy() + 1e-8 * np.eye(3))
    np.testing.assert_allclose(m, wide.mean())
    got = optimize.PortfolioOptimizer().with_method("risk_parity").with_lookback(50).optimize(rets)
    assert list(got) == ["a", "b", "c"] == keys and sum(got.values()) == pytest.approx(1)
    assert optimize.PortfolioOptimizer().optimize(rets.filter("key = 'a'")) == {"a": 1.0}
    for bad in (lambda: optimize.PortfolioOptimizer().with_method("luck"), lambda: optimize.mean_variance(mean, cov, 9.0), lambda: optimize.risk_parity(cov, [1, 1]), lambda: optimize.moments(rets.limit(0))):
        with pytest.raises(ValueError):
            bad()


# --- cycles, streams, warping ----------------------------------------------------------------------


def test_cycles_of_a_sine():
    x = 100 + 5 * np.sin(np.arange(400) * 2 * np.pi / 20)
    got = cycles.cycle(x)
    assert np.isnan(got["ht_dcperiod"][:63]).all() and got["ht_dcperiod"][200:].mean() == pytest.approx(20, abs=2)
    assert (np.abs(got["sine"][63:]) <= 1).all() and set(got["ht_trendmode"].tolist()) <= {0.0, 1.0}
    lead, follow = cycles.mama(x)
    assert np.isnan(lead[:32]).all() and not np.isnan(lead[32:]).any() and np.abs(follow[100:] - 100).max() < 5
    assert np.isnan(cycles.cycle(x[:63])["sine"]).all() and np.isnan(cycles.mama(x[:32])[0]).all()


def test_streaming_backtest_and_paper_trader():
    g = walk(150, 11)
    s = StreamingBacktest(0.001, 10)
    got = [s.step(c, x) for c, x in zip(g.close, g.signal, strict=True)]
    equity, pos, before = 1.0, 0.0, None
    for (p, _, e, _), c, x in zip(got, g.close, g.signal, strict=True):
        equity *= 1 + (pos * (c / before - 1) if before else 0)
        want = 0.0 if math.isnan(x) else x
        if want != pos:
            equity = equity * 0.999 - 0.001
        pos, before = want, c
        assert (p, e) == (pos, pytest.approx(equity))
    said = s.summary()
    assert said["n_trades"] == s.n_trades > 5 and 0 <= said["kelly_fraction"] <= 1 and 0 < said["win_rate"] < 1
    s.reset()
    assert s.equity == 1 and s.n_trades == 0 and s.commission_per_trade == 0.001
    rules = Rules(stop_loss_pct=0.04, take_profit_pct=0.07, trailing_stop_pct=0.06, slippage_bps=7)
    trader = PaperTrader(stop_loss_pct=0.04, take_profit_pct=0.07, trailing_stop_pct=0.06, slippage_bps=7)
    steps = [trader.step(*b) for b in zip(g.open, g.high, g.low, g.close, g.signal, strict=True)]
    batch = simulate(g.open, g.high, g.low, g.close, g.signal, rules)
    np.testing.assert_allclose([x[2] for x in steps], batch["equity"])
    np.testing.assert_allclose([x[0] for x in steps], batch["position"])
    assert trader.trades and trader.equity_abs == pytest.approx(1e5 * trader.equity) and all(t["exit_bar"] >= t["entry_bar"] for t in trader.trades)
    trader.reset()
    assert trader.position == 0 and not trader.trades


def test_steppers_start_anew_and_travel():
    import pickle

    from barloom.streaming.indicators import STEPPERS

    g = walk(60, 12)
    for name, (make, ins, _) in STEPPERS.items():
        stepper, rows = make(**({"p": 5} if name in ("SMA", "EMA", "RSI", "ATR") else {})), list(zip(*(g[c] for c in ins), strict=True))
        first = [stepper.step(*r) for r in rows]
        stepper.reset()
        half = [stepper.step(*r) for r in rows[:30]]
        moved = pickle.loads(pickle.dumps(stepper))
        np.testing.assert_array_equal(np.array(first, dtype=float), np.array(half + [moved.step(*r) for r in rows[30:]], dtype=float), err_msg=name)
        moved.reset()
        np.testing.assert_array_equal(np.array(moved.step(*rows[0]), dtype=float), np.array(first[0], dtype=float))


def test_warping_paths():
    rng = np.random.default_rng(2)
    for window in (None, 4):
        for _ in range(20):
            a, b = rng.normal(size=rng.integers(1, 9)), rng.normal(size=rng.integers(1, 9))
            path = series_pairs.dtw_path(a, b, window)
            far = series_pairs.dtw_distance(a, b, window)
            if not path:
                assert not np.isfinite(far)
                continue
            assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
            assert all((x - i, y - j) in ((1, 1), (1, 0), (0, 1)) for (i, j), (x, y) in zip(path, path[1:], strict=False))
            assert math.sqrt(sum((a[i] - b[j]) ** 2 for i, j in path)) == pytest.approx(far)
    assert series_pairs.dtw_path(np.empty(0), np.ones(3)) == []


def test_known_values():
    x = np.array([44.0, 44.25, 44.5, 43.75, 44.65, 45.12, 45.61, 46.28, 46.0, 46.03])
    assert kernels.wma(np.array([1.0, 2, 3, 4, 5]), 3)[2:].tolist() == pytest.approx([14 / 6, 20 / 6, 26 / 6])
    assert kernels.ema(np.array([1.0, 2, 3, 4, 5]), 3)[2:].tolist() == [2.0, 3.0, 4.0]
    assert kernels.rsi(np.arange(20.0), 14)[14:].tolist() == [100.0] * 6 and kernels.rsi(-np.arange(20.0), 14)[-1] == 0
    assert kernels.true_range(np.array([10.0, 12, 11]), np.array([9.0, 10, 8]), np.array([9.5, 11, 9])).tolist() == [1.0, 2.5, 3.0]
    assert np.isnan(kernels.kama(x, 5)[:4]).all() and kernels.kama(x, 5)[4] == 44.65
    assert kernels.moving_average(x, 3, 0)[2] == pytest.approx(44.25)


def test_random_bars_never_break_the_account():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(1, 12)
        rows = [[rng.choice([0.0, 1.0, 2.0, 50.0, 1e-9, 1e12]) for _ in range(4)] for _ in range(n)]
        rules = Rules(stop_loss_pct=rng.choice([0, 0.1]), trailing_stop_pct=rng.choice([0, 0.2]), margin_ratio=rng.choice([0, 0.5]), commission=FEES, fill_mode=rng.choice(["market_open", "market_close"]))
        got = simulate(*zip(*rows, strict=True), [rng.choice([1, -1, 0, NAN, 2.5]) for _ in range(n)], rules)
        assert all(len(v) == n for v in got.values())
