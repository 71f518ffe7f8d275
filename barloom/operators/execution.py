"""Strategies, the bar-by-bar account as an operator, its trades, portfolios of many keys, folds with parameter search, and bootstrap bands.

Signals are columns; the account is a recurrence (each bar depends on the one before), so a key goes to one Python worker and
keys run side by side. Trades, portfolios, folds and bands are windows and aggregations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from barloom.functions.account import Fill, Rules, simulate
from barloom.functions.commission import Commission
from barloom.operators.backtest import EQUITY, metrics_sql, monte_carlo_curves, returns, walk_forward
from barloom.operators.recurrences import apply_recurrences
from barloom.operators.window_indicators import bbands, sma
from barloom.plans.account_sql import account_sql
from barloom.plans.frames import CUM, W, fixed
from barloom.plans.recursive_sql import Query
from barloom.plans.staged import Stages, apply_stages, rounded
from barloom.workers import workers_import

# --- strategies ------------------------------------------------------------------------------------

_RSI_RULE = "CASE WHEN rsi <= {low!r} THEN 1.0 WHEN rsi >= {high!r} THEN -1.0 WHEN rsi IS NOT NULL THEN 0.0 END"


def _with(df: DataFrame, signal: str, *helpers: str) -> DataFrame:
    return df.withColumn("signal", F.expr(signal).cast("double")).drop(*helpers)


def rsi_threshold(df: DataFrame, timeperiod: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> DataFrame:
    """1 where the RSI is at most oversold, -1 where at least overbought, else 0; null in the warm-up."""
    return _with(apply_recurrences(df, [("RSI", {"p": timeperiod})]), _RSI_RULE.format(low=float(oversold), high=float(overbought)), "rsi")


def sma_crossover(df: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """1 while the fast average is above the slow one, else -1."""
    if fast >= slow:
        raise ValueError(f"fast ({fast}) must be below slow ({slow})")
    both = apply_stages(df, [{"fast_": sma(p=fast)[0]["sma"], "slow_": sma(p=slow)[0]["sma"]}])
    return _with(both, "CASE WHEN fast_ > slow_ THEN 1 WHEN slow_ IS NOT NULL THEN -1 END", "fast_", "slow_")


def macd_crossover(df: DataFrame, fastperiod: int = 12, slowperiod: int = 26, signalperiod: int = 9) -> DataFrame:
    """1 while the MACD is above its signal line, else -1."""
    if fastperiod >= slowperiod:
        raise ValueError(f"fastperiod ({fastperiod}) must be below slowperiod ({slowperiod})")
    made = apply_recurrences(df.drop("signal"), [("MACD", {"fast": fastperiod, "slow": slowperiod, "signal": signalperiod})]).withColumnRenamed("signal", "line_")
    return _with(made, "CASE WHEN macd > line_ THEN 1 WHEN line_ IS NOT NULL THEN -1 END", "macd", "line_", "hist")


def adx_trend_follow(df: DataFrame, adx_period: int = 14, adx_threshold: float = 25.0, sma_period: int = 50) -> DataFrame:
    """1 in a strong trend above the average, else -1."""
    made = apply_recurrences(apply_stages(df, sma(p=sma_period)), [("ADX", {"p": adx_period})])
    return _with(made, f"CASE WHEN adx IS NULL OR sma IS NULL THEN NULL WHEN adx > {float(adx_threshold)!r} AND close > sma THEN 1 ELSE -1 END", "adx", "sma")


def bb_mean_revert(df: DataFrame, timeperiod: int = 20, nbdevup: float = 2.0, nbdevdn: float = 2.0) -> DataFrame:
    """1 at or below the lower band, -1 at or above the upper one, else 0."""
    made = apply_stages(df, bbands(timeperiod, nbdevup, nbdevdn))
    return _with(made, "CASE WHEN close <= lower THEN 1 WHEN close >= upper THEN -1 WHEN upper IS NOT NULL THEN 0 END", "upper", "middle", "lower")


def rsi_sma_combo(df: DataFrame, rsi_period: int = 14, oversold: float = 30.0, overbought: float = 70.0, sma_period: int = 50) -> DataFrame:
    """The RSI's signals where the trend by the average agrees."""
    made = apply_stages(rsi_threshold(df, rsi_period, oversold, overbought).withColumnRenamed("signal", "rsi_"), sma(p=sma_period))
    return _with(made, "CASE WHEN rsi_ IS NULL OR sma IS NULL THEN NULL WHEN rsi_ = CASE WHEN close > sma THEN 1 ELSE -1 END THEN rsi_ ELSE 0 END", "rsi_", "sma")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "rsi_30_70": rsi_threshold, "sma_crossover": sma_crossover, "macd_crossover": macd_crossover, "adx_trend_follow": adx_trend_follow, "bb_mean_revert": bb_mean_revert, "rsi_sma_combo": rsi_sma_combo,
}


# --- the account -----------------------------------------------------------------------------------


def run_account(bars: DataFrame, rules: Rules, limit: str | None = None) -> DataFrame:
    """bars (with signal) and position, fill_price, bar_return, strategy_return, equity. limit names a column of limit prices.

    Missing signals ask for no position; a bar's signal is acted on in the next bar; a null fill price means no trade.
    """
    workers_import(bars.sparkSession)
    names = [*Fill._fields, "equity"]
    kept = [f for f in bars.schema.fields if f.name not in names]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        ins = [pdf[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close", "signal")]
        got = simulate(*ins, rules, pdf[limit].to_numpy(dtype=float) if limit else None)
        for name in names:
            x = got[name]
            pdf[name] = pd.Series(x, index=pdf.index).astype(object).where(~np.isnan(x), None) if name == "fill_price" else x
        return pdf[[f.name for f in kept] + names]

    return bars.groupBy("key").applyInPandas(run, StructType([*kept, *[StructField(x, DoubleType()) for x in names]]))


def nan_to_num(c: Column) -> Column:
    """0 for missing values, the greatest and least double for infinite ones."""
    most = float(np.finfo(float).max)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), c)))


# A trade lasts while the position keeps its side; the bar that closes it is the first of the next run, or the series' last bar.
_END = "lead({0}) OVER (PARTITION BY key ORDER BY ts)"
TRADE_STAGES: Stages = [
    {"_side": "cast(sign(position) AS DOUBLE)", "_px": "CASE WHEN fill_price > 0 THEN fill_price END"},
    {"_new": "CASE WHEN lag(_side) OVER (PARTITION BY key ORDER BY ts) = _side THEN 0 ELSE 1 END", "_nh": _END.format("greatest(high, low)"), "_nl": _END.format("least(high, low)"),
     "_nbar": _END.format("bar"), "_npx": _END.format("coalesce(_px, low)"), "_now": "coalesce(_px, high)"},
    {"_run": f"sum(_new) {CUM}"},
]


def trades(result: DataFrame) -> DataFrame:
    """entry_bar, exit_bar, direction, prices, pnl_pct, duration_bars, mae, mfe of every run of positions on one side (key, ts, bar, high, low, position, fill_price)."""
    df = result
    for st in TRADE_STAGES:
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in st.items()])
    runs = df.filter("_side <> 0").groupBy("key", "_run").agg(
        F.min("bar").alias("entry_bar"), F.first("_side").alias("direction"), F.min_by("_now", "bar").alias("entry_price"), F.max_by("_nbar", "bar").alias("_xbar"), F.max("bar").alias("_last"),
        F.max_by("_npx", "bar").alias("_xpx"), F.max_by("_now", "bar").alias("_opx"), F.max("_nh").alias("_hi"), F.min("_nl").alias("_lo"),
    )
    best, worst = "greatest(direction * (_hi - entry_price), direction * (_lo - entry_price)) / entry_price", "least(direction * (_hi - entry_price), direction * (_lo - entry_price)) / entry_price"
    closed = runs.selectExpr("*", "coalesce(_xbar, _last) AS exit_bar", "CASE WHEN _xbar IS NULL THEN _opx ELSE _xpx END AS exit_price")
    return closed.selectExpr(
        "key", "entry_bar", "exit_bar", "direction", "entry_price", "exit_price", "CASE WHEN entry_price > 0 THEN direction * (exit_price - entry_price) / entry_price ELSE 0.0 END AS pnl_pct",
        "exit_bar - entry_bar AS duration_bars", f"coalesce(CASE WHEN entry_price > 0 THEN least(0.0, {worst}) END, 0.0) AS mae", f"coalesce(CASE WHEN entry_price > 0 THEN greatest(0.0, {best}) END, 0.0) AS mfe",
    )


SIZINGS = ("fixed", "fixed_fractional", "volatility_target", "kelly", "half_kelly")


@dataclass(frozen=True)
class Engine:
    """A backtest's settings; every `with_` gives a new engine, and `run` the bars with signals, fills, returns and equity."""

    rules: Rules = field(default_factory=Rules)
    sizing: str = "fixed"
    fraction: float = 1.0
    target_vol: float = 0.1
    vol_window: int = 20
    limit: str | None = None
    risk_free_rate: float = 0.0
    currency: str | None = None

    def _rule(self, **kw) -> Engine:
        return replace(self, rules=replace(self.rules, **kw))

    def with_commission(self, per_trade: float) -> Engine:
        return self._rule(commission=Commission(flat_per_order=per_trade))

    def with_commission_model(self, model: Commission) -> Engine:
        return self._rule(commission=model)

    def with_initial_capital(self, capital: float) -> Engine:
        return self._rule(initial_capital=float(capital))

    def with_currency(self, code: str) -> Engine:
        return replace(self, currency=code)

    def with_slippage(self, bps: float) -> Engine:
        return self._rule(slippage_bps=bps)

    def with_slippage_pct_range(self, pct: float) -> Engine:
        return self._rule(slippage_pct_range=pct)

    def with_fill_mode(self, mode: str) -> Engine:
        return self._rule(fill_mode=mode)

    def with_stop_loss(self, pct: float) -> Engine:
        return self._rule(stop_loss_pct=pct)

    def with_take_profit(self, pct: float) -> Engine:
        return self._rule(take_profit_pct=pct)

    def with_trailing_stop(self, pct: float) -> Engine:
        return self._rule(trailing_stop_pct=pct)

    def with_breakeven_stop(self, pct: float) -> Engine:
        return self._rule(breakeven_pct=pct)

    def with_max_hold(self, bars: int) -> Engine:
        return self._rule(max_hold_bars=bars)

    def with_leverage(self, margin_ratio: float, margin_call_pct: float = 0.5) -> Engine:
        return self._rule(margin_ratio=margin_ratio, margin_call_pct=margin_call_pct)

    def with_loss_limits(self, daily: float = 0.0, total: float = 0.0) -> Engine:
        return self._rule(daily_loss_limit=daily, total_loss_limit=total)

    def with_calendar(self, periods_per_year: float) -> Engine:
        return self._rule(periods_per_year=periods_per_year)

    def with_risk_free_rate(self, rate: float) -> Engine:
        return replace(self, risk_free_rate=rate)

    def with_limit_orders(self, column: str) -> Engine:
        return replace(self, limit=column)

    def with_position_sizing(self, method: str, fraction: float = 1.0, target_vol: float = 0.1, vol_window: int = 20) -> Engine:
        if method not in SIZINGS:
            raise ValueError(f"sizing is one of {', '.join(SIZINGS)}")
        return replace(self, sizing=method, fraction=fraction, target_vol=target_vol, vol_window=vol_window)

    def sized(self, df: DataFrame) -> DataFrame:
        """Signals times the fraction, or times the target volatility over that of the bars before (0 to 3 times)."""
        if self.sizing == "fixed_fractional":
            return df.withColumn("signal", F.col("signal") * self.fraction)
        if self.sizing == "volatility_target":
            return apply_stages(df.withColumnRenamed("signal", "raw_"), _vol_target(self.target_vol, self.vol_window, self.rules.periods_per_year)).drop("raw_")
        return df

    def run(self, bars: DataFrame, strategy: str | Callable[..., DataFrame] = "rsi_30_70", **params) -> DataFrame:
        make = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
        signals = self.sized(make(bars, **params))
        first = run_account(signals, self.rules, self.limit)
        if self.sizing not in ("kelly", "half_kelly"):
            return first
        # Kelly takes its share from a first run of the same signals.
        share = kelly_share(first).withColumn("share", F.col("share") * (1.0 if self.sizing == "kelly" else 0.5))
        scaled = signals.join(share, "key").withColumn("signal", F.col("signal") * F.coalesce("share", F.lit(1.0))).drop("share")
        return run_account(scaled, self.rules, self.limit)

    def metrics(self, result: DataFrame) -> DataFrame:
        return result.sparkSession.sql(metrics_sql("{t}", self.rules.periods_per_year, self.risk_free_rate), t=result)

    def trades(self, result: DataFrame) -> DataFrame:
        return trades(result)


def _vol_target(target: float, w: int, periods: float) -> Stages:
    return [
        {"_pc": "lag(close) OVER (PARTITION BY key ORDER BY ts)"}, {"_r": "close / nullif(_pc, 0) - 1"},
        {"_v": f"CASE WHEN count(_r) {W(w)} = {w} THEN stddev_pop(_r) {W(w)} * {periods**0.5!r} END"},
        {"_w": "lag(_v) OVER (PARTITION BY key ORDER BY ts)"}, {"signal": f"raw_ * CASE WHEN _w > 0 THEN least(3.0, {target!r} / _w) ELSE 1.0 END"},
    ]


def kelly_share(result: DataFrame) -> DataFrame:
    """key, share: the Kelly share of the bars' returns; null where nothing was won."""
    r = F.col("strategy_return")
    parts = result.groupBy("key").agg(F.avg(F.when(r > 0, 1.0).when(r < 0, 0.0)).alias("w"), F.avg(F.when(r > 0, r)).alias("g"), F.avg(F.when(r < 0, r)).alias("l"))
    return parts.selectExpr("key", "CASE WHEN g > 0 THEN greatest(0.0, least(1.0, w - (1 - w) * abs(coalesce(l, 0.0)) / g)) END AS share")


# --- portfolios ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Constraints:
    max_asset_weight: float = 1.0
    max_gross_exposure: float = 0.0
    max_net_exposure: float = 0.0


def constrain(df: DataFrame, c: Constraints, n_assets: int | None = None) -> DataFrame:
    """weight held to the limits of each time: each asset's, then the sum of sizes, then the net sum (shared by all).

    Sums by time are joined back, so that no task needs all assets of a time.
    """
    if c == Constraints():
        return df
    out = df
    if c.max_asset_weight > 0:
        out = out.withColumn("weight", F.greatest(F.lit(-c.max_asset_weight), F.least(F.lit(c.max_asset_weight), "weight")))
    if c.max_gross_exposure > 0:
        gross = out.groupBy("ts").agg(F.sum(F.abs("weight")).alias("gross_"))
        out = out.join(gross, "ts").withColumn("weight", F.col("weight") * F.least(F.lit(1.0), c.max_gross_exposure / F.when(F.col("gross_") > 0, F.col("gross_")).otherwise(c.max_gross_exposure))).drop("gross_")
    if c.max_net_exposure > 0:
        net = out.groupBy("ts").agg(F.sum("weight").alias("net_"), F.count("*").alias("n_"))
        excess = F.when(F.abs("net_") > c.max_net_exposure, F.col("net_") - F.signum("net_") * c.max_net_exposure).otherwise(0.0)
        out = out.join(net, "ts").withColumn("weight", F.col("weight") - excess / (F.lit(n_assets) if n_assets else F.col("n_"))).drop("net_", "n_")
    return out


def portfolio(df: DataFrame, c: Constraints = Constraints(), slippage_bps: float = 0.0) -> DataFrame:  # noqa: B008
    """ts, portfolio_return, portfolio_equity from (key, ts, close, weight): weights act a bar later, returns of all keys add up."""
    held = apply_stages(constrain(df, c).withColumnRenamed("weight", "signal"), returns(slippage_bps))
    total = held.groupBy("ts").agg(F.sum("strategy_return").alias("portfolio_return"))
    # One row for each time is left: their product needs one order.
    one = total.select(F.lit("all").alias("key"), "ts", F.col("portfolio_return").alias("strategy_return"))
    return apply_stages(one, EQUITY).select("ts", F.col("strategy_return").alias("portfolio_return"), F.col("equity").alias("portfolio_equity"))


# --- folds and bands -------------------------------------------------------------------------------


def walk_forward_search(bars: DataFrame, grid: list[tuple[int, int]], train: int, test: int, step: int = 0, anchored: bool = False, metric: str = "sharpe", slippage_bps: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Crossings of averages with the parameters that did best in each training fold: (best by fold, its test returns).

    Folds and parameters are rows: one plan for all, whatever their number.
    """
    folds = walk_forward(bars, train, test, step, anchored)
    params = bars.sparkSession.createDataFrame([(i, f, s) for i, (f, s) in enumerate(grid)], "param int, fast int, slow int")

    def part(first: str, end: str) -> DataFrame:
        rows = bars.select("key", "ts", "bar", "close").join(folds.select(F.col("key").alias("k"), "fold", F.col(first).alias("a"), F.col(end).alias("b")), (F.col("key") == F.col("k")) & (F.col("bar") >= F.col("a")) & (F.col("bar") < F.col("b")))
        return rows.select("key", "fold", "ts", "bar", "close", (F.col("bar") - F.col("a")).alias("at"))

    def run(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        w = Window.partitionBy("key", "fold").orderBy("ts")
        averages = {p: F.avg("close").over(w.rowsBetween(1 - p, 0)) for p in sorted({p for pair in grid for p in pair})}
        wide = rows.select("*", F.create_map(*[x for p, e in averages.items() for x in (F.lit(p), e)]).alias("m"))
        each = wide.join(chosen, [c for c in ("key", "fold") if c in chosen.columns]) if "fold" in chosen.columns else wide.join(F.broadcast(chosen))
        signal = F.when(F.col("at") >= F.col("slow") - 1, F.when(F.col("m")[F.col("fast")] > F.col("m")[F.col("slow")], 1.0).otherwise(-1.0))
        named = each.select(F.concat_ws("|", "key", "fold", "param").alias("key"), F.col("key").alias("of"), "fold", "param", "ts", F.col("at").alias("bar"), "close", signal.alias("signal"))
        return apply_stages(apply_stages(named, returns(slippage_bps)), EQUITY)

    trained = run(part("train_start", "train_end"), params)
    scores = bars.sparkSession.sql(metrics_sql("{t}"), t=trained).select("key", F.col(metric).alias("score"))
    names = trained.select("key", "of", "fold", "param").distinct()
    # The first of equals, as in a search from the front; a missing score loses.
    best = names.join(scores, "key").groupBy(F.col("of").alias("key"), "fold").agg(F.max_by("param", F.struct(F.coalesce("score", F.lit(float("-inf"))), -F.col("param"))).alias("param"), F.max("score").alias("score"))
    chosen = best.join(F.broadcast(params), "param")
    tested = run(part("test_start", "test_end"), chosen.select("key", "fold", "param", "fast", "slow"))
    return chosen.select("key", "fold", "fast", "slow", "score"), tested.select(F.col("of").alias("key"), "fold", "ts", "strategy_return", "equity")


def bootstrap_bands(bars: DataFrame, n_sims: int = 100, confidence: float = 0.95, seed: int = 42, block: int = 5) -> tuple[DataFrame, DataFrame]:
    """(key, bar, lower, median, upper) and (key, var, cvar, prob_profit) over resampled equity curves."""
    curves = monte_carlo_curves(bars, n_sims, seed, block)
    low, high = (1 - confidence) / 2, (1 + confidence) / 2
    bands = curves.groupBy("key", "bar").agg(*[F.percentile("equity", F.lit(q)).alias(n) for n, q in (("lower", low), ("median", 0.5), ("upper", high))])
    last = curves.withColumn("n", F.max("bar").over(Window.partitionBy("key"))).filter("bar = n").select("key", "equity")
    at = last.groupBy("key").agg(F.percentile("equity", F.lit(1 - confidence)).alias("var"))
    risk = last.join(at, "key").groupBy("key").agg(F.first("var").alias("var"), F.avg(F.when(F.col("equity") <= F.col("var"), F.col("equity"))).alias("cvar"), F.avg((F.col("equity") > 1).cast("double")).alias("prob_profit"))
    return bands, risk


# --- queries ---------------------------------------------------------------------------------------

# Odd numbers, so that no price lies on the edge of a rounding.
RULES_BRACKET = Rules(stop_loss_pct=0.031237, take_profit_pct=0.052791, slippage_bps=5.1237, max_hold_bars=15)
RULES_FULL = Rules(
    trailing_stop_pct=0.061237, breakeven_pct=0.021237, stop_loss_pct=0.081237, slippage_pct_range=0.0012371, margin_ratio=0.2, margin_call_pct=0.6, daily_loss_limit=0.5, total_loss_limit=0.95,
    commission=replace(Commission.preset("equity_intraday_india"), spread_bps=2.0, short_borrow_rate_annual=0.02),
)
_SIZED = "CASE WHEN bar >= 29 THEN CASE WHEN avg(close) {w10} > avg(close) {w30} THEN {weight} ELSE -{weight} END END"


def _rules_base(base: str, weight: float = 0.0025) -> str:
    sized = _SIZED.format(w10=W(10), w30=W(30), weight=weight)
    return f"SELECT *, {sized} AS signal, CASE WHEN bar % 3 = 0 THEN close * (1 + 0.0101237 * (bar % 5 - 2)) END AS limit_price FROM ({base})"


def register(add, src) -> None:
    bars, BARS = src["bars"], src["BARS"]
    none = "CASE WHEN {0} IS NULL THEN NULL ELSE {1} END"
    rsi = Query(BARS).add(g="greatest(close - lag(close) OVER w, 0)", l="greatest(lag(close) OVER w - close, 0)").wilder("a", "g", 14).wilder("b", "l", 14).add(rsi="CASE WHEN a + b = 0 THEN 0.0 ELSE 100 * a / (a + b) END")
    sma50 = "CASE WHEN bar >= 49 THEN (SELECT avg(x.close) FROM s0 x WHERE x.key = t.key AND x.bar BETWEEN t.bar - 49 AND t.bar) END"
    level = "(CASE WHEN rsi <= 30 THEN 1 WHEN rsi >= 70 THEN -1 ELSE 0 END)"
    ctes = lambda q: f"WITH RECURSIVE {', '.join(q.ctes)}"
    macd = Query(BARS).ema("f", "close", 12).ema("s", "close", 26).add(m="f - s").ema("sig", "m", 9, 25)
    from barloom.plans.recursive_sql import _family

    adx = _family(Query(BARS))
    band = "(SELECT {0} FROM s0 x WHERE x.key = t.key AND x.bar BETWEEN t.bar - 19 AND t.bar)"
    mid, dev = band.format("avg(x.close)"), band.format("stddev_pop(x.close)")
    revert = f"SELECT key, ts, CASE WHEN bar < 19 THEN NULL WHEN close <= m - 2 * d THEN 1.0 WHEN close >= m + 2 * d THEN -1.0 ELSE 0.0 END AS signal FROM (SELECT key, ts, bar, close, {mid} AS m, {dev} AS d FROM s0 t)"
    sqls = {
        "rsi_30_70": f"{ctes(rsi)} SELECT key, ts, {none.format('rsi', f'cast({level} AS DOUBLE)')} AS signal FROM {rsi.at}",
        "macd_crossover": f"{ctes(macd)} SELECT key, ts, {none.format('sig', 'CASE WHEN m > sig THEN 1.0 ELSE -1.0 END')} AS signal FROM {macd.at}",
        "adx_trend_follow": f"{ctes(adx)} SELECT key, ts, CASE WHEN adx IS NULL OR sma IS NULL THEN NULL WHEN adx > 25 AND close > sma THEN 1.0 ELSE -1.0 END AS signal FROM (SELECT t.*, {sma50} AS sma FROM {adx.at} t)",
        "bb_mean_revert": f"WITH s0 AS MATERIALIZED ({BARS}) {revert}",
        "rsi_sma_combo": f"{ctes(rsi)} SELECT key, ts, CASE WHEN rsi IS NULL OR sma IS NULL THEN NULL WHEN {level} = 1 AND close > sma THEN 1.0 WHEN {level} = -1 AND close <= sma THEN -1.0 ELSE 0.0 END AS signal FROM (SELECT t.*, {sma50} AS sma FROM {rsi.at} t)",
    }
    for name, sql in sqls.items():

        def signal(s, d, name=name):
            workers_import(s)
            return STRATEGIES[name](bars(s, d)).select("key", "ts", "signal")

        add(f"sig_{name}", signal, sql)

    base = _rules_base(BARS)
    shown = ["position", "fill_price", "bar_return", "strategy_return", "equity"]
    digits = dict.fromkeys(shown, 6) | {"equity": 4, "fill_price": 4}
    cols = [f"{fixed(c, digits[c])} AS {c}" for c in shown]

    def account(s, d, rules, weight=0.0025):
        made = s.sql(_rules_base("SELECT * FROM {b}", weight), b=bars(s, d))
        return run_account(made, rules, "limit_price")

    for name, rules, weight in (("bracket", RULES_BRACKET, 0.0025), ("full", RULES_FULL, 0.0025), ("at_close", replace(RULES_BRACKET, fill_mode="market_close", trailing_stop_pct=0.101237), 0.0002)):
        add(f"bt_account_{name}", lambda s, d, r=rules, w=weight: account(s, d, r, w).selectExpr("key", "ts", *cols), f"SELECT key, ts, {', '.join(cols)} FROM ({account_sql(_rules_base(BARS, weight), rules, 12)})")
    got = account_sql(base, RULES_BRACKET, 12)
    # Trades by their first rows, each joined with the first row after it on another side.
    trade_sql = f"""WITH a AS MATERIALIZED (SELECT g.*, b.bar, b.high, b.low, sign(g.position) AS side FROM ({got}) g JOIN ({BARS}) b USING (key, ts)), n AS (SELECT key, max(bar) AS last FROM a GROUP BY key),
 e AS (SELECT a.key, a.bar AS entry_bar, a.side AS direction, coalesce(CASE WHEN a.fill_price > 0 THEN a.fill_price END, a.high) AS entry_price FROM a LEFT JOIN a p ON p.key = a.key AND p.bar = a.bar - 1 WHERE a.side <> 0 AND coalesce(p.side, 0) <> a.side),
 x AS (SELECT e.*, n.last, (SELECT min(z.bar) FROM a z WHERE z.key = e.key AND z.bar > e.entry_bar AND z.side <> e.direction) AS turn FROM e JOIN n USING (key)),
 y AS (SELECT x.*, coalesce(turn, last) AS exit_bar, coalesce(CASE WHEN q.fill_price > 0 THEN q.fill_price END, CASE WHEN turn IS NULL THEN q.high ELSE q.low END) AS exit_price FROM x JOIN a q ON q.key = x.key AND q.bar = coalesce(turn, last)),
 m AS (SELECT y.key, y.entry_bar, max(greatest(direction * (a.high / entry_price - 1), direction * (a.low / entry_price - 1))) AS up, min(least(direction * (a.high / entry_price - 1), direction * (a.low / entry_price - 1))) AS down
 FROM y JOIN a ON a.key = y.key AND a.bar > y.entry_bar AND a.bar <= y.exit_bar GROUP BY ALL)
 SELECT key, entry_bar, exit_bar, cast(direction AS DOUBLE) AS direction, {fixed('entry_price')} AS entry_price, {fixed('exit_price')} AS exit_price, {fixed('direction * (exit_price / entry_price - 1)')} AS pnl_pct, exit_bar - entry_bar AS duration_bars,
 {fixed('least(0.0, coalesce(down, 0.0))')} AS mae, {fixed('greatest(0.0, coalesce(up, 0.0))')} AS mfe FROM y LEFT JOIN m USING (key, entry_bar)"""
    add("bt_trades", lambda s, d: trades(account(s, d, RULES_BRACKET)).selectExpr("key", "cast(entry_bar AS BIGINT) AS entry_bar", "cast(exit_bar AS BIGINT) AS exit_bar", "direction", *rounded(["entry_price", "exit_price", "pnl_pct"]), "cast(duration_bars AS BIGINT) AS duration_bars", *rounded(["mae", "mfe"])), trade_sql)

    limits = Constraints(0.005, 0.009, 0.003)
    weight = "CASE WHEN bar >= 19 THEN CASE WHEN close > 1500 THEN 0.007 ELSE -0.002 END ELSE 0.001 END"

    def many(s, d):
        return portfolio(bars(s, d).withColumn("weight", F.expr(weight).cast("double")), limits, 0.5).selectExpr("ts", f"{fixed('portfolio_return', 6)} AS portfolio_return", f"{fixed('portfolio_equity')} AS portfolio_equity")

    add("bt_portfolio", many, f"""WITH a AS (SELECT *, greatest(-0.005, least(0.005, {weight})) AS w0 FROM ({BARS})), b AS (SELECT *, w0 / greatest(1.0, sum(abs(w0)) OVER (PARTITION BY ts) / 0.009) AS w1 FROM a),
 c AS (SELECT *, sum(w1) OVER (PARTITION BY ts) AS net, count(*) OVER (PARTITION BY ts) AS n FROM b), d AS (SELECT *, w1 - CASE WHEN net > 0.003 THEN net - 0.003 WHEN net < -0.003 THEN net + 0.003 ELSE 0 END / n AS w2 FROM c),
 e AS (SELECT t.ts, coalesce(p.w2, 0) AS now, coalesce(q.w2, 0) AS old, p.close AS c0, t.close AS c1 FROM d t LEFT JOIN d p ON p.key = t.key AND p.bar = t.bar - 1 LEFT JOIN d q ON q.key = t.key AND q.bar = t.bar - 2),
 f AS (SELECT ts, sum(CASE WHEN c0 IS NULL THEN 0 ELSE now * (c1 / c0 - 1) - CASE WHEN abs(now - old) > 1e-12 THEN 0.00005 ELSE 0 END END) AS r, row_number() OVER (ORDER BY ts) AS i FROM e GROUP BY ts),
 g AS (SELECT ts, r, product(1 + r) OVER (ORDER BY ts) AS v FROM f) SELECT ts, {fixed('r', 6)} AS portfolio_return, {fixed('v')} AS portfolio_equity FROM g""")  # fmt: skip

    def searched(s, d):
        return walk_forward_search(bars(s, d), [(5, 20), (10, 30), (3, 10)], 250, 100)[0].selectExpr("key", "fold", "fast", "slow", f"{fixed('least(score, 1e6)')} AS score")

    mean = lambda p: f"(SELECT avg(x.close) FROM b x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar) AS m{p}"
    pick = lambda c: f"CASE {c} {' '.join(f'WHEN {p} THEN m{p}' for p in (3, 5, 10, 20, 30))} END"
    add("bt_walk_forward_search", searched, f"""WITH b AS MATERIALIZED (SELECT key, ts, bar, close FROM ({BARS})), m AS MATERIALIZED (SELECT t.*, {', '.join(mean(p) for p in (3, 5, 10, 20, 30))} FROM b t), g(param, fast, slow) AS (VALUES (0, 5, 20), (1, 10, 30), (2, 3, 10)),
 f AS (SELECT key, unnest(range(0, cast(floor((n - 350) / 100) AS BIGINT) + 1)) AS fold FROM (SELECT key, count(*) AS n FROM b GROUP BY key) WHERE n >= 350),
 s AS MATERIALIZED (SELECT m.key, fold, param, fast, slow, bar - 100 * fold AS at_, close, CASE WHEN bar - 100 * fold >= slow - 1 THEN CASE WHEN {pick('fast')} > {pick('slow')} THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS s FROM m JOIN f ON f.key = m.key AND bar >= 100 * fold AND bar < 100 * fold + 250, g),
 r AS (SELECT a.key, a.fold, a.param, a.fast, a.slow, coalesce(p.s * (a.close / p.close - 1), 0.0) AS r FROM s a LEFT JOIN s p ON p.key = a.key AND p.fold = a.fold AND p.param = a.param AND p.at_ = a.at_ - 1),
 k AS (SELECT key, fold, param, fast, slow, product(1 + r) AS g, sqrt(list_var_pop(list(r)) * 252) AS v, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT *, round(coalesce(CASE WHEN g > 0 THEN power(g, 252.0 / n) - 1 ELSE 0 END / nullif(v, 0), 0), 6) AS score FROM k),
 o AS (SELECT *, row_number() OVER (PARTITION BY key, fold ORDER BY score DESC, param) AS nth FROM c) SELECT key, fold, cast(fast AS INTEGER) AS fast, cast(slow AS INTEGER) AS slow, {fixed('least(score, 1e6)')} AS score FROM o WHERE nth = 1""")  # fmt: skip

    def bands(s, d):
        workers_import(s)
        from barloom.operators.backtest import signals

        plan = apply_stages(apply_stages(bars(s, d), [*signals(), *returns(5.0)]), EQUITY)
        return bootstrap_bands(plan.filter("bar < 200"), 40)[1].selectExpr("key", *[f"round({c}, 6) AS {c}" for c in ("var", "cvar", "prob_profit")])

    from barloom.operators.backtest import paths_sql, plan_sql

    paths = paths_sql(f"SELECT key, bar, strategy_return FROM ({plan_sql(BARS)}) WHERE bar < 200", 40, 42, 5)
    add("bt_bootstrap_risk", bands, f"""WITH RECURSIVE {paths}, e AS (SELECT key, e FROM paths WHERE pos = 199), q AS (SELECT key, quantile_cont(e, {1 - 0.95!r}) AS var FROM e GROUP BY key)
 SELECT key, round(any_value(var), 6) AS var, round(avg(e) FILTER (e <= var), 6) AS cvar, round(avg(CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END), 6) AS prob_profit FROM e JOIN q USING (key) GROUP BY key""")
