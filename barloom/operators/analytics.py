"""Portfolio, cross-series, signal and attribution analytics: joins, windows and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.adjust import adjust_for_splits
from barloom.plans.frames import CUM, L, W, div, fixed, full, lag
from barloom.plans.staged import Stages, apply_stages, as_sql, outputs, rounded

RETURN = f"{div('close', lag('close'))} - 1"


def spread(hedge: float = 0.8) -> Stages:
    return [{"spread": f"real0 - {hedge} * real1", "ratio": div("real0", "real1")}]


def relative_strength() -> Stages:
    """Compounded returns of the first series over those of the second; levels give the same as the product of 1 + r."""
    return [{"_a": f"real0 / first_value(real0) {L}", "_b": f"real1 / first_value(real1) {L}"}, {"relative_strength": div("_a", "_b")}]


def rolling_beta(w: int = 20) -> Stages:
    rets = {"_x": f"{div('real0', lag('real0'))} - 1", "_y": f"{div('real1', lag('real1'))} - 1"}
    return [rets, {"_v": full("_x", w, f"var_pop(_x) {W(w)}"), "_c": full("_x", w, f"covar_pop(_x, _y) {W(w)}")}, {"rolling_beta": div("_c", "_v")}]


def compose_weighted() -> Stages:
    return [{"composed": "0.5 * real0 + 0.3 * real1"}]


def average_rank(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """1-based ranks within groups, ties averaged, as `rank`."""
    w, same = Window.partitionBy(*by).orderBy(column), Window.partitionBy(*by, column)
    return df.withColumn("rank", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def top_n(df: DataFrame, column: str, n: int, by: list[str], order: list[str], largest: bool = True) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(column) if largest else F.asc(column), *order)
    return df.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)


def screen(df: DataFrame, column: str, top_n: int | None = None, bottom_n: int | None = None, above: float | None = None, below: float | None = None, by: list[str] | None = None) -> DataFrame:
    """The rows of the highest or lowest values, or those beyond a level; all from the highest on if nothing is asked. Nulls are no scores."""
    scored = df.filter(F.col(column).isNotNull())
    if top_n is not None or bottom_n is not None:
        kept = top_n_of(scored, column, top_n if top_n is not None else bottom_n, by or [], top_n is not None)
        return kept
    if above is not None:
        return scored.filter(F.col(column) > above)
    if below is not None:
        return scored.filter(F.col(column) < below)
    return scored.orderBy(F.desc(column))


def top_n_of(df: DataFrame, column: str, n: int, by: list[str], largest: bool) -> DataFrame:
    order = F.desc(column) if largest else F.asc(column)
    if not by:
        return df.orderBy(order).limit(n)
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("nth_") <= n).drop("nth_")


def compose(df: DataFrame, signals: list[str], weights: list[float] | None = None, method: str = "weighted", by: list[str] | None = None) -> DataFrame:
    """df with composed: signals times weights, their mean, or the sum of their ranks within `by`."""
    if method == "rank":
        out = df
        for i, c in enumerate(signals):
            out = average_rank(out, c, by or ["key"]).withColumnRenamed("rank", f"rank_{i}")
        return out.withColumn("composed", sum((F.col(f"rank_{i}") for i in range(len(signals))), F.lit(0.0))).drop(*[f"rank_{i}" for i in range(len(signals))])
    if method not in ("weighted", "mean"):
        raise ValueError("method is weighted, mean or rank")
    w = weights if method == "weighted" and weights else [1 / len(signals)] * len(signals)
    if len(w) != len(signals):
        raise ValueError("there must be a weight for each signal")
    return df.withColumn("composed", sum((F.col(c) * v for c, v in zip(signals, w, strict=True)), F.lit(0.0)))


def attribution_by_month(df: DataFrame, returns: str = "ret", dated: bool = True) -> DataFrame:
    """key, month, contribution: by calendar months ('yyyy-MM'), or by stretches of 21 bars where times mean nothing."""
    month = F.date_format("ts", "yyyy-MM") if dated else F.floor(F.col("bar") / 21).cast("string")
    return df.groupBy("key", month.alias("month")).agg(F.sum(returns).alias("contribution"))


def islands(df: DataFrame, column: str) -> DataFrame:
    """run: the number of the run of equal values that a row belongs to."""
    w = Window.partitionBy("key").orderBy("ts")
    new = F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


POSITIONS: Stages = [
    {"_f": f"avg(close) {W(5)}", "_s": f"avg(close) {W(20)}"}, {"_g": "CASE WHEN bar < 19 THEN 0 WHEN _f > _s * 1.02 THEN 1 WHEN _f < _s * 0.98 THEN -1 ELSE 0 END"},
    {"position": f"coalesce(lag(_g) {L}, 0)", "_r": RETURN}, {"ret": "coalesce(position * _r, 0.0)"},
]
_NEW = f"CASE WHEN lag(position) {L} = position THEN 0 ELSE 1 END"


def _sql_positions(base: str) -> str:
    for s in POSITIONS:
        base = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in s.items())} FROM ({base})"
    return base


def positions(bars: DataFrame) -> DataFrame:
    return apply_stages(bars, POSITIONS)


def extract_trades(df: DataFrame) -> DataFrame:
    """A row for each run of equal positions other than 0: its return and its bars."""
    runs = islands(df, "position").filter("position <> 0")
    return runs.groupBy("key", "run").agg(F.min("ts").alias("entry"), F.max("ts").alias("exit"), F.first("position").alias("side"), F.sum("ret").alias("pnl"), F.count("*").alias("hold"))


def trade_stats(trades: DataFrame) -> DataFrame:
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    return trades.groupBy("key").agg(
        (F.count(win) / F.count("*")).alias("win_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.when(F.sum(loss) < 0, F.coalesce(F.sum(win), F.lit(0.0)) / -F.sum(loss)).alias("profit_factor"), F.avg("hold").alias("avg_hold"),
    )


def correlation_matrix(bars: DataFrame, column: str = "close") -> DataFrame:
    """key_i, key_j, corr for keys i <= j, over the times both have; null where one doesn't vary. n keys make n * n / 2 rows at each time, as many as the matrix has."""
    x = bars.select("ts", F.col("key").alias("key_i"), F.col(column).alias("x"))
    y = bars.select("ts", F.col("key").alias("key_j"), F.col(column).alias("y"))
    return x.join(y, "ts").filter("key_i <= key_j").groupBy("key_i", "key_j").agg(F.corr("x", "y").alias("corr"))


def portfolio_volatility(bars: DataFrame, weights: dict[str, float], periods: float = 252.0) -> DataFrame:
    """Annualized volatility of a fixed mix of keys from their returns' covariances: the variance of the mixed return."""
    w = Window.partitionBy("key").orderBy("ts")
    ret = bars.withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    mix = None
    for k, v in weights.items():
        mix = F.when(F.col("key") == k, F.lit(v)) if mix is None else mix.when(F.col("key") == k, F.lit(v))
    each = ret.withColumn("wr", mix * F.col("r")).filter("wr is not null").groupBy("ts").agg(F.sum("wr").alias("wr"), F.count("*").alias("n")).filter(F.col("n") == len(weights))
    return each.agg(F.sqrt(F.var_samp("wr") * periods).alias("portfolio_vol"))


def register(add, src) -> None:
    bars, pair, BARS, PAIR = src["bars"], src["pair"], src["BARS"], src["PAIR"]
    for name, stages in {"spread_ratio": spread(), "relative_strength": relative_strength(), "rolling_beta": rolling_beta(), "compose_weighted": compose_weighted()}.items():
        add(f"ana_{name}", lambda s, d, st=stages: apply_stages(pair(s, d), st).selectExpr("key", "ts", *rounded(outputs(st))), as_sql(PAIR, stages))
    rets = [{"_x": f"{div('real0', lag('real0'))} - 1", "_y": f"{div('real1', lag('real1'))} - 1"}]

    def beta_full(s, d):
        # The slope of the first series' returns on the second's.
        made = pair(s, d)
        for st in rets:
            made = made.selectExpr("*", *[f"{e} AS {c}" for c, e in st.items()])
        return made.selectExpr("round(regr_slope(_x, _y), 6) AS beta", "regr_count(_x, _y) AS n")

    add("ana_beta_full", beta_full, f"SELECT round((avg(x * y) - avg(x) * avg(y)) / (avg(y * y) - avg(y) * avg(y)), 6) AS beta, count(x) AS n FROM (SELECT a.real0 / b.real0 - 1 AS x, a.real1 / b.real1 - 1 AS y FROM ({PAIR}) a JOIN ({PAIR}) b ON a.key = b.key AND a.bar = b.bar + 1)")
    add("ana_rank", lambda s, d: average_rank(bars(s, d), "volume", ["key"]).selectExpr("key", "ts", "rank"),
        f"SELECT key, ts, rank() OVER (PARTITION BY key ORDER BY volume) + (count(*) OVER (PARTITION BY key, volume) - 1) / 2.0 AS rank FROM ({BARS})")
    add("ana_compose_rank", lambda s, d: average_rank(average_rank(bars(s, d), "volume", ["key"]).withColumnRenamed("rank", "a"), "close", ["key"]).selectExpr("key", "ts", "a + rank AS score"),
        f"SELECT key, ts, rank() OVER (PARTITION BY key ORDER BY volume) + (count(*) OVER (PARTITION BY key, volume) - 1) / 2.0 + rank() OVER (PARTITION BY key ORDER BY close) + (count(*) OVER (PARTITION BY key, close) - 1) / 2.0 AS score FROM ({BARS})")
    for side, big in (("top", True), ("bottom", False)):
        add(f"ana_{side}_n", lambda s, d, big=big: top_n(bars(s, d), "close", 10, ["key"], ["ts"], big).selectExpr("key", "ts", "nth", "round(close, 6) AS close"),
            f"SELECT key, ts, nth, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY close {'DESC' if big else 'ASC'}, ts) AS nth FROM ({BARS})) WHERE nth <= 10")
    add("ana_correlation_matrix", lambda s, d: correlation_matrix(bars(s, d)).selectExpr("key_i", "key_j", "round(corr, 6) AS corr"),
        f"SELECT a.key AS key_i, b.key AS key_j, round(corr(a.close, b.close), 6) AS corr FROM ({BARS}) a JOIN ({BARS}) b ON a.ts = b.ts AND a.key <= b.key GROUP BY 1, 2")
    add("ana_portfolio_volatility", lambda s, d: portfolio_volatility(bars(s, d), {"A": 0.5, "N": 0.3, "R": 0.2}).selectExpr("round(portfolio_vol, 6) AS portfolio_vol"),
        f"SELECT round(sqrt(var_samp(wr) * 252), 6) AS portfolio_vol FROM (SELECT ts, sum(w * r) AS wr FROM (SELECT ts, CASE key WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END AS w, close / lag(close) {L} - 1 AS r FROM ({BARS})) WHERE r IS NOT NULL GROUP BY ts HAVING count(*) = 3)")
    P = _sql_positions(BARS)
    runs = f"SELECT *, sum(_new) {CUM} AS run FROM (SELECT *, {_NEW} AS _new FROM ({P}))"
    trades = f"SELECT key, run, min(ts) AS entry, max(ts) AS exit, first(position) AS side, sum(ret) AS pnl, count(*) AS hold FROM ({runs}) WHERE position <> 0 GROUP BY key, run"
    add("ana_extract_trades", lambda s, d: extract_trades(positions(bars(s, d))).selectExpr("key", "entry", "exit", "side", "round(pnl, 6) AS pnl", "hold"), f"SELECT key, entry, exit, side, round(pnl, 6) AS pnl, hold FROM ({trades})")
    names = ["win_rate", "avg_win", "avg_loss", "profit_factor", "avg_hold"]
    add("ana_trade_stats", lambda s, d: trade_stats(extract_trades(positions(bars(s, d)))).selectExpr("key", *rounded(names)),
        f"SELECT key, {', '.join(rounded(names))} FROM (SELECT key, count(*) FILTER (pnl > 0) / count(*) AS win_rate, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS avg_loss, coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor, avg(hold) AS avg_hold FROM ({trades}) GROUP BY key)")
    scored = lambda s, d: bars(s, d).select("key", "ts", "close", "volume")
    add("ana_screen_above", lambda s, d: screen(scored(s, d), "close", above=1700.0).selectExpr("key", "ts", *rounded(["close"])), f"SELECT key, ts, {fixed('close')} AS close FROM ({BARS}) WHERE close > 1700")
    add("ana_screen_below", lambda s, d: screen(scored(s, d), "close", below=300.0).selectExpr("key", "ts", *rounded(["close"])), f"SELECT key, ts, {fixed('close')} AS close FROM ({BARS}) WHERE close < 300")
    add("ana_compose_mean", lambda s, d: compose(scored(s, d), ["close", "volume"], method="mean").selectExpr("key", "ts", *rounded(["composed"])), f"SELECT key, ts, {fixed('close / 2 + volume / 2')} AS composed FROM ({BARS})")
    add("ana_month_buckets", lambda s, d: attribution_by_month(positions(bars(s, d)), dated=False).selectExpr("key", "month", "round(contribution, 6) AS contribution"),
        f"SELECT key, cast(bar // 21 AS VARCHAR) AS month, round(sum(ret), 6) AS contribution FROM ({_sql_positions(BARS)}) GROUP BY 1, 2")
    add("ana_monthly_contribution", lambda s, d: positions(bars(s, d)).groupBy("key", F.date_trunc("month", "ts").alias("month")).agg(F.round(F.sum("ret"), 6).alias("contribution")),
        f"SELECT key, date_trunc('month', ts) AS month, round(sum(ret), 6) AS contribution FROM ({P}) GROUP BY 1, 2")
    add("ana_signal_attribution", lambda s, d: positions(bars(s, d)).groupBy("key", "position").agg(F.round(F.sum("ret"), 6).alias("contribution")), f"SELECT key, position, round(sum(ret), 6) AS contribution FROM ({P}) GROUP BY 1, 2")
    splits = "SELECT key, ts, 2.0 AS ratio FROM ({0}) WHERE bar IN (200, 400)"
    add("ana_adjust_splits", lambda s, d: adjust_for_splits(bars(s, d), bars(s, d).filter("bar in (200, 400)").select("key", "ts", F.lit(2.0).alias("ratio"))).withColumnRenamed("close", "adjusted").selectExpr("key", "ts", *rounded(["adjusted"])),
        f"SELECT b.key, b.ts, {fixed('b.close / coalesce(product(s.ratio), 1.0)')} AS adjusted FROM ({BARS}) b LEFT JOIN ({splits.format(BARS)}) s ON b.key = s.key AND b.ts < s.ts GROUP BY b.key, b.ts, b.close")
