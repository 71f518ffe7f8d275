"""Market regimes as labels on bars, and signals held to allowed ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.recurrences import apply_recurrences
from barloom.operators.window_indicators import variance_break
from barloom.plans.frames import W, fixed, full, lag
from barloom.plans.recursive_sql import TR, Query, _family, cusum_sql
from barloom.plans.staged import apply_stages


def regime(bars: DataFrame, method: str = "adx", adx_threshold: float = 25.0, atr_pct_threshold: float = 0.005, adx_timeperiod: int = 14, atr_timeperiod: int = 14) -> DataFrame:
    """bars with regime: 1 in a trend, 0 in a range, -1 in the warm-up. `combined` asks for a true range of some size too."""
    if method not in ("adx", "combined"):
        raise ValueError("method is adx or combined")
    both = apply_recurrences(bars, [("ADX", {"p": adx_timeperiod}), ("ATR", {"p": atr_timeperiod})])
    trend = F.col("adx") > adx_threshold
    missing = F.col("adx").isNull()
    if method == "combined":
        trend = trend & (F.col("atr") / F.when(F.col("close") != 0, F.col("close")) > atr_pct_threshold)
        missing = missing | F.col("atr").isNull() | F.coalesce(F.col("close") == 0, F.lit(True))
    return both.withColumn("regime", F.when(missing, -1).when(trend, 1).otherwise(0)).drop("adx", "atr")


def volatility_regime(bars: DataFrame, window: int = 20, n_regimes: int = 3) -> DataFrame:
    """bars with vol_regime: the bucket of the log returns' deviation among equal shares of the key's own, -1 in the warm-up.

    The boundaries are one small row for each key, joined back.
    """
    stages = [{"_r0": f"ln(close / nullif({lag('close')}, 0))"}, {"vol_": full("_r0", window, f"stddev_pop(_r0) {W(window)}")}]
    made = apply_stages(bars, stages)
    if n_regimes < 2:
        return made.withColumn("vol_regime", F.when(F.col("vol_").isNull(), -1).otherwise(0)).drop("vol_")
    ends = made.groupBy("key").agg(F.percentile("vol_", F.array(*[F.lit(k / n_regimes) for k in range(1, n_regimes)])).alias("ends_"))
    bucket = F.size(F.filter("ends_", lambda e: e <= F.col("vol_")))
    return made.join(ends, "key").withColumn("vol_regime", F.when(F.col("vol_").isNull(), -1).otherwise(bucket)).drop("vol_", "ends_")


def trend_regime(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """bars with trend_regime: 1 while the fast average is above the slow one, -1 below, 0 in the warm-up and where they are equal."""
    stages = [{"_f": full("close", fast, f"avg(close) {W(fast)}"), "_s": full("close", slow, f"avg(close) {W(slow)}")}, {"trend_regime": "coalesce(cast(sign(_f - _s) AS INT), 0)"}]
    return apply_stages(bars, stages)


def combined_regime(bars: DataFrame, vol_window: int = 20, fast: int = 50, slow: int = 200) -> DataFrame:
    """bars with regime: 0 to 2 by volatility in a rising trend, 3 to 5 in a falling one, else -1."""
    both = volatility_regime(trend_regime(bars, fast, slow), vol_window)
    v = F.col("vol_regime")
    label = F.when(v < 0, -1).when(F.col("trend_regime") > 0, v).when(F.col("trend_regime") < 0, v + 3).otherwise(-1)
    return both.withColumn("regime", label).drop("vol_regime", "trend_regime")


@dataclass(frozen=True)
class RegimeFilter:
    allowed: tuple[int, ...]
    vol_window: int = 20
    fast: int = 50
    slow: int = 200

    def filter(self, bars: DataFrame) -> DataFrame:
        """bars (with signal) whose signal is 0 outside the allowed regimes."""
        made = combined_regime(bars, self.vol_window, self.fast, self.slow)
        return made.withColumn("signal", F.when(F.col("regime").isin(*self.allowed), F.col("signal")).otherwise(0.0)).drop("regime")


def structural_breaks(bars: DataFrame, method: str = "cusum", window: int = 20, threshold: float = 3.0, slack: float = 0.5, short_window: int = 10, long_window: int = 50, variance_threshold: float = 2.0) -> DataFrame:
    """bars with break: 1 where the series leaves its past level (cusum) or variance."""
    if method == "cusum":
        return apply_recurrences(bars, [("CUSUM_BREAKS", {"w": window, "limit": threshold, "slack": slack})])
    if method == "variance":
        return apply_stages(bars, variance_break(short_window, long_window, variance_threshold)).withColumnRenamed("variance_break", "break")
    raise ValueError("method is cusum or variance")


def register(add, src) -> None:
    from barloom.workers import workers_import

    bars, BARS = src["bars"], src["BARS"]
    both = _family(Query(BARS)).wilder("atr", "tr", 14)

    def combined(s, d):
        workers_import(s)
        return regime(bars(s, d), "combined", 20.0, 0.2).select("key", "ts", F.col("regime").cast("long"))

    add("ind_regime_combined", combined, f"WITH RECURSIVE {', '.join(both.ctes)} SELECT key, ts, cast(CASE WHEN adx IS NULL OR atr IS NULL THEN -1 WHEN adx > 20 AND atr / close > 0.2 THEN 1 ELSE 0 END AS BIGINT) AS regime FROM {both.at}")
    frame = "(SELECT {0} FROM b x WHERE x.key = b.key AND x.bar > b.bar - {1} AND x.bar <= b.bar)"
    vols = f"WITH b0 AS ({BARS}), b AS MATERIALIZED (SELECT key, ts, bar, close, ln(close / lag(close) OVER (PARTITION BY key ORDER BY bar)) AS r FROM b0), v AS MATERIALIZED (SELECT *, CASE WHEN bar >= 20 THEN {frame.format('stddev_pop(x.r)', 20)} END AS vol FROM b), e AS (SELECT key, quantile_cont(vol, 1 / 3) AS lo, quantile_cont(vol, 2 / 3) AS hi FROM v GROUP BY key)"
    bucket = "CASE WHEN vol IS NULL THEN -1 ELSE CASE WHEN lo <= vol THEN 1 ELSE 0 END + CASE WHEN hi <= vol THEN 1 ELSE 0 END END"
    add("ind_volatility_regime", lambda s, d: volatility_regime(bars(s, d)).select("key", "ts", F.col("vol_regime").cast("long")), f"{vols} SELECT key, ts, cast({bucket} AS BIGINT) AS vol_regime FROM v JOIN e USING (key)")
    trend = f"CASE WHEN bar < 199 THEN 0 ELSE sign({frame.format('avg(x.close)', 50)} - {frame.format('avg(x.close)', 200)}) END"
    add("ind_trend_regime", lambda s, d: trend_regime(bars(s, d)).select("key", "ts", F.col("trend_regime").cast("long")), f"WITH b AS MATERIALIZED ({BARS}) SELECT key, ts, cast({trend} AS BIGINT) AS trend_regime FROM b")
    label = f"CASE WHEN t = 0 OR {bucket} < 0 THEN -1 WHEN t > 0 THEN {bucket} ELSE 3 + {bucket} END"
    add("ind_combined_regime", lambda s, d: combined_regime(bars(s, d)).select("key", "ts", F.col("regime").cast("long")), f"{vols}, w AS (SELECT key, ts, {trend} AS t FROM b) SELECT key, ts, cast({label} AS BIGINT) AS regime FROM v JOIN e USING (key) JOIN w USING (key, ts)")
    held = RegimeFilter((0, 1, 3), 20, 50, 200)
    add("sig_regime_filter", lambda s, d: held.filter(bars(s, d).withColumn("signal", F.when(F.col("close") > F.col("open"), 1.0).otherwise(-1.0))).select("key", "ts", "signal"),
        f"{vols}, w AS (SELECT key, ts, {trend} AS t FROM b) SELECT key, ts, CASE WHEN {label} IN (0, 1, 3) THEN CASE WHEN b0.close > b0.open THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS signal FROM v JOIN e USING (key) JOIN w USING (key, ts) JOIN b0 USING (key, ts)")

    def breaks(s, d):
        workers_import(s)
        return structural_breaks(bars(s, d), "cusum", 10, 4.0, 0.25).selectExpr("key", "ts", f"{fixed('break')} AS break")

    add("ind_structural_breaks", breaks, cusum_sql(BARS, 10, 4.0, 0.25))
