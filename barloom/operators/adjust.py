"""Prices before splits and dividends put on the scale of today, and values of coarse bars brought to fine ones.

Bars and events are one ordered series for each key: an event's factor stands in its place, and the product of the factors that follow is
what a bar is adjusted by. One window, no join of bars with events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.plans.frames import fixed
from barloom.plans.staged import rounded
from barloom.sources.bars import resample

PRICES = ("open", "high", "low", "close")


def adjust_ohlcv(bars: DataFrame, splits: DataFrame | None = None, dividends: DataFrame | None = None) -> DataFrame:
    """bars with prices divided by later splits' ratios and scaled by later dividends, volume times the ratios.

    splits: key, ts, ratio (above 0); dividends: key, ts, amount. An event changes the bars before its time. A dividend's factor is
    (c - amount) / c with c the last close before it on the scale of the splits; dividends of one time add up; one that leaves no
    positive price, or has no bar before it, changes nothing.
    """
    none = F.lit(None).cast("double")
    names = [c for c in (*PRICES, "volume") if c in bars.columns]
    rows = bars.withColumns({"_kind": F.lit(1), "_ratio": none, "_amount": none})
    for table, column, value in ((splits, "_ratio", F.product("ratio")), (dividends, "_amount", F.sum("amount"))):
        if table is not None:
            events = table.groupBy("key", "ts").agg(value.cast("double").alias(column)).withColumn("_kind", F.lit(0))
            rows = rows.unionByName(events, allowMissingColumns=True)
    order = Window.partitionBy("key").orderBy("ts", "_kind")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    if splits is not None:
        rows = rows.withColumn("_ratio", F.when(F.col("_ratio") > 0, F.col("_ratio")).otherwise(F.when(F.col("_ratio").isNotNull(), F.raise_error(F.lit("a split's ratio must be above 0")).cast("double"))))
    rows = rows.withColumn("_split", F.exp(F.coalesce(F.sum(F.log("_ratio")).over(later), F.lit(0.0))))
    last = F.last(F.col("close") / F.col("_split"), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last).withColumn("_share", (F.col("_last") * F.lit(1.0) / F.coalesce("_ratio", F.lit(1.0)) - F.col("_amount")) / F.col("_last"))
    factor = F.when((F.col("_last") > 0) & (F.col("_share") > 0), F.col("_share"))
    rows = rows.withColumn("_factor", factor).withColumn("_paid", F.exp(F.coalesce(F.sum(F.log("_factor")).over(later), F.lit(0.0))))
    out = rows.filter("_kind = 1")
    scaled = {c: (F.col(c) * F.col("_split") if c == "volume" else F.col(c) / F.col("_split") * F.col("_paid")) for c in names}
    return out.withColumns(scaled).select(*bars.columns)


def adjust_for_splits(bars: DataFrame, splits: DataFrame) -> DataFrame:
    return adjust_ohlcv(bars, splits=splits)


def adjust_for_dividends(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    return adjust_ohlcv(bars, dividends=dividends)


def align_to_coarse(fine: DataFrame, coarse: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """fine (key, bar, ..) with the columns of the coarse bar (key, label) that a row lies in; rows past the last coarse bar get its values."""
    if factor < 1:
        raise ValueError(f"factor must be at least 1, not {factor}")
    last = coarse.groupBy("key").agg(F.max("label").alias("_last"))
    placed = fine.join(last, "key", "left").withColumn("label", F.least(F.floor(F.col("bar") / factor), F.col("_last")))
    return placed.join(coarse.select("key", "label", *columns), ["key", "label"], "left").drop("label", "_last")


def run_on_coarse(bars: DataFrame, factor: int, strategy, engine) -> DataFrame:
    """A strategy on bars of `factor` fine bars, its signals held over the fine bars, the engine's account on those.

    A coarse bar's signal is known at its end but stands for all of its fine bars, as the caller asked for.
    """
    coarse = resample(bars, factor).withColumn("bar", F.col("label")).withColumn("ts", F.timestamp_seconds(F.col("label")))
    signals = strategy(coarse).select("key", "label", "signal")
    aligned = align_to_coarse(bars, signals, factor, ["signal"])
    return engine.run(bars, strategy=lambda _: aligned)


def register(add, src) -> None:
    from barloom.operators.execution import Engine, sma_crossover
    from barloom.plans.account_sql import account_sql
    from barloom.workers import workers_import

    bars, BARS = src["bars"], src["BARS"]
    ohlcv = [*PRICES, "volume"]

    def adjusted(s, d):
        b = bars(s, d)
        splits = b.filter("bar in (200, 400)").select("key", "ts", F.lit(2.0).alias("ratio"))
        paid = b.filter("bar in (100, 300)").select("key", "ts", (F.col("bar") / 10.0).alias("amount"))
        return adjust_ohlcv(b, splits, paid).selectExpr("key", "ts", *rounded(ohlcv))

    ratio = "power(2.0, CASE WHEN b.bar < 200 THEN 1 ELSE 0 END + CASE WHEN b.bar < 400 THEN 1 ELSE 0 END)"
    share = lambda at, scale: f"CASE WHEN b.bar < {at} THEN (SELECT 1 - {at / 10} / (x.close / {scale}) FROM b x WHERE x.key = b.key AND x.bar = {at - 1}) ELSE 1 END"
    paid = f"coalesce({share(100, 4.0)}, 1) * coalesce({share(300, 2.0)}, 1)"
    cols = ", ".join(f"{fixed(f'{c} * {ratio}' if c == 'volume' else f'{c} / {ratio} * ({paid})')} AS {c}" for c in ohlcv)
    add("ana_adjust_ohlcv", adjusted, f"WITH b AS MATERIALIZED ({BARS}) SELECT key, ts, {cols} FROM b")
    add("ana_adjust_dividends", lambda s, d: adjust_for_dividends(bars(s, d), bars(s, d).filter("bar in (100, 300)").select("key", "ts", (F.col("bar") / 10.0).alias("amount"))).selectExpr("key", "ts", *rounded(["close"])),
        f"WITH b AS MATERIALIZED ({BARS}) SELECT key, ts, {fixed(f'close * coalesce({share(100, 1.0)}, 1) * coalesce({share(300, 1.0)}, 1)')} AS close FROM b")
    add("bars_align_to_coarse", lambda s, d: align_to_coarse(bars(s, d).select("key", "ts", "bar"), resample(bars(s, d), 7), 7, ["close"]).selectExpr("key", "ts", *rounded(["close"])),
        f"WITH b AS MATERIALIZED ({BARS}), n AS (SELECT key, count(*) // 7 AS n FROM b GROUP BY key) SELECT b.key, b.ts, {fixed('c.close')} AS close FROM b JOIN n USING (key) LEFT JOIN b c ON c.key = b.key AND c.bar = 7 * least(b.bar // 7, n.n - 1) + 6")

    def coarse(s, d):
        workers_import(s)
        engine = Engine().with_slippage(5.0).with_position_sizing("fixed_fractional", 0.002)
        return run_on_coarse(bars(s, d), 5, lambda b: sma_crossover(b, 3, 8), engine).selectExpr("key", "ts", f"{fixed('position')} AS position", f"{fixed('equity')} AS equity")

    whole = f"SELECT *, count(*) OVER (PARTITION BY key, bar // 5) AS k FROM ({BARS})"
    avg = "(SELECT avg(x.close) FROM c x WHERE x.key = c.key AND x.label > c.label - {0} AND x.label <= c.label)"
    signal = f"SELECT key, label, CASE WHEN label >= 7 THEN CASE WHEN {avg.format(3)} > {avg.format(8)} THEN 0.002 ELSE -0.002 END END AS signal FROM c"
    base = f"WITH a AS ({whole}), c AS MATERIALIZED (SELECT key, bar // 5 AS label, close FROM a WHERE k = 5 AND bar % 5 = 4), n AS (SELECT key, max(label) AS last FROM c GROUP BY key), g AS ({signal}) SELECT a.*, g.signal, cast(NULL AS DOUBLE) AS limit_price FROM a JOIN n USING (key) LEFT JOIN g ON g.key = a.key AND g.label = least(a.bar // 5, n.last)"
    from barloom.functions.account import Rules

    add("bt_multi_timeframe", coarse, f"SELECT key, ts, {fixed('position')} AS position, {fixed('equity')} AS equity FROM ({account_sql(base, Rules(slippage_bps=5.0), 12)})")
