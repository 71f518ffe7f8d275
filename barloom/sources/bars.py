"""Bars from ticks and from bars: by time, by count, by volume.

Time and tick bars are aggregations with partial results before the shuffle. Volume bars restart from zero at each bar's end,
so their numbers depend on the whole path: one pass over each key gives them, and the rest is an aggregation.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from barloom.errors import ParameterError
from barloom.functions.kernels import volume_bar_ids


def _ohlcv(seq: Column) -> list[Column]:
    return [
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", seq).alias("close"), F.sum("size").alias("volume"),
    ]


def time_bars(ticks: DataFrame, bucket: Column, seq: Column) -> DataFrame:
    """key, ts, open, high, low, close, volume: ticks (key, price, size) by a time bucket, in the order of seq."""
    return ticks.groupBy("key", bucket.alias("ts")).agg(*_ohlcv(seq))


def tick_bars(ticks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Every n ticks one bar; the last may be short."""
    at = F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1
    return ticks.withColumn("_at", at).groupBy("key", F.floor(F.col("_at") / n).alias("label")).agg(*_ohlcv(F.col("_at")))


def _with_ids(rows: DataFrame, size: str, limit: float, order: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.assign(label=volume_bar_ids(pdf[size].to_numpy(dtype=float), limit), _at=range(len(pdf)))

    schema = StructType([*rows.schema.fields, StructField("label", LongType()), StructField("_at", LongType())])
    return rows.groupBy("key").applyInPandas(run, schema)


def volume_bars_from_ticks(ticks: DataFrame, limit: float, order: list[str]) -> DataFrame:
    return _with_ids(ticks, "size", limit, order).groupBy("key", "label").agg(*_ohlcv(F.col("_at")))


def merge_bars(bars: DataFrame, label: Column, seq: Column) -> DataFrame:
    """Bars of one key and label become one."""
    return bars.groupBy("key", label.alias("label")).agg(
        F.min_by("open", seq).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", seq).alias("close"), F.sum("volume").alias("volume")
    )


def volume_bars(bars: DataFrame, limit: float) -> DataFrame:
    return merge_bars(_with_ids(bars, "volume", limit, ["ts"]), F.col("label"), F.col("_at"))


def resample(bars: DataFrame, factor: int, keep_tail: bool = False) -> DataFrame:
    """Every `factor` bars one; an incomplete last one goes unless keep_tail."""
    out = merge_bars(bars.withColumn("_n", F.lit(1)), F.floor(F.col("bar") / factor), F.col("bar"))
    if keep_tail:
        return out
    count = bars.groupBy("key", F.floor(F.col("bar") / factor).alias("label")).agg(F.count("*").alias("n")).filter(F.col("n") == factor).select("key", "label")
    return out.join(count, ["key", "label"])


def numbered(bars: DataFrame) -> DataFrame:
    """bar: 0, 1, .. within a key by ts."""
    return bars.withColumn("bar", F.row_number().over(Window.partitionBy("key").orderBy("ts")) - 1)


UNITS = {"s": "seconds", "sec": "seconds", "second": "seconds", "min": "minutes", "minute": "minutes", "t": "minutes", "h": "hours", "hour": "hours", "d": "days", "day": "days", "w": "weeks", "week": "weeks"}


def interval(rule: str) -> str:
    """'5min', '1h', '2 days' as an interval."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", rule)
    unit = m and (UNITS.get(m[2].lower()) or UNITS.get(f"{m[2]}s".lower()))
    if not unit or m[1] == "0":
        raise ParameterError(f"not a rule of time: {rule!r}", "as in 5min, 1h, 1d")
    return f"{m[1] or 1} {unit}"


def resample_time(bars: DataFrame, rule: str, label: str = "right", closed: str = "right") -> DataFrame:
    """Bars of a longer time; `closed` says which end of a span belongs to it, `label` which one names it. Spans without bars have none."""
    if {label, closed} - {"left", "right"}:
        raise ParameterError("label and closed are left or right")
    # Spark's spans hold their left end: a microsecond less puts a bar on a right end into the span before.
    at = F.col("ts").cast("timestamp") if closed == "left" else F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    span = F.window(at, interval(rule))
    out = merge_bars(bars, span, F.col("ts"))
    return out.select("key", F.col(f"label.{'end' if label == 'right' else 'start'}").alias("ts"), "open", "high", "low", "close", "volume")


def multi_timeframe(bars: DataFrame, rules: list[str], indicator=None) -> dict[str, DataFrame]:
    """Bars of each rule, numbered, with what `indicator` adds to them."""
    made = {r: numbered(resample_time(bars, r)) for r in rules}
    return {r: indicator(b) if indicator else b for r, b in made.items()}


def parse_tick_rule(rule: str) -> tuple[str, float]:
    """'time:60' (seconds), 'volume:1000' or 'tick:100' as (kind, number)."""
    kind, colon, number = rule.partition(":")
    kind = kind.strip().lower()
    if not colon or kind not in ("time", "volume", "tick"):
        raise ParameterError(f"not a rule: {rule!r}", "as in time:60, volume:1000, tick:100")
    try:
        n = float(number)
    except ValueError:
        n = 0.0
    if not n > 0 or n == float("inf"):
        raise ParameterError(f"the number in {rule!r} must be above 0")
    return kind, n


def aggregate_ticks(ticks: DataFrame, rule: str = "tick:100", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Bars of ticks (key, ts, price, size) by a rule: key, label, open, high, low, close, volume; order settles ticks of one time."""
    kind, n = parse_tick_rule(rule)
    if kind == "tick":
        return tick_bars(ticks, int(n), list(order))
    if kind == "volume":
        return volume_bars_from_ticks(ticks, n, list(order))
    bucket = F.floor(F.col("ts").cast("timestamp").cast("double") / n).cast("long")
    return time_bars(ticks, bucket, F.struct(*order)).withColumnRenamed("ts", "label")


class TickAggregator:
    def __init__(self, rule: str = "tick:100"):
        parse_tick_rule(rule)
        self.rule = rule

    def aggregate(self, ticks: DataFrame, **options) -> DataFrame:
        return aggregate_ticks(ticks, self.rule, **options)
