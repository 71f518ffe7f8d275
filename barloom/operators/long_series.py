"""Exponential and Wilder averages of series too long for one task, in SQL functions only.

y[i] = a * y[i-1] + b * x[i] is linear: over a chunk of a key it is a running sum of b * x * a**-k, scaled back by a**k, plus what the chunk
before left, which fades by a**k. A chunk is so long that what an end hands on fades below 1e-12 over it, so an end depends on two
chunks before it and no further within double precision. Chunks of one key are separate groups, whatever the number of keys; the table of
their ends, one row for each chunk, is joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.plans.staged import rounded


def chunk_size(a: float) -> int:
    return max(1, min(4096, int(math.log(1e-12) / math.log(a)))) if a > 0 else 1


def follow(bars: DataFrame, x: str, out: str, first: int, count: int, a: float, b: float) -> DataFrame:
    """bars with `out`: the mean of x over `count` bars from bar `first` at the last of them, then a * out + b * x; null before.

    x must not be null from `first` on.
    """
    if not 0 < a < 1:
        raise ValueError("a must lie between 0 and 1")
    start, size = first + count - 1, chunk_size(a)
    seed = bars.filter(F.col("bar").between(first, start)).groupBy("key").agg(F.avg(x).alias("_seed"), F.count(x).alias("_n")).filter(F.col("_n") == count).select("key", "_seed")
    at = F.col("bar") - (start + 1)
    rows = bars.withColumns({"_chunk": F.when(at >= 0, F.floor(at / size)), "_k": F.when(at >= 0, at % size + 1)})
    run = Window.partitionBy("key", "_chunk").orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    decay = F.pow(F.lit(a), F.col("_k"))
    rows = rows.withColumn("_local", F.when(F.col("_k").isNotNull(), F.sum(F.col(x) * (F.lit(b) / decay)).over(run) * decay))
    ends = rows.filter("_k IS NOT NULL").groupBy("key", "_chunk").agg(F.max_by("_local", "_k").alias("_end")).join(seed, "key")
    w = Window.partitionBy("key").orderBy("_chunk")
    fade = a**size

    def back(k: int) -> Column:
        """The end k chunks before; before the first one the seed, and nothing before that."""
        return F.coalesce(F.lag("_end", k).over(w), F.when(F.col("_chunk") == k - 1, F.col("_seed")).otherwise(0.0))

    carried = ends.withColumn("_carry", back(1) + fade * (back(2) + fade * back(3))).select("key", "_chunk", "_carry")
    made = rows.join(carried, ["key", "_chunk"], "left").join(seed, "key", "left")
    y = F.when(F.col("bar") == start, F.col("_seed")).when(F.col("_carry").isNotNull(), F.col("_local") + decay * F.col("_carry"))
    return made.withColumn(out, y).select(*bars.columns, out)


def ema(bars: DataFrame, p: int = 30, x: str = "close", out: str = "ema", first: int = 0) -> DataFrame:
    k = 2 / (p + 1)
    return follow(bars, x, out, first, p, 1 - k, k)


def wilder(bars: DataFrame, p: int, x: str, out: str, first: int = 1) -> DataFrame:
    return follow(bars, x, out, first, p, (p - 1) / p, 1 / p)


def _with_lags(bars: DataFrame, columns: list[str]) -> DataFrame:
    """The value a bar ago of each column, by a join on the next bar's number: no window over a whole key."""
    ago = bars.select("key", (F.col("bar") + 1).alias("bar"), *[F.col(c).alias(f"{c}_1") for c in columns])
    return bars.join(ago, ["key", "bar"], "left")


def rsi(bars: DataFrame, p: int = 14) -> DataFrame:
    moved = _with_lags(bars, ["close"]).withColumns({"_up": F.greatest(F.col("close") - F.col("close_1"), F.lit(0.0)), "_down": F.greatest(F.col("close_1") - F.col("close"), F.lit(0.0))})
    made = wilder(wilder(moved, p, "_up", "_g"), p, "_down", "_l")
    return made.withColumn("rsi", F.when(F.col("_g") + F.col("_l") == 0, 0.0).otherwise(100 * F.col("_g") / (F.col("_g") + F.col("_l")))).select(*bars.columns, "rsi")


def atr(bars: DataFrame, p: int = 14) -> DataFrame:
    moved = _with_lags(bars, ["close"]).withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("close_1")), F.abs(F.col("low") - F.col("close_1"))))
    return wilder(moved, p, "_tr", "atr").select(*bars.columns, "atr")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    both = ema(ema(bars, fast, out="_f"), slow, out="_s").withColumn("_line", F.col("_f") - F.col("_s"))
    made = ema(both, signal, "_line", "signal", slow - 1)
    return made.withColumns({"macd": F.when(F.col("signal").isNotNull(), F.col("_line")), "hist": F.col("_line") - F.col("signal")}).select(*bars.columns, "macd", "signal", "hist")


def register(add, src) -> None:
    from barloom.plans.recursive_sql import recursive_sql

    bars, sqls = src["bars"], recursive_sql(src["BARS"])
    for name, f, outs in (("EMA", ema, ["ema"]), ("RSI", rsi, ["rsi"]), ("ATR", atr, ["atr"]), ("MACD", macd, ["macd", "signal", "hist"])):
        add(f"long_{name.lower()}", lambda s, d, f=f, outs=outs: f(bars(s, d)).selectExpr("key", "ts", *rounded(outs)), sqls[name])
