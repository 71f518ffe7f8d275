"""Indicators on streams: the same recurrences as in batch, a state for each key, one output row for each input row.

Rows of a micro-batch are taken in the order of their time within a key; across micro-batches they have to arrive in that
order, as a bar feed does. State is the pickled stepper of the key and goes with the query's checkpoint.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.workers import workers_import

NAN = float("nan")


class Stepper:
    """Remembers what it was made with, so that it can start anew."""

    def __new__(cls, *args, **params):
        made = super().__new__(cls)
        made._made = (args, params)
        return made

    def reset(self) -> None:
        args, params = self._made
        self.__init__(*args, **params)


class SMA(Stepper):
    def __init__(self, p: int = 20):
        self.p, self.last = p, deque(maxlen=p)

    def step(self, x: float) -> float:
        self.last.append(x)
        return sum(self.last) / self.p if len(self.last) == self.p else NAN


class EMA(Stepper):
    def __init__(self, p: int = 20):
        self.p, self.k, self.n, self.total, self.now = p, 2 / (p + 1), 0, 0.0, NAN

    def step(self, x: float) -> float:
        self.n += 1
        if self.n <= self.p:
            self.total += x
            if self.n == self.p:
                self.now = self.total / self.p
        else:
            self.now += self.k * (x - self.now)
        return self.now


class Wilder(Stepper):
    def __init__(self, p: int):
        self.p, self.n, self.now = p, 0, 0.0

    def step(self, x: float) -> float:
        self.n += 1
        self.now = self.now + x / self.p if self.n <= self.p else (self.now * (self.p - 1) + x) / self.p
        return self.now if self.n >= self.p else NAN


class RSI(Stepper):
    def __init__(self, p: int = 14):
        self.before, self.up, self.down = None, Wilder(p), Wilder(p)

    def step(self, x: float) -> float:
        before, self.before = self.before, x
        if before is None:
            return NAN
        g, l = self.up.step(max(0.0, x - before)), self.down.step(max(0.0, before - x))
        return NAN if g != g else 0.0 if g + l == 0 else 100 * g / (g + l)


class ATR(Stepper):
    def __init__(self, p: int = 14):
        self.before, self.mean = None, Wilder(p)

    def step(self, h: float, l: float, c: float) -> float:
        before, self.before = self.before, c
        return NAN if before is None else self.mean.step(max(h - l, abs(h - before), abs(l - before)))


class VWAP(Stepper):
    def __init__(self):
        self.value, self.volume = 0.0, 0.0

    def step(self, h: float, l: float, c: float, v: float) -> float:
        self.value += (h + l + c) / 3 * v
        self.volume += v
        return self.value / self.volume if self.volume else NAN


class BBands(Stepper):
    def __init__(self, p: int = 20, up: float = 2.0, down: float = 2.0):
        self.p, self.up, self.down, self.last = p, up, down, deque(maxlen=p)

    def step(self, x: float) -> tuple[float, float, float]:
        self.last.append(x)
        if len(self.last) < self.p:
            return NAN, NAN, NAN
        m = sum(self.last) / self.p
        s = (sum((y - m) ** 2 for y in self.last) / self.p) ** 0.5
        return m + self.up * s, m, m - self.down * s


class MACD(Stepper):
    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        self.fast, self.slow, self.signal = EMA(fast), EMA(slow), EMA(signal)

    def step(self, x: float) -> tuple[float, float, float]:
        line = self.fast.step(x) - self.slow.step(x)
        sig = self.signal.step(line) if line == line else NAN
        return (NAN, NAN, NAN) if sig != sig else (line, sig, line - sig)


class Stoch(Stepper):
    def __init__(self, k: int = 5, slow: int = 3, d: int = 3):
        self.high, self.low, self.slow, self.d = deque(maxlen=k), deque(maxlen=k), SMA(slow), SMA(d)

    def step(self, h: float, l: float, c: float) -> tuple[float, float]:
        self.high.append(h)
        self.low.append(l)
        if len(self.high) < self.high.maxlen:
            return NAN, NAN
        top, bottom = max(self.high), min(self.low)
        slow = self.slow.step(0.0 if top == bottom else 100 * (c - bottom) / (top - bottom))
        d = self.d.step(slow) if slow == slow else NAN
        return (NAN, NAN) if d != d else (slow, d)


class SuperTrend(Stepper):
    def __init__(self, p: int = 7, m: float = 3.0):
        self.p, self.m, self.n, self.mean, self.before, self.up, self.down, self.way = p, m, 0, Wilder(p), None, NAN, NAN, -1

    def step(self, h: float, l: float, c: float) -> tuple[float, float]:
        tr = h - l if self.before is None else max(h - l, abs(h - self.before), abs(l - self.before))
        a, mid, before = self.mean.step(tr), (h + l) / 2, self.before
        self.before, self.n = c, self.n + 1
        if self.n < self.p:
            return NAN, 0.0
        u, d = mid + self.m * a, mid - self.m * a
        if self.n == self.p:
            self.up, self.down = u, d
            return NAN, 0.0
        self.up = u if u < self.up or before > self.up else self.up
        self.down = d if d > self.down or before < self.down else self.down
        self.way = (1 if c > self.up else -1) if self.way < 0 else (-1 if c < self.down else 1)
        return (self.down if self.way == 1 else self.up), float(self.way)


HLC = ("high", "low", "close")
# name: (stepper, inputs, outputs)
STEPPERS: dict[str, tuple[Callable, tuple[str, ...], tuple[str, ...]]] = {
    "SMA": (SMA, ("close",), ("sma",)), "EMA": (EMA, ("close",), ("ema",)), "RSI": (RSI, ("close",), ("rsi",)), "ATR": (ATR, HLC, ("atr",)), "BBANDS": (BBands, ("close",), ("upper", "middle", "lower")),
    "MACD": (MACD, ("close",), ("macd", "signal", "hist")), "STOCH": (Stoch, HLC, ("slowk", "slowd")), "VWAP": (VWAP, (*HLC, "volume"), ("vwap",)), "SUPERTREND": (SuperTrend, HLC, ("line", "direction")),
}


def run_steps(stepper, rows: pd.DataFrame, ins: tuple[str, ...]) -> list[tuple]:
    out = []
    for values in zip(*(rows[c] for c in ins), strict=True):
        got = stepper.step(*values)
        out.append(tuple(None if x != x else x for x in (got if isinstance(got, tuple) else (got,))))
    return out


def keyed_steps(bars: DataFrame, make: Callable, ins: tuple[str, ...], outs: tuple[str, ...], params: dict) -> DataFrame:
    """key, ts and what a stepper of each key gives for its rows, its state kept between micro-batches."""
    workers_import(bars.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stepper = pickle.loads(state.get[0]) if state.exists else make(**params)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        got = run_steps(stepper, rows, ins)
        state.update((pickle.dumps(stepper),))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), **{o: pd.Series([g[i] for g in got], dtype="float64") for i, o in enumerate(outs)}})

    schema = f"key string, ts timestamp, {', '.join(f'{o} double' for o in outs)}"
    return bars.groupBy("key").applyInPandasWithState(run, schema, "stepper binary", "append", GroupStateTimeout.NoTimeout)


def stream_indicator(bars: DataFrame, name: str, **params) -> DataFrame:
    """key, ts and the indicator's outputs for a stream (or a table) of bars."""
    make, ins, outs = STEPPERS[name]
    return keyed_steps(bars, make, ins, outs, params)


def stream_time_bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """OHLCV bars of event time from a stream of (key, ts, seq, price, size); rows later than `late` are dropped."""
    seq = F.struct("ts", "seq")
    got = ticks.withWatermark("ts", late).groupBy("key", F.window("ts", width)).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("size").alias("volume")
    )
    return got.select("key", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; a local one serves a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("streams need spark.checkpoint.dir, a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barloom-stream-')}"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream has to give now, through files in the shared folder."""
    spark, where = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def as_stream(table: DataFrame) -> DataFrame:
    """A table as a file stream."""
    spark, path = table.sparkSession, shared_folder(table.sparkSession)
    table.write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def register(add, src) -> None:
    HOURLY = src["HOURLY"]

    from barloom.plans.frames import CUM, W, fixed
    from barloom.plans.staged import rounded

    def live(s, d, name, outs):
        return run_available(stream_indicator(as_stream(src["hourly"](s, d)), name)).selectExpr("key", "ts", *rounded(list(outs)))

    numbered = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS bar FROM ({HOURLY})"
    full = lambda e, p: fixed(f"CASE WHEN bar >= {p - 1} THEN {e} END")
    sqls = {
        "SMA": f"SELECT key, ts, {full(f'avg(close) {W(20)}', 20)} AS sma FROM ({numbered})",
        "BBANDS": f"SELECT key, ts, {full(f'avg(close) {W(20)} + 2 * stddev_pop(close) {W(20)}', 20)} AS upper, {full(f'avg(close) {W(20)}', 20)} AS middle, {full(f'avg(close) {W(20)} - 2 * stddev_pop(close) {W(20)}', 20)} AS lower FROM ({numbered})",
        "VWAP": f"SELECT key, ts, {fixed(f'sum((high + low + close) / 3 * volume) {CUM} / sum(volume) {CUM}', 6)} AS vwap FROM ({HOURLY})",
    }
    from barloom.plans.recursive_sql import Query as RecursiveQuery
    from barloom.plans.recursive_sql import recursive_sql

    recursive = recursive_sql(numbered)
    sqls |= {k: recursive[k] for k in ("RSI", "ATR", "MACD", "SUPERTREND")}
    sqls["EMA"] = RecursiveQuery(numbered).ema("e", "close", 20).select(ema="e")
    frame = lambda e, p: f"(SELECT {e} FROM {{0}} x WHERE x.key = t.key AND x.bar BETWEEN t.bar - {p - 1} AND t.bar)"
    k = f"CASE WHEN bar >= 4 THEN CASE WHEN hi = lo THEN 0.0 ELSE 100 * (close - lo) / (hi - lo) END END"
    sqls["STOCH"] = f"""WITH n AS MATERIALIZED ({numbered}), a AS (SELECT *, {frame('max(x.high)', 5).format('n')} AS hi, {frame('min(x.low)', 5).format('n')} AS lo FROM n t), b AS MATERIALIZED (SELECT *, {k} AS k FROM a),
 c AS MATERIALIZED (SELECT *, CASE WHEN bar >= 6 THEN {frame('avg(x.k)', 3).format('b')} END AS s FROM b t), d AS (SELECT *, CASE WHEN bar >= 8 THEN {frame('avg(x.s)', 3).format('c')} END AS d FROM c t)
 SELECT key, ts, {fixed('CASE WHEN d IS NOT NULL THEN s END')} AS slowk, {fixed('d')} AS slowd FROM d"""
    for name, (_, _, outs) in STEPPERS.items():
        add(f"stream_{name.lower()}", lambda s, d, n=name, o=outs: live(s, d, n, o), sqls.get(name))

    ohlcv = ["open", "high", "low", "close", "volume"]

    def time_bars(s, d):
        # Bars of six hours, complete once the watermark has passed them.
        events = src["ticks"](s, d).select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "price", "size")
        return run_available(stream_time_bars(as_stream(events), "6 hours", "1 hour")).selectExpr("key", "ts", *rounded(ohlcv))

    six = "time_bucket(INTERVAL 6 HOURS, ts)"
    add("stream_time_bars", time_bars, f"""SELECT key, ts, {', '.join(rounded(ohlcv))} FROM (SELECT event_type AS key, {six} AS ts, arg_min(value, {{'t': ts, 'i': event_id}}) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, {{'t': ts, 'i': event_id}}) AS close, cast(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2) WHERE ts + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")  # fmt: skip
