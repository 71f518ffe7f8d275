"""One query for each operator on the driver's tables, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom import alerts, pipeline
from barloom.functions import derivatives, option_strategies
from barloom.functions.currency import CURRENCIES
from barloom.operators import adjust, analytics, backtest, execution, features, long_series, optimize, patterns, regimes, series_pairs, strategy_language
from barloom.operators.recurrences import RECURRENCES, apply_recurrences
from barloom.operators.window_indicators import INDICATORS
from barloom.plans.frames import fixed
from barloom.plans.recursive_sql import recursive_sql
from barloom.plans.staged import apply_stages, as_sql, outputs, rounded
from barloom.plans.window_sql import window_sql
from barloom.sources import bars as B
from barloom.streaming import indicators as streaming_indicators
from barloom.streaming import trading as streaming_trading
from barloom.workers import workers_import

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
DAILY = f"""SELECT l_returnflag AS key, l_shipdate AS ts, first(l_extendedprice / l_quantity ORDER BY {ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
 min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {ORDER}) AS close, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2"""
BARS = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS bar FROM ({DAILY})"
# Two series side by side: flag N's bars as real0, flag R's as real1; periods for MAVP.
PAIR = "SELECT a.key, a.ts, a.bar, a.close AS real0, b.close AS real1 FROM ({0}) a JOIN ({0}) b ON a.ts = b.ts AND a.key = 'N' AND b.key = 'R'"
PAIR = f"SELECT key, ts, real0, real1, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS bar FROM ({PAIR.format(BARS)})"
HOURLY = """SELECT event_type AS key, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
 cast(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    line = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity > 0")
    ticks = line.select(F.col("l_returnflag").alias("key"), "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), *ORDER.split(", "))
    return B.time_bars(ticks, F.col("l_shipdate"), F.struct(*ORDER.split(", ")))


def bars(spark: SparkSession, d: str) -> DataFrame:
    return B.numbered(daily(spark, d))


def pair(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    x = b.filter("key = 'N'").select("key", "ts", F.col("close").alias("real0"))
    y = b.filter("key = 'R'").select("ts", F.col("close").alias("real1"))
    return B.numbered(x.join(y, "ts").select("key", "ts", "real0", "real1"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("key"), "ts", "event_id", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return B.time_bars(ticks(spark, d), F.date_trunc("hour", "ts"), F.struct("ts", "event_id"))


def _base(name: str) -> tuple[Query, str]:
    if name in ("BETA", "CORREL"):
        return pair, PAIR
    if name == "MAVP":
        return (lambda s, d: bars(s, d).withColumn("periods", (F.col("bar") % 40).cast("double"))), f"SELECT *, cast(bar % 40 AS DOUBLE) AS periods FROM ({BARS})"
    return bars, BARS


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


for _name, _stages in INDICATORS.items():
    _table, _sql = _base(_name)
    _add(f"ind_{_name.lower()}", lambda s, d, t=_table, st=_stages: apply_stages(t(s, d), st).selectExpr("key", "ts", *rounded(outputs(st))), window_sql(_name, _sql))

_names = list(patterns.RULES)
for _i in range(0, len(_names), 16):
    _stages = patterns.stages(_names[_i : _i + 16])
    _add(f"patterns_{_i // 16 + 1}", lambda s, d, st=_stages: apply_stages(bars(s, d), st).selectExpr("key", "ts", *rounded(outputs(st))), as_sql(BARS, _stages))

_recursive = recursive_sql(BARS)
for _name, (_ins, _, _outs) in RECURRENCES.items():

    def _run(s, d, name=_name, ins=_ins, outs=_outs):
        workers_import(s)
        return apply_recurrences(bars(s, d).select("key", "ts", *ins), [(name, {})]).selectExpr("key", "ts", *rounded(list(outs)))

    _add(f"ind_{_name.lower()}", _run, _recursive.get(_name))

_band = INDICATORS["BBANDS"]
_flag = [{"sma20": "CASE WHEN count(close) {w} = 20 THEN avg(close) {w} END", "std20": "CASE WHEN count(close) {w} = 20 THEN stddev_pop(close) {w} END"}]
_w = "OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_flag = [{k: v.format(w=_w) for k, v in _flag[0].items()}, *_band]
_add("flagship_daily_bands", lambda s, d: apply_stages(bars(s, d), _flag).selectExpr("key", "ts", *rounded(outputs(_flag))), as_sql(BARS, _flag))

# Bars
_ohlcv = ["open", "high", "low", "close", "volume"]
_r = ", ".join(rounded(_ohlcv))
_add("bars_time", lambda s, d: hourly(s, d).selectExpr("key", "ts", *rounded(_ohlcv)), f"SELECT key, ts, {_r} FROM ({HOURLY})")


def _merged(seq: str, of: tuple[str, ...] = ("open", "high", "low", "close", "volume")) -> str:
    """The columns of bars that an aggregation in the order of seq makes."""
    o, h, l, c, v = of
    made = {"open": f"first({o} ORDER BY {seq})", "high": f"max({h})", "low": f"min({l})", "close": f"last({c} ORDER BY {seq})", "volume": f"sum({v})"}
    return ", ".join(f"{fixed(e)} AS {k}" for k, e in made.items())


_TICK = "SELECT event_type AS key, ts, event_id, value AS price, 1.0 AS size, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events"
_add("bars_tick", lambda s, d: B.tick_bars(ticks(s, d), 50, ["ts", "event_id"]).selectExpr("key", "label", *rounded(_ohlcv)),
     f"SELECT key, cast(floor(idx / 50) AS BIGINT) AS label, {_merged('idx', ('price',) * 4 + ('size',))} FROM ({_TICK}) GROUP BY 1, 2")


def _volume(s, d):
    workers_import(s)
    return B.volume_bars(bars(s, d).select("key", "ts", *_ohlcv), 2000.0).selectExpr("key", "label", *rounded(_ohlcv))


_LABELS = f"""WITH RECURSIVE b AS MATERIALIZED ({BARS}), r(key, bar, label, total) AS (SELECT key, bar, 0, volume FROM b WHERE bar = 0 UNION ALL
 SELECT b.key, b.bar, CASE WHEN r.total >= 2000 THEN r.label + 1 ELSE r.label END, CASE WHEN r.total >= 2000 THEN b.volume ELSE r.total + b.volume END FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1)
 SELECT key, cast(label AS BIGINT) AS label, {_merged('bar')}
 FROM r JOIN b USING (key, bar) GROUP BY 1, 2"""
_add("bars_volume", _volume, _LABELS)
_add("bars_resample", lambda s, d: B.resample(bars(s, d), 5).selectExpr("key", "label", *rounded(_ohlcv)),
     f"SELECT key, cast(floor(bar / 5) AS BIGINT) AS label, {_merged('bar')} FROM ({BARS}) GROUP BY 1, 2 HAVING count(*) = 5")



def _right_closed(s, d):
    return B.resample_time(hourly(s, d), "6h").selectExpr("key", "ts", *rounded(_ohlcv))


_SIX = "time_bucket(INTERVAL 6 HOURS, ts - INTERVAL 1 MICROSECOND) + INTERVAL 6 HOURS"
_add("bars_resample_time", _right_closed, f"SELECT key, {_SIX} AS ts, {fixed('arg_min(open, ts)')} AS open, {fixed('max(high)')} AS high, {fixed('min(low)')} AS low, {fixed('arg_max(close, ts)')} AS close, {fixed('sum(volume)')} AS volume FROM ({HOURLY}) GROUP BY 1, 2")


def _by_rule(s, d):
    return B.aggregate_ticks(ticks(s, d), "time:7200", ("ts", "event_id")).selectExpr("key", "label", *rounded(_ohlcv))


_add("bars_by_rule", _by_rule, f"SELECT event_type AS key, cast(floor(epoch(ts) / 7200) AS BIGINT) AS label, {_merged('ts', ('value', 'value', 'value', 'value', '1.0'))} FROM events GROUP BY 1, 2")


def _volume_ticks(s, d):
    workers_import(s)
    return B.aggregate_ticks(ticks(s, d).withColumn("size", F.pmod("event_id", F.lit(7)) + 1.0), "volume:250", ("ts", "event_id")).selectExpr("key", "label", *rounded(_ohlcv))


_SIZED = "SELECT event_type AS key, value AS price, event_id % 7 + 1.0 AS size, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS bar FROM events"
_add("bars_volume_ticks", _volume_ticks, f"""WITH RECURSIVE b AS MATERIALIZED ({_SIZED}), r(key, bar, label, total) AS (SELECT key, bar, 0, size FROM b WHERE bar = 0 UNION ALL
 SELECT b.key, b.bar, CASE WHEN r.total >= 250 THEN r.label + 1 ELSE r.label END, CASE WHEN r.total >= 250 THEN b.size ELSE r.total + b.size END FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1)
 SELECT key, cast(label AS BIGINT) AS label, {_merged('bar', ('price', 'price', 'price', 'price', 'size'))} FROM r JOIN b USING (key, bar) GROUP BY 1, 2""")  # fmt: skip


def _money(s, d):
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", ((F.col("p_retailprice") - 1000) * F.pow(F.lit(10.0), F.col("p_partkey") % 5)).alias("amount"))
    return part.select("p_partkey", *[CURRENCIES[c].column(F.col("amount")).alias(c.lower()) for c in ("USD", "JPY", "INR")])


_AMOUNT = "SELECT p_partkey, (p_retailprice - 1000) * power(10.0, p_partkey % 5) AS amount FROM part"
_WHOLE = "split_part(printf('%.2f', abs(amount)), '.', 1)"
_PAISE = "split_part(printf('%.2f', abs(amount)), '.', 2)"
_SIGN = "CASE WHEN amount < 0 THEN '-' ELSE '' END"
_LAKH = f"regexp_replace(reverse(regexp_replace(reverse(left({_WHOLE}, greatest(0, length({_WHOLE}) - 3))), '(..)', '\\1,', 'g')), '^,', '')"
_add("fmt_currency", _money, f"""SELECT p_partkey, {_SIGN} || '$' || format('{{:,}}', cast({_WHOLE} AS BIGINT)) || '.' || {_PAISE} AS usd, {_SIGN} || '¥' || format('{{:,}}', cast(round(abs(amount)) AS BIGINT)) AS jpy,
 {_SIGN} || '₹' || CASE WHEN length({_WHOLE}) > 3 THEN {_LAKH} || ',' ELSE '' END || right({_WHOLE}, 3) || '.' || {_PAISE} AS inr FROM ({_AMOUNT})""")  # fmt: skip

for _module in (derivatives, option_strategies, features, long_series, strategy_language, optimize, alerts, pipeline, analytics, adjust, backtest, execution, regimes, series_pairs, streaming_indicators, streaming_trading):
    _module.register(_add, {"bars": bars, "pair": pair, "hourly": hourly, "ticks": ticks, "BARS": BARS, "PAIR": PAIR, "HOURLY": HOURLY})
