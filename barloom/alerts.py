"""Alerts on series: conditions become one plan, whose rows are the events; live ones go out from a stream's micro-batches."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.errors import ParameterError
from barloom.plans.frames import fixed


@dataclass(frozen=True)
class AlertEvent:
    condition_id: str
    key: str
    bar: int
    value: float
    direction: int
    payload: dict = field(default_factory=dict)


@dataclass(frozen=True)
class _Condition:
    condition_id: str
    value: str
    other: str | float  # a column or a level
    direction: int  # 1 upwards, -1 downwards, 0 either way
    callback: Callable[[AlertEvent], None] | None = None
    webhook: str | None = None
    payload: dict = field(default_factory=dict)

    def fires(self) -> Column:
        """1 where the series passes the other one upwards, -1 downwards, 0 otherwise; at a missing value nothing passes."""
        w = Window.partitionBy("key").orderBy("bar")
        a = F.col(self.value)
        b = F.col(self.other) if isinstance(self.other, str) else F.lit(float(self.other))
        a0, b0 = F.lag(a).over(w), F.lag(b).over(w) if isinstance(self.other, str) else b
        up, down = (a0 <= b0) & (a > b), (a0 >= b0) & (a < b)
        return F.coalesce(F.when(up, F.lit(1)).when(down, F.lit(-1)), F.lit(0))


class AlertManager:
    """Conditions on a table of bars (key, bar, columns). `events` is a DataFrame; `send` delivers it from the driver, row by row."""

    def __init__(self, symbol: str | None = None):
        self.symbol = symbol
        self.conditions: list[_Condition] = []

    def _add(self, c: _Condition) -> AlertManager:
        if any(x.condition_id == c.condition_id for x in self.conditions):
            raise ParameterError(f"there is a condition {c.condition_id!r} already")
        self.conditions.append(c)
        return self

    def add_threshold_condition(self, condition_id: str, column: str, level: float, direction: int = 1, callback=None, webhook_url: str | None = None, **payload) -> AlertManager:
        """The column passes the level: direction 1 upwards, -1 downwards."""
        if direction not in (1, -1):
            raise ParameterError("direction is 1 or -1")
        return self._add(_Condition(condition_id, column, float(level), direction, callback, webhook_url, payload))

    def add_cross_condition(self, condition_id: str, fast: str, slow: str, callback=None, webhook_url: str | None = None, **payload) -> AlertManager:
        """One column passes another, either way."""
        return self._add(_Condition(condition_id, fast, slow, 0, callback, webhook_url, payload))

    def events(self, bars: DataFrame) -> DataFrame:
        """key, bar, condition_id, value, direction: one row for each time that a condition fires; one shuffle for all."""
        if not self.conditions:
            return bars.limit(0).select("key", "bar", F.lit("").alias("condition_id"), F.lit(0.0).alias("value"), F.lit(0).alias("direction"))
        fired = [F.struct(F.lit(c.condition_id).alias("condition_id"), F.col(c.value).cast("double").alias("value"), c.fires().alias("direction"), F.lit(c.direction).alias("asked")) for c in self.conditions]
        made = bars.select("key", "bar", F.array(*fired).alias("all_"))
        hit = F.filter("all_", lambda e: (e["direction"] != 0) & ((e["asked"] == 0) | (e["asked"] == e["direction"])))
        return made.select("key", "bar", F.explode(hit).alias("e")).select("key", "bar", "e.condition_id", "e.value", "e.direction")

    def send(self, events: DataFrame) -> int:
        """Call callbacks and post to webhooks, in the order of (bar, condition_id). Events are alerts: few; they come to the driver one partition at a time."""
        by_id, n = {c.condition_id: c for c in self.conditions}, 0
        for r in events.orderBy("bar", "condition_id", "key").toLocalIterator():
            c = by_id[r["condition_id"]]
            event = AlertEvent(c.condition_id, r["key"], r["bar"], r["value"], r["direction"], {"symbol": self.symbol or r["key"], "direction": r["direction"], **c.payload})
            if c.callback:
                c.callback(event)
            if c.webhook:
                post(c.webhook, event)
            n += 1
        return n

    def stream(self, events: DataFrame, checkpoint: str):
        """Deliver a stream of events as it comes: a query that sends each micro-batch."""
        return events.writeStream.foreachBatch(lambda batch, _: self.send(batch)).option("checkpointLocation", checkpoint).start()


def post(url: str, event: AlertEvent, timeout: float = 5.0) -> None:
    """Failures of a webhook don't stop the others."""
    body = json.dumps(vars(event)).encode()
    try:
        urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout).close()
    except OSError:
        return


def collect_alert_bars(alerts: DataFrame, column: str = "alert") -> DataFrame:
    """key, bar of the rows where an alert fires."""
    return alerts.filter(F.col(column) != 0).select("key", "bar")


def union_of(events: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, events)


def register(add, src) -> None:
    from barloom.operators.features import compute_many

    bars, BARS = src["bars"], src["BARS"]
    manager = AlertManager().add_threshold_condition("high", "close", 1500.0, 1).add_threshold_condition("low", "close", 300.0, -1).add_cross_condition("cross", "sma", "sma_2")

    def events(s, d):
        made = compute_many(bars(s, d), [("SMA", {"timeperiod": 5}), ("SMA", {"timeperiod": 20})])
        return manager.events(made).selectExpr("key", "cast(bar AS BIGINT) AS bar", "condition_id", f"{fixed('value')} AS value", "cast(direction AS BIGINT) AS direction")

    mean = "CASE WHEN bar >= {1} THEN (SELECT avg(x.close) FROM b x WHERE x.key = t.key AND x.bar >= t.bar - {1} AND x.bar <= t.bar) END AS {0}"
    parts = [("high", "close", "1500", "1"), ("low", "close", "300", "-1"), ("cross", "f", "s", "1"), ("cross", "f", "s", "-1")]
    one = "SELECT n.key, n.bar, '{0}' AS condition_id, {4} AS value, {3} AS direction FROM v n JOIN v p ON p.key = n.key AND p.bar = n.bar - 1 WHERE {5} {6} {7} AND {4} {8} {9}"
    said = []
    for name, a, b, way in parts:
        side = lambda t, x: x if x.isdigit() else f"{t}.{x}"
        said.append(one.format(name, a, b, way, f"n.{a}", f"p.{a}", "<=" if way == "1" else ">=", side("p", b), ">" if way == "1" else "<", side("n", b)))
    add("alert_events", events, f"WITH b AS MATERIALIZED ({BARS}), v AS MATERIALIZED (SELECT *, {mean.format('f', 4)}, {mean.format('s', 19)} FROM b t) SELECT key, cast(bar AS BIGINT) AS bar, condition_id, {fixed('value')} AS value, cast(direction AS BIGINT) AS direction FROM ({' UNION ALL '.join(said)})")
    add("alert_bars", lambda s, d: collect_alert_bars(bars(s, d).withColumn("alert", (F.col("close") > 1700).cast("int"))).selectExpr("key", "cast(bar AS BIGINT) AS bar"), f"SELECT key, cast(bar AS BIGINT) AS bar FROM ({BARS}) WHERE close > 1700")
