"""Continuous futures from two contracts, volatility cones, and dynamic time warping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barloom.plans.frames import W, full, lag
from barloom.plans.staged import Stages, apply_stages, as_sql, outputs, rounded
from barloom.workers import workers_import

ALL = "OVER (PARTITION BY key)"


def continuous() -> Stages:
    """real0 is the near contract, real1 the next, weight the next one's share. The roll is at the first weight of a half, else the first above 0, else the last bar."""
    roll = f"coalesce(min(CASE WHEN weight >= 0.5 THEN bar END) {ALL}, min(CASE WHEN weight > 0 THEN bar END) {ALL}, max(bar) {ALL})"
    at = lambda x: f"max(CASE WHEN bar = _roll THEN {x} END) {ALL}"
    return [
        {"_roll": roll}, {"_f": at("real0"), "_n": at("real1")},
        {"weighted": "real0 * (1 - weight) + real1 * weight", "back_adjusted": "CASE WHEN bar < _roll THEN real0 + (_n - _f) ELSE real1 END",
         "ratio_adjusted": "CASE WHEN bar < _roll THEN real0 * coalesce(_n / nullif(_f, 0), 1.0) ELSE real1 END"},
    ]


def volatility_cone(windows: tuple[int, ...] = (10, 20, 60), days: float = 252.0) -> tuple[Stages, str]:
    """Stages that give the volatility of every window, and the query of their quantiles; one pass over the windows of a key."""
    vols = {f"v{w}": full("_q", w, f"sqrt(sum(_q) {W(w)} / {w} * {days})") for w in windows}
    stages = [{"_pc": lag("close")}, {"_r": "ln(close / nullif(_pc, 0))"}, {"_q": "_r * _r"}, vols]
    one = "SELECT key, {w} AS win, min(v{w}) AS lowest, {q}(v{w}, 0.25) AS p25, {q}(v{w}, 0.5) AS median, {q}(v{w}, 0.75) AS p75, max(v{w}) AS highest FROM {{t}} GROUP BY key"
    return stages, " UNION ALL ".join(one.format(w=w, q="{q}") for w in windows).replace("{{t}}", "{t}")


def dtw_distance(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Squared local costs, one root at the end; |i - j| < window. Anti-diagonals are computed at once."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    before, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by i + 1; diagonals d - 2 and d - 1
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        cost = (a[i] - b[j]) ** 2
        best = np.minimum(np.minimum(last[i], last[i + 1]), before[i]) if d else np.zeros(1)
        if window is not None:
            cost = np.where(np.abs(i - j) < window, cost, np.inf)
        now = np.full(n + 1, np.inf)
        now[i + 1] = cost + best
        before, last = last, now
    return float(np.sqrt(last[n]))


def dtw_path(a: np.ndarray, b: np.ndarray, window: int | None = None) -> list[tuple[int, int]]:
    """The warping path of least cost from (0, 0) to the ends; of equal ways back the diagonal one first, then that which shortens a."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    cost = np.full((n + 1, m + 1), np.inf)
    cost[0, 0] = 0
    for i in range(n):
        for j in range(m):
            if window is None or abs(i - j) < window:
                cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    if not np.isfinite(cost[n, m]):
        return []
    i, j, out = n, m, []
    while i and j:
        out.append((i - 1, j - 1))
        ways = ((i - 1, j - 1), (i - 1, j), (i, j - 1))
        i, j = min(ways, key=lambda w: cost[w])
    return out[::-1]


def dtw_paths(df: DataFrame, column: Column, reference: list[float], window: int | None = None) -> DataFrame:
    """df with path: array<struct<i, j>> from each array to one reference series."""
    workers_import(df.sparkSession)
    ref = np.asarray(reference, dtype=float)

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if x is None else [{"i": i, "j": j} for i, j in dtw_path(np.asarray(x, dtype=float), ref, window)] for x in s])

    return df.withColumn("path", run(column))


def dtw_sql(vectors: str, reference: str, window: int, out: str) -> str:
    """Distances by diagonals of the cost table: each cell passes its value on to those that follow it, and cells just outside the window pass on what crosses them."""
    return f"""WITH RECURSIVE v AS MATERIALIZED ({vectors}), q AS ({reference}), r(id, d, i, now, before) AS (SELECT id, 0, 0, power(v.x[1] - q.x[1], 2), cast('inf' AS DOUBLE) FROM v, q
 UNION ALL SELECT id, d, i, CASE WHEN abs(2 * i - d) < {window} THEN power(x[i + 1] - y[d - i + 1], 2) + low ELSE cast('inf' AS DOUBLE) END, coalesce(prev, cast('inf' AS DOUBLE)) FROM (
  SELECT p.id, p.d, p.i, min(p.val) AS low, max(p.bef) AS prev, any_value(v.x) AS x, any_value(q.x) AS y FROM (
   SELECT id, d + 1 AS d, e.i, e.val, e.bef FROM (SELECT id, d, unnest([{{'i': i, 'val': now, 'bef': now}}, {{'i': i + 1, 'val': now, 'bef': NULL}}, {{'i': i + 1, 'val': before, 'bef': NULL}}]) AS e FROM r)) p
  JOIN v USING (id), q WHERE p.i < len(v.x) AND p.d - p.i >= 0 AND p.d - p.i < len(q.x) AND abs(2 * p.i - p.d) <= {window} GROUP BY p.id, p.d, p.i))
 SELECT v.id AS {out}, {{0}} FROM v JOIN r ON r.id = v.id AND r.i = len(v.x) - 1, q WHERE r.d = len(v.x) + len(q.x) - 2"""


def dtw_to(reference: list[float], window: int | None = None):
    """A function of an array column: its distance to one reference series."""
    ref = np.asarray(reference, dtype=float)

    @F.pandas_udf(DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([float("nan") if x is None else dtw_distance(np.asarray(x, dtype=float), ref, window) for x in s])

    return run


def batch_dtw(df: DataFrame, column: Column, reference: list[float], window: int | None = None) -> DataFrame:
    workers_import(df.sparkSession)
    return df.withColumn("dtw", dtw_to(reference, window)(column))


def register(add, src) -> None:
    pair, PAIR, bars, BARS = src["pair"], src["PAIR"], src["bars"], src["BARS"]
    base = f"SELECT *, least(1.0, bar / 100.0) AS weight FROM ({PAIR})"
    add("fut_continuous", lambda s, d: apply_stages(pair(s, d).selectExpr("*", "cast(least(1.0, bar / 100.0) AS DOUBLE) AS weight"), continuous()).selectExpr("key", "ts", *rounded(outputs(continuous()))), as_sql(base, continuous()))
    stages, cone = volatility_cone()
    names = ["lowest", "p25", "median", "p75", "highest"]
    inner = BARS
    for st in stages:
        inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in st.items())} FROM ({inner})"
    cols = f"SELECT key, win, {', '.join(rounded(names))} FROM "
    add("vol_cone", lambda s, d: s.sql(f"{cols} ({cone.replace('{q}', 'percentile')})", t=apply_stages(bars(s, d), stages)),
        f"WITH t AS MATERIALIZED ({inner}) {cols} ({cone.replace('{q}', 'quantile_cont').replace('{t}', 't')})")

    def dtw(s, d):
        vectors = s.read.parquet(f"{d}/embeddings.parquet")
        reference = vectors.filter("vec_id = 0").select("embedding").first()
        return batch_dtw(vectors, F.col("embedding"), list(reference[0]) if reference else [], 5).selectExpr("vec_id", "round(dtw, 4) AS dtw")

    vectors, first = "SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings", "SELECT list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings WHERE vec_id = 0"
    add("ind_batch_dtw", dtw, dtw_sql(vectors, first, 5, "vec_id").replace("{0}", "round(sqrt(r.now), 4) AS dtw"))

    def path(s, d):
        # Daily closes of flag A and of flag R, month by month: how one is warped to the other.
        b = bars(s, d).withColumn("month", F.date_trunc("month", "ts")).groupBy("key", "month").agg(F.sort_array(F.collect_list(F.struct("ts", "close"))).alias("c"))
        one = b.filter("key = 'A'").select("month", F.col("c.close").alias("x")).join(b.filter("key = 'R'").select("month", F.col("c.close").alias("y")), "month")
        workers_import(s)

        @F.pandas_udf("double")
        def length(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([float(len(dtw_path(np.asarray(p, dtype=float), np.asarray(q, dtype=float)))) for p, q in zip(x, y, strict=True)])

        return one.select("month", length("x", "y").alias("steps"))

    add("ind_dtw_path", path)
