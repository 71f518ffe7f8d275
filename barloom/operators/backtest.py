"""Close-only backtests: positions lag signals by a bar, slippage and commission fall on changes; equity, metrics, folds, resampling.

Equity is a running product, from which costs are taken as what they have become by then. Metrics are windows and one aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.commission import Commission
from barloom.plans.frames import CUM, L, W, div, fixed, lag
from barloom.plans.staged import Stages, apply_stages, as_sql, rounded
from barloom.workers import workers_import


def signals(fast: int = 10, slow: int = 30) -> Stages:
    """A fiftieth of the capital long above, short below, NULL until both averages are there."""
    return [
        {"_f": f"CASE WHEN bar >= {slow - 1} THEN avg(close) {W(fast)} END", "_s": f"CASE WHEN bar >= {slow - 1} THEN avg(close) {W(slow)} END"},
        {"signal": "CASE WHEN _f > _s THEN 0.02 WHEN _f IS NOT NULL THEN -0.02 END"},
    ]


def returns(slippage_bps: float = 0.0) -> Stages:
    """position, bar_return, strategy_return, changed."""
    return [
        {"position": f"coalesce({lag('signal')}, 0.0)", "bar_return": f"coalesce({div('close', lag('close'))} - 1, 0.0)"},
        {"changed": f"CASE WHEN abs(position - {lag('position')}) > 1e-12 THEN 1 ELSE 0 END"},
        {"strategy_return": f"position * bar_return - changed * {slippage_bps / 10_000!r}"},
    ]


# A running product of 1 + r from sums: logarithms of the sizes, a count of signs, and 0 from the first zero on.
EQUITY: Stages = [
    {"_g": "1 + strategy_return"},
    {"equity": f"CASE WHEN min(abs(_g)) {CUM} = 0 THEN 0.0 ELSE exp(sum(ln(nullif(abs(_g), 0))) {CUM}) * (1 - 2 * (sum(CASE WHEN _g < 0 THEN 1 ELSE 0 END) {CUM} % 2)) END"},
]


def equity_with_commission(cost: float) -> Stages:
    """equity: times 1 + strategy_return, less the cost of a change.

    A running product G and what each cost has become by then: G * (1 - sum of cost / G). Where 1 + r is 0 all that was before is lost, and a
    stretch of its own begins there with nothing.
    """
    own = "OVER (PARTITION BY key, _stretch ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    product = f"exp(sum(ln(abs(_g))) {own}) * (1 - 2 * (sum(CASE WHEN _g < 0 THEN 1 ELSE 0 END) {own} % 2))"
    return [
        {"_r": "1 + strategy_return"}, {"_stretch": f"sum(CASE WHEN _r = 0 THEN 1 ELSE 0 END) {CUM}", "_g": "CASE WHEN _r = 0 THEN 1.0 ELSE _r END"}, {"_product": product},
        {"equity": f"_product * (CASE WHEN _stretch = 0 THEN 1.0 ELSE 0.0 END - {cost!r} * sum(changed / _product) {own})"},
    ]


def metrics_sql(table: str, periods: float = 252.0, rf: float = 0.0) -> str:
    """One row per key from (key, ts, strategy_return, bar_return, equity), with those of the benchmark (bar_return); ratios without a
    denominator are 0, but NULL where they would be infinite."""
    per, root = rf / periods, periods**0.5
    return f"""
WITH a AS (SELECT key, ts, strategy_return AS r, bar_return AS b, equity AS e, max(equity) {CUM} AS peak, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY strategy_return) AS nth,
 avg(strategy_return) OVER (PARTITION BY key) AS mean, stddev_pop(strategy_return) OVER (PARTITION BY key) AS sd, row_number() {L} AS pos FROM {table}),
b AS (SELECT *, (e - peak) / peak AS dd, CASE WHEN lag(peak) {L} = peak THEN 0 ELSE 1 END AS high, CASE WHEN (r <> 0) <> (lag(r) {L} <> 0) THEN 1 ELSE 0 END AS flip FROM a),
c AS (SELECT *, sum(high) {CUM} AS spell FROM b),
spells AS (SELECT key, spell, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS len FROM c GROUP BY key, spell),
longest AS (SELECT key, max(len) AS max_len, coalesce(avg(CASE WHEN len > 0 THEN len END), 0.0) AS avg_len FROM spells GROUP BY key),
m AS (SELECT key, max(n) AS n, max(CASE WHEN pos = n THEN e END) / max(CASE WHEN pos = 1 THEN e END) AS growth, max(sd) AS sd,
 sqrt(sum(CASE WHEN r < {per} THEN (r - {per}) * (r - {per}) ELSE 0 END) / count(*)) AS down, min(dd) AS max_dd, coalesce(avg(CASE WHEN dd < 0 THEN dd END), 0.0) AS avg_dd, sqrt(avg(dd * dd)) AS ulcer,
 avg(CASE WHEN sd > 0 THEN power((r - mean) / sd, 3) ELSE 0 END) AS skewness, avg(CASE WHEN sd > 0 THEN power((r - mean) / sd, 4) ELSE 3 END) - 3 AS kurtosis,
 sum(CASE WHEN r <> 0 THEN 1 ELSE 0 END) AS n_active, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS wins, coalesce(avg(CASE WHEN r > 0 THEN r END), 0.0) AS avg_win, coalesce(avg(CASE WHEN r < 0 THEN r END), 0.0) AS avg_loss,
 sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS won, -sum(CASE WHEN r < 0 THEN r ELSE 0 END) AS lost, sum(CASE WHEN r > {per} THEN r - {per} ELSE 0 END) AS above, sum(CASE WHEN r <= {per} THEN {per} - r ELSE 0 END) AS below,
 max(CASE WHEN nth = floor(n * 0.05) + 1 THEN r END) AS p5, max(CASE WHEN nth = floor(n * 0.95) + 1 THEN r END) AS p95, max(r) AS best, min(r) AS worst, covar_pop(r, b) AS cov, var_pop(b) AS var_b, stddev_pop(r - b) AS te,
 sum(flip) AS flips, CASE WHEN min(1 + b) > 0 THEN exp(sum(CASE WHEN b > -1 THEN ln(1 + b) END)) END AS b_growth FROM c GROUP BY key),
k AS (SELECT m.*, longest.max_len, longest.avg_len, CASE WHEN growth > 0 THEN power(growth, {periods} / n) - 1 ELSE 0.0 END AS cagr, sd * {root!r} AS vol, power(b_growth, {periods} / n) - 1 AS b_cagr, sqrt(var_b) * {root!r} AS b_vol,
 coalesce(cast(wins AS DOUBLE) / nullif(n_active, 0), 0.0) AS win_rate FROM m JOIN longest ON m.key = longest.key)
SELECT key, round(growth - 1, 6) AS total_return, round(cagr, 6) AS cagr, round(vol, 6) AS annualized_vol, round(coalesce((cagr - {rf}) / nullif(vol, 0), 0.0), 6) AS sharpe, round(coalesce((cagr - {rf}) / nullif(down * {root!r}, 0), 0.0), 6) AS sortino,
 round(coalesce(cagr / nullif(abs(max_dd), 0), 0.0), 6) AS calmar, round(max_dd, 6) AS max_drawdown, round(avg_dd, 6) AS avg_drawdown, cast(max_len AS BIGINT) AS max_drawdown_bars, round(avg_len, 6) AS avg_drawdown_bars, round(ulcer, 6) AS ulcer_index,
 round(above / nullif(below, 0), 6) AS omega_ratio, round(win_rate, 6) AS win_rate, round(won / nullif(lost, 0), 6) AS profit_factor, round(win_rate * avg_win - (1 - win_rate) * abs(avg_loss), 6) AS r_expectancy, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss,
 round(abs(p95) / nullif(abs(p5), 0), 6) AS tail_ratio, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(best, 6) AS best_bar, round(worst, 6) AS worst_bar, cast(n_active AS BIGINT) AS n_trades, cast(flips AS BIGINT) AS n_position_changes,
 round(b_growth - 1, 6) AS benchmark_total_return, round(b_cagr, 6) AS benchmark_cagr, round(b_vol, 6) AS benchmark_annualized_vol, round(coalesce((b_cagr - {rf}) / nullif(b_vol, 0), 0.0), 6) AS benchmark_sharpe,
 round(cagr - b_cagr, 6) AS alpha, round(coalesce(cov / nullif(var_b, 0), 0.0), 6) AS beta, round(te * {root!r}, 6) AS tracking_error, round(coalesce((cagr - b_cagr) / nullif(te * {root!r}, 0), 0.0), 6) AS information_ratio FROM k"""


def metrics_apart_sql(base: str) -> str:
    """The same metrics (252 periods, no risk-free rate) from lists of each key's returns and from subqueries over its past, to compare with."""
    return f"""WITH t AS MATERIALIZED (SELECT key, strategy_return AS r, bar_return AS b, equity AS e, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM ({base})),
 d AS MATERIALIZED (SELECT t.*, (SELECT max(x.e) FROM t x WHERE x.key = t.key AND x.i <= t.i) AS top, (SELECT x.r FROM t x WHERE x.key = t.key AND x.i = t.i - 1) AS r0 FROM t),
 s AS (SELECT key, top, count(*) AS len FROM d WHERE e < top GROUP BY key, top), sl AS (SELECT key, max(len) AS longest, avg(len) AS mean_len FROM s GROUP BY key),
 l AS (SELECT key, count(*) AS n, list_sort(list(r)) AS rs, arg_max(e, i) / arg_min(e, i) AS g, product(1 + b) AS bg, avg(r) AS m, list_var_pop(list(r)) AS v, list_var_pop(list(b)) AS vb, avg(r * b) - avg(r) * avg(b) AS cov, list_var_pop(list(r - b)) AS ve,
  min(e / top - 1) AS dd, avg(e / top - 1) FILTER (e < top) AS add_, avg(power(e / top - 1, 2)) AS u, count(*) FILTER ((r <> 0) <> (r0 <> 0)) AS flips FROM d GROUP BY key),
 q AS (SELECT l.*, list_filter(rs, lambda x: x > 0) AS w, list_filter(rs, lambda x: x < 0) AS z, list_aggregate(list_transform(rs, lambda x: power(least(x, 0), 2)), 'avg') AS dv, list_aggregate(list_transform(rs, lambda x: power(x - m, 3)), 'avg') AS m3,
  list_aggregate(list_transform(rs, lambda x: power(x - m, 4)), 'avg') AS m4, CASE WHEN g > 0 THEN power(g, 252.0 / n) - 1 ELSE 0 END AS c, power(bg, 252.0 / n) - 1 AS bc FROM l),
 p AS (SELECT *, len(w) / (len(w) + len(z)) AS wr, sqrt(v * 252) AS vol, sqrt(vb * 252) AS bvol, sqrt(ve * 252) AS te FROM q)
 SELECT key, round(g - 1, 6) AS total_return, round(c, 6) AS cagr, round(vol, 6) AS annualized_vol, round(c / vol, 6) AS sharpe, round(c / sqrt(dv * 252), 6) AS sortino, round(c / -dd, 6) AS calmar, round(dd, 6) AS max_drawdown, round(add_, 6) AS avg_drawdown,
 cast(longest AS BIGINT) AS max_drawdown_bars, round(mean_len, 6) AS avg_drawdown_bars, round(sqrt(u), 6) AS ulcer_index, round(list_sum(w) / -list_sum(z), 6) AS omega_ratio, round(wr, 6) AS win_rate, round(list_sum(w) / -list_sum(z), 6) AS profit_factor,
 round(wr * list_avg(w) + (1 - wr) * list_avg(z), 6) AS r_expectancy, round(list_avg(w), 6) AS avg_win, round(list_avg(z), 6) AS avg_loss, round(abs(rs[1 + cast(floor(n * 0.95) AS INT)]) / abs(rs[1 + cast(floor(n * 0.05) AS INT)]), 6) AS tail_ratio,
 round(m3 / power(v, 1.5), 6) AS skewness, round(m4 / (v * v) - 3, 6) AS kurtosis, round(list_max(rs), 6) AS best_bar, round(list_min(rs), 6) AS worst_bar, cast(len(w) + len(z) AS BIGINT) AS n_trades, cast(flips AS BIGINT) AS n_position_changes,
 round(bg - 1, 6) AS benchmark_total_return, round(bc, 6) AS benchmark_cagr, round(bvol, 6) AS benchmark_annualized_vol, round(bc / bvol, 6) AS benchmark_sharpe, round(c - bc, 6) AS alpha, round(cov / vb, 6) AS beta, round(te, 6) AS tracking_error,
 round((c - bc) / te, 6) AS information_ratio FROM p JOIN sl USING (key)"""


# Knuth's 64-bit linear congruential generator and the multiplier that parts the simulations.
LCG_A, LCG_C, SIM_A, MASK = 6364136223846793005, 1442695040888963407, 2862933555777941757, (1 << 64) - 1


def bootstrap_path(r: np.ndarray, sim: int, seed: int, block: int) -> np.ndarray:
    """The equity of one resampled path: circular blocks of returns."""
    state = (seed * LCG_A + sim * SIM_A) & MASK
    n, block = len(r), max(1, min(block, len(r)))

    def draw() -> int:
        nonlocal state
        state = (state * LCG_A + LCG_C) & MASK
        return state >> 11

    draw(), draw()
    starts = np.array([draw() % n for _ in range(-(-n // block))])
    at = (starts[:, None] + np.arange(block)).reshape(-1)[:n] % n
    return np.cumprod(1 + r[at])


SIMS_OF_A_ROW = 10


def _resampled(bars: DataFrame, n_sims: int, seed: int, block: int, f, schema: str) -> DataFrame:
    """f(key, sim, equity) of every resampled path. A key's returns are one array, shipped once for each few simulations and dealt out with them."""
    workers_import(bars.sparkSession)
    rows = bars.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ts", "strategy_return"))).alias("r")).select("key", F.col("r.strategy_return").alias("r"))
    firsts = F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(SIMS_OF_A_ROW))).alias("first")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts):
        for pdf in parts:
            for key, r, first in zip(pdf["key"], pdf["r"], pdf["first"], strict=True):
                made = [f(key, sim, bootstrap_path(np.asarray(r, dtype=float), sim, seed, block)) for sim in range(first, min(first + SIMS_OF_A_ROW, n_sims))]
                yield pd.concat([pd.DataFrame(m, columns=names) for m in made])

    return rows.select("key", "r", firsts).repartition("key", "first").mapInPandas(run, schema)


def monte_carlo(bars: DataFrame, n_sims: int = 50, seed: int = 42, block: int = 5) -> DataFrame:
    """key, sim, final_equity, worst_drawdown for each key's resampled strategy returns."""
    one = lambda key, sim, e: [(key, sim, e[-1], float((e / np.maximum.accumulate(e) - 1).min()))]
    return _resampled(bars, n_sims, seed, block, one, "key string, sim long, final_equity double, worst_drawdown double")


def monte_carlo_curves(bars: DataFrame, n_sims: int = 50, seed: int = 42, block: int = 5) -> DataFrame:
    """key, sim, bar, equity: the whole curves."""
    one = lambda key, sim, e: {"key": key, "sim": sim, "bar": np.arange(len(e)), "equity": e}
    return _resampled(bars, n_sims, seed, block, one, "key string, sim long, bar long, equity double")


def paths_sql(base: str, n_sims: int, seed: int, block: int) -> str:
    """key, sim, pos, e: the same paths as a recursive query over (key, bar, strategy_return), in 128-bit arithmetic."""
    two64 = 1 << 64
    step = f"(state::UHUGEINT * {LCG_A % two64}::UHUGEINT + {LCG_C}::UHUGEINT) % {two64}::UHUGEINT"
    return f"""b AS MATERIALIZED ({base}), n AS (SELECT key, count(*) AS n, least(count(*), {block}) AS size FROM b GROUP BY key),
 g(key, n, size, sim, i, state) AS (SELECT key, n, size, sim, -2, ({seed}::UHUGEINT * {LCG_A % two64}::UHUGEINT + sim::UHUGEINT * {SIM_A}::UHUGEINT) % {two64}::UHUGEINT FROM n, range({n_sims}) s(sim)
 UNION ALL SELECT key, n, size, sim, i + 1, {step} FROM g WHERE i + 1 <= ceil(n / size)),
 starts AS (SELECT key, n, size, sim, i - 1 AS nth, ((state // 2048) % n::UHUGEINT)::BIGINT AS first_bar FROM g WHERE i >= 1),
 picks AS (SELECT key, sim, nth * size + j AS pos, (first_bar + j) % n AS bar FROM starts, range({block}) t(j) WHERE j < size AND nth * size + j < n),
 paths AS (SELECT p.key, p.sim, p.pos, product(1 + b.strategy_return) OVER (PARTITION BY p.key, p.sim ORDER BY p.pos) AS e FROM picks p JOIN b ON b.key = p.key AND b.bar = p.bar)"""


def walk_forward(bars: DataFrame, train: int, test: int, step: int = 0, anchored: bool = False) -> DataFrame:
    """key, fold, train_start, train_end, test_start, test_end (ends exclusive) from each key's number of bars."""
    if train < 1 or test < 1:
        raise ValueError("train and test must be at least 1")
    step = step or test
    start = "0" if anchored else f"fold * {step}"
    folds = f"explode(sequence(cast(0 AS BIGINT), cast(floor((n - {train + test}) / {step}) AS BIGINT))) AS fold"
    sized = bars.groupBy("key").count().withColumnRenamed("count", "n").filter(f"n >= {train + test}").selectExpr("key", folds)
    return sized.selectExpr("key", "fold", f"{start} AS train_start", f"fold * {step} + {train} AS train_end", f"fold * {step} + {train} AS test_start", f"fold * {step} + {train + test} AS test_end")


def plan_sql(bars: str) -> str:
    """Crossings of averages and their returns with five basis points of slippage, from joins with the bars before."""
    mean = lambda p: f"(SELECT avg(x.close) FROM b x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar)"
    return f"""WITH b AS MATERIALIZED ({bars}), s AS MATERIALIZED (SELECT t.*, CASE WHEN bar >= 29 THEN CASE WHEN {mean(10)} > {mean(30)} THEN 0.02 ELSE -0.02 END END AS signal FROM b t)
 SELECT s.key, s.ts, s.bar, s.close, s.signal, coalesce(p.signal, 0.0) AS position, coalesce(s.close / p.close - 1, 0.0) AS bar_return, coalesce(p.signal, 0.0) * coalesce(s.close / p.close - 1, 0.0) - CASE WHEN p.bar IS NOT NULL AND coalesce(p.signal, 0.0) <> coalesce(q.signal, 0.0) THEN 0.0005 ELSE 0 END AS strategy_return,
 CASE WHEN p.bar IS NOT NULL AND coalesce(p.signal, 0.0) <> coalesce(q.signal, 0.0) THEN 1 ELSE 0 END AS changed FROM s LEFT JOIN s p ON p.key = s.key AND p.bar = s.bar - 1 LEFT JOIN s q ON q.key = s.key AND q.bar = s.bar - 2"""


def register(add, src) -> None:
    bars, BARS = src["bars"], src["BARS"]
    plan = [*signals(), *returns(5.0)]

    def prepared(s, d):
        return apply_stages(bars(s, d), plan)

    base = plan_sql(BARS)
    grown = f"SELECT *, product(1 + strategy_return) OVER (PARTITION BY key ORDER BY ts) AS equity FROM ({base})"
    cols = ["position", "bar_return", "strategy_return", "equity"]
    add("bt_close_only", lambda s, d: apply_stages(prepared(s, d), EQUITY).selectExpr("key", "ts", *rounded(cols)),
        f"SELECT key, ts, {', '.join(rounded(cols))} FROM ({grown})")

    add("bt_commission", lambda s, d: apply_stages(prepared(s, d), equity_with_commission(0.001)).selectExpr("key", "ts", *rounded(cols)), f"WITH RECURSIVE b AS MATERIALIZED ({base}), r(key, bar, e) AS (SELECT key, bar, 1 + strategy_return - 0.001 * changed FROM b WHERE bar = 0 UNION ALL SELECT b.key, b.bar, r.e * (1 + b.strategy_return) - 0.001 * b.changed FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1) SELECT key, ts, {', '.join(rounded(cols[:3]))}, {fixed('r.e')} AS equity FROM r JOIN b USING (key, bar)")
    add("bt_metrics", lambda s, d: s.sql(metrics_sql("{t}"), t=apply_stages(prepared(s, d), EQUITY)), metrics_apart_sql(grown))
    worst = f"WITH RECURSIVE {paths_sql(f'SELECT key, bar, strategy_return FROM ({base})', 50, 42, 5)}, d AS (SELECT *, e / max(e) OVER (PARTITION BY key, sim ORDER BY pos) - 1 AS dd, count(*) OVER (PARTITION BY key, sim) - 1 AS last FROM paths)"
    add("bt_monte_carlo", lambda s, d: monte_carlo(prepared(s, d)).selectExpr("key", "sim", f"{fixed('final_equity')} AS final_equity", f"{fixed('worst_drawdown')} AS worst_drawdown"),
        f"{worst} SELECT key, sim, {fixed('max(CASE WHEN pos = last THEN e END)')} AS final_equity, {fixed('min(dd)')} AS worst_drawdown FROM d GROUP BY key, sim")
    add("bt_walk_forward", lambda s, d: walk_forward(bars(s, d), 200, 50).selectExpr(*[f"cast({c} AS {t}) AS {c}" for c, t in (("key", "STRING"), *((c, "BIGINT") for c in ("fold", "train_start", "train_end", "test_start", "test_end")))]),
        f"SELECT key, fold, fold * 50 AS train_start, fold * 50 + 200 AS train_end, fold * 50 + 200 AS test_start, fold * 50 + 250 AS test_end FROM (SELECT key, unnest(range(0, cast(floor((n - 250) / 50) AS BIGINT) + 1)) AS fold FROM (SELECT key, count(*) AS n FROM ({BARS}) GROUP BY key) WHERE n >= 250)")
    fee = Commission(rate_of_value=0.0003, flat_per_order=1.0, max_brokerage=20.0, exchange_charges_rate=0.00003, stamp_duty_rate=0.00015, gst_rate=0.18, stt_rate=0.0002, stt_on_sell=True, spread_bps=2.0)
    cost = fee.cost("close * volume", "volume", "close >= open")
    add("bt_commission_model", lambda s, d: bars(s, d).selectExpr("key", "ts", f"{fixed(cost, 2)} AS cost"), f"""SELECT key, ts, {fixed('b + x + 0.18 * (b + x) + CASE WHEN close >= open THEN 0.00015 * v ELSE 0.0002 * v END + 0.0001 * v', 2)} AS cost FROM (SELECT key, ts, open, close, close * volume AS v, least(20.0, 1 + 0.0003 * close * volume) AS b, 0.00003 * close * volume AS x FROM ({BARS}))""")
    kelly = "greatest(0.0, least(1.0, w - (1 - w) * abs(l) / nullif(g, 0)))"
    won = "sum(CASE WHEN strategy_return > 0 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN strategy_return <> 0 THEN 1.0 ELSE 0.0 END), 0)"
    inner = f"SELECT key, {won} AS w, avg(CASE WHEN strategy_return > 0 THEN strategy_return END) AS g, avg(CASE WHEN strategy_return < 0 THEN strategy_return END) AS l FROM {{0}} GROUP BY key"
    add("bt_kelly", lambda s, d: s.sql(f"SELECT key, round({kelly}, 6) AS kelly, round({kelly} / 2, 6) AS half_kelly FROM ({inner.format('{t}')})", t=prepared(s, d)), f"SELECT key, round({kelly}, 6) AS kelly, round({kelly} / 2, 6) AS half_kelly FROM ({inner.format(f'({base})')})")
