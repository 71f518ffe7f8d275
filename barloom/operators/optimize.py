"""Portfolio weights: means and covariances come from Spark, one small system is solved on the driver.

The covariances of n assets are n x n numbers; n is the size of a portfolio, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.errors import InputError, ParameterError

RIDGE = 1e-8  # added to the diagonal, so that near-copies of an asset don't make the system singular


def moments(returns: DataFrame, lookback: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Keys, mean returns and sample covariances from (key, ts, ret), over the times that all keys have (the last `lookback` of them)."""
    rows = returns.filter("ret IS NOT NULL").groupBy("ts", "key").agg(F.max("ret").alias("ret"))
    n = rows.select("key").distinct().count()
    if not n:
        raise InputError("there are no returns")
    whole = rows.groupBy("ts").count().filter(F.col("count") == n).select("ts")
    if lookback:
        whole = whole.orderBy(F.desc("ts")).limit(lookback)
    rows = rows.join(whole, "ts")
    mean = {r["key"]: r["m"] for r in rows.groupBy("key").agg(F.avg("ret").alias("m")).collect()}
    keys = sorted(mean)
    a, b = rows.select("ts", F.col("key").alias("i"), F.col("ret").alias("x")), rows.select("ts", F.col("key").alias("j"), F.col("ret").alias("y"))
    cov = np.zeros((len(keys), len(keys)))
    for r in a.join(b, "ts").filter("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("c")).collect():
        p, q = keys.index(r["i"]), keys.index(r["j"])
        cov[p, q] = cov[q, p] = r["c"]
    return keys, np.array([mean[k] for k in keys]), cov + RIDGE * np.eye(len(keys))


def _equalities(cov: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least variance under equalities rows @ w = values."""
    n, m = len(cov), len(rows)
    kkt = np.block([[2 * cov, rows.T], [rows, np.zeros((m, m))]])
    return np.linalg.lstsq(kkt, np.concatenate((np.zeros(n), values)), rcond=None)[0]


def least_variance(cov: np.ndarray, rows: np.ndarray, values: np.ndarray, allow_short: bool) -> np.ndarray:
    """The same with weights of 0 or more: an asset goes while its weight is negative, and comes back while that lowers the variance."""
    n = len(cov)
    free = np.ones(n, dtype=bool)
    w = np.zeros(n)
    for _ in range(20 * n):
        got = _equalities(cov[np.ix_(free, free)], rows[:, free], values)
        w = np.zeros(n)
        w[free] = got[: free.sum()]
        if allow_short:
            return w
        if (w < -1e-12).any():
            free[int(np.argmin(w))] = False
            if not free.any():
                break
            continue
        slack = 2 * cov @ w + rows.T @ got[free.sum() :]
        slack[free] = 0
        if (slack >= -1e-12).all():
            return np.maximum(w, 0)
        free[int(np.argmin(slack))] = True
    return np.maximum(w, 0)


def mean_variance(mean: np.ndarray, cov: np.ndarray, target_return: float | None = None, allow_short: bool = False) -> np.ndarray:
    """The weights of least variance, of those with the target return if one is given; they sum to 1."""
    rows, values = [np.ones(len(mean))], [1.0]
    if target_return is not None:
        if not allow_short and not mean.min() - 1e-12 <= target_return <= mean.max() + 1e-12:
            raise ParameterError(f"no mix without short positions returns {target_return}")
        rows.append(mean)
        values.append(target_return)
    w = least_variance(cov, np.array(rows), np.array(values), allow_short)
    return w / w.sum()


def risk_parity(cov: np.ndarray, budget: np.ndarray | None = None, rounds: int = 10_000) -> np.ndarray:
    """Weights whose shares of the risk are the budget's: coordinates of a convex problem in turn."""
    n = len(cov)
    b = np.ones(n) / n if budget is None else np.asarray(budget, dtype=float) / np.sum(budget)
    if len(b) != n or (b <= 0).any():
        raise ParameterError("a risk budget has a number above 0 for each asset")
    y = 1 / np.sqrt(np.diag(cov))
    for _ in range(rounds):
        before = y.copy()
        for i in range(n):
            rest = cov[i] @ y - cov[i, i] * y[i]
            y[i] = (-rest + np.sqrt(rest * rest + 4 * cov[i, i] * b[i])) / (2 * cov[i, i])
        if np.abs(y - before).max() <= 1e-14 * np.abs(y).max():
            break
    return y / y.sum()


def max_sharpe(mean: np.ndarray, cov: np.ndarray, risk_free_rate: float = 0.0, allow_short: bool = False) -> np.ndarray:
    """The weights of the best excess return by deviation: the least variance at an excess of 1, scaled to sum to 1."""
    extra = mean - risk_free_rate
    if allow_short:
        y = np.linalg.solve(cov, extra)
        return y / y.sum()
    if extra.max() <= 0:  # every mix loses: the ratio is best where the loss is spread widest
        best = [np.eye(len(mean))[i] for i in range(len(mean))]
        return max(best, key=lambda w: (w @ extra) / np.sqrt(w @ cov @ w))
    y = least_variance(cov, extra[None, :], np.array([1.0]), False)
    return y / y.sum()


METHODS = ("min_variance", "risk_parity", "max_sharpe")


@dataclass(frozen=True)
class PortfolioOptimizer:
    """Settings; every `with_` gives a new one, `optimize` a dict of weights by key."""

    method: str = "min_variance"
    lookback: int | None = None
    allow_short: bool = False
    risk_free_rate: float = 0.0
    target_return: float | None = None
    risk_budget: tuple[float, ...] | None = None

    def with_method(self, method: str) -> PortfolioOptimizer:
        if method not in METHODS:
            raise ParameterError(f"method is one of {', '.join(METHODS)}")
        return replace(self, method=method)

    def with_lookback(self, bars: int) -> PortfolioOptimizer:
        return replace(self, lookback=int(bars))

    def with_short_selling(self, allow: bool = True) -> PortfolioOptimizer:
        return replace(self, allow_short=allow)

    def with_risk_free_rate(self, rate: float) -> PortfolioOptimizer:
        return replace(self, risk_free_rate=rate)

    def with_target_return(self, target: float) -> PortfolioOptimizer:
        return replace(self, target_return=target)

    def with_risk_budget(self, budget) -> PortfolioOptimizer:
        return replace(self, risk_budget=tuple(budget))

    def optimize(self, returns: DataFrame) -> dict[str, float]:
        """returns: key, ts, ret. A risk budget goes by the keys in order."""
        keys, mean, cov = moments(returns, self.lookback)
        if len(keys) == 1:
            return {keys[0]: 1.0}
        if self.method == "risk_parity":
            w = risk_parity(cov, self.risk_budget)
        elif self.method == "max_sharpe":
            w = max_sharpe(mean, cov, self.risk_free_rate, self.allow_short)
        else:
            w = mean_variance(mean, cov, self.target_return, self.allow_short)
        return dict(zip(keys, w.tolist(), strict=True))


def simple_returns(bars: DataFrame) -> DataFrame:
    """key, ts, ret: the change of the close."""
    before = F.lag("close").over(Window.partitionBy("key").orderBy("ts"))
    return bars.select("key", "ts", (F.col("close") / F.when(before != 0, before) - 1).alias("ret"))


def register(add, src) -> None:
    bars, BARS = src["bars"], src["BARS"]
    rets = f"SELECT key, ts, close / lag(close) OVER (PARTITION BY key ORDER BY ts) - 1 AS r FROM ({BARS})"
    wide = f"SELECT a.r AS x, b.r AS y, c.r AS z FROM ({rets}) a JOIN ({rets}) b USING (ts) JOIN ({rets}) c USING (ts) WHERE a.key = 'A' AND b.key = 'N' AND c.key = 'R' AND a.r IS NOT NULL AND b.r IS NOT NULL AND c.r IS NOT NULL"
    cov = "SELECT var_samp(x) + 1e-8 AS xx, var_samp(y) + 1e-8 AS yy, var_samp(z) + 1e-8 AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM (" + wide + ")"
    # The inverse of a 3 x 3 matrix by its cofactors, times a vector.
    solve = lambda a, b, c: f"(yy * zz - yz * yz) * {a} + (xz * yz - xy * zz) * {b} + (xy * yz - xz * yy) * {c} AS u, (xz * yz - xy * zz) * {a} + (xx * zz - xz * xz) * {b} + (xy * xz - xx * yz) * {c} AS v, (xy * yz - xz * yy) * {a} + (xy * xz - xx * yz) * {b} + (xx * yy - xy * xy) * {c} AS w"
    shares = "SELECT unnest(['A', 'N', 'R']) AS key, round(unnest([u / (u + v + w), v / (u + v + w), w / (u + v + w)]), 6) AS weight FROM (SELECT {0} FROM ({1}))"

    def weights(s, d, o):
        return s.createDataFrame(list(o.optimize(simple_returns(bars(s, d))).items()), "key string, weight double").selectExpr("key", "round(weight, 6) AS weight")

    short = PortfolioOptimizer().with_short_selling()
    add("ana_min_variance", lambda s, d: weights(s, d, short), shares.format(solve("1", "1", "1"), cov))
    add("ana_max_sharpe", lambda s, d: weights(s, d, short.with_method("max_sharpe").with_risk_free_rate(0.01)), shares.format(solve("(mx - 0.01)", "(my - 0.01)", "(mz - 0.01)"), cov))
    add("ana_risk_parity", lambda s, d: weights(s, d, PortfolioOptimizer().with_method("risk_parity")))
