"""Recurrences over one ordered series, for look-backs that never end.

Plain functions from numpy arrays to numpy arrays of the same length; NaN stands for "not yet". Batch operators
run them once for each key, streaming operators keep their state from bar to bar.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def follow(x: np.ndarray, start: int, seed: float, a: float, b: float) -> np.ndarray:
    """y[start] = seed, then y[i] = a * y[i-1] + b * x[i].

    In blocks, each by one running sum of b * x[i] / a**i, scaled back; what the block before left decays over the next one. A block is so
    short that a**-i stays below 1e12, and the newest terms outweigh the older, so nothing is lost to rounding.
    """
    out = np.full(len(x), NAN)
    n = len(x) - start - 1
    if n < 0 or start < 0:
        return out
    out[start] = seed
    if n == 0:
        return out
    if not 0 < a < 1:
        y = seed
        for i in range(start + 1, len(x)):
            y = a * y + b * x[i]
            out[i] = y
        return out
    size = max(1, min(n, 4096, int(math.log(1e-12) / math.log(a))))
    rows = -(-n // size)
    block = np.zeros(rows * size)
    block[:n] = x[start + 1 :]
    decay = a ** np.arange(1, size + 1)
    local = np.cumsum(block.reshape(rows, size) * (b / decay), axis=1) * decay
    carry = np.empty(rows)
    y, last = seed, float(decay[-1])
    for k, end in enumerate(local[:, -1].tolist()):
        carry[k] = y
        y = end + last * y
    out[start + 1 :] = (local + carry[:, None] * decay).reshape(-1)[:n]
    return out


def first_valid(x: np.ndarray) -> int:
    ok = np.flatnonzero(~np.isnan(x))
    return int(ok[0]) if len(ok) else len(x)


def ema(x: np.ndarray, p: int) -> np.ndarray:
    """Seeded by the mean of the first p values after a leading gap."""
    s = first_valid(x)
    if s + p > len(x):
        return np.full(len(x), NAN)
    k = 2 / (p + 1)
    return follow(x, s + p - 1, float(np.mean(x[s : s + p])), 1 - k, k)


def ema_from_first(x: np.ndarray, p: int) -> np.ndarray:
    k = 2 / (p + 1)
    return follow(x, 0, x[0], 1 - k, k) if len(x) else x


def wilder(x: np.ndarray, p: int, start: int) -> np.ndarray:
    """Wilder's mean: seeded by the mean of x[start : start + p], given at start + p - 1."""
    if start + p > len(x):
        return np.full(len(x), NAN)
    return follow(x, start + p - 1, float(np.mean(x[start : start + p])), (p - 1) / p, 1 / p)


def wilder_sum(x: np.ndarray, p: int, n: int) -> np.ndarray:
    """Wilder's sum over x[1:]: seeded by its first n values, given at n."""
    if n + 1 > len(x):
        return np.full(len(x), NAN)
    if p == 1:
        return np.concatenate(([NAN], x[1:]))
    return follow(x, n, float(np.sum(x[1 : n + 1])), (p - 1) / p, 1.0)


def gains(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(c, prepend=c[:1])
    return np.maximum(d, 0), np.maximum(-d, 0)


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0, NaN where b is NaN."""
    with np.errstate(all="ignore"):
        return np.where(b == 0, 0.0, a / b)


def rsi(c: np.ndarray, p: int = 14) -> np.ndarray:
    g, l = (wilder(x, p, 1) for x in gains(c))
    return np.clip(100 * _share(g, g + l), 0, 100)


def cmo(c: np.ndarray, p: int = 14) -> np.ndarray:
    g, l = (wilder(x, p, 1) for x in gains(c))
    return np.clip(100 * _share(g - l, g + l), -100, 100)


def true_range(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    pc = np.concatenate((c[:1], c[:-1]))
    out = np.maximum(h - l, np.maximum(np.abs(h - pc), np.abs(l - pc)))
    if len(out):
        out[0] = h[0] - l[0]
    return out


def atr(h, l, c, p: int = 14, from_first: bool = False) -> np.ndarray:
    """Seeded from bar 1, as usual, or from bar 0, as the channel indicators want it."""
    return wilder(true_range(h, l, c), p, 0 if from_first else 1)


def moves(h: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.diff(h, prepend=h[:1]), -np.diff(l, prepend=l[:1])
    return np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)


def directional(h, l, c, p: int = 14) -> dict[str, np.ndarray]:
    """The whole family in one pass."""
    up, down = moves(h, l)
    tr = wilder_sum(true_range(h, l, c), p, p)
    with np.errstate(all="ignore"):
        plus, minus = (np.where(tr == 0, NAN, 100 * wilder_sum(x, p, p) / tr) for x in (up, down))
    dx = 100 * _share(np.abs(plus - minus), plus + minus)
    adx = wilder(dx, p, p) if len(dx) >= 2 * p and not np.isnan(dx[p : 2 * p]).any() else np.full(len(dx), NAN)
    lagged = np.concatenate((np.full(p - 1, NAN), adx))[: len(adx)]
    return {"plus_dm": wilder_sum(up, p, max(p - 1, 1)), "minus_dm": wilder_sum(down, p, max(p - 1, 1)), "plus_di": plus, "minus_di": minus, "dx": dx, "adx": adx, "adxr": (adx + lagged) / 2}


def macd(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, ...]:
    line = ema(c, fast) - ema(c, slow)
    sig = ema(line, signal)
    line = np.where(np.isnan(sig), NAN, line)
    return line, sig, line - sig


def ppo(c: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, ...]:
    s = ema(c, slow)
    line = 100 * _share(ema(c, fast) - s, s)
    sig = ema(line, signal)
    line = np.where(np.isnan(sig), NAN, line)
    return line, sig, line - sig


def t3(c: np.ndarray, p: int = 5, v: float = 0.7) -> np.ndarray:
    e = [c]
    for _ in range(6):
        e.append(ema_from_first(e[-1], p))
    out = -(v**3) * e[6] + (3 * v**2 + 3 * v**3) * e[5] + (-6 * v**2 - 3 * v - 3 * v**3) * e[4] + (1 + 3 * v + v**3 + 3 * v**2) * e[3]
    out[: 6 * (p - 1)] = NAN
    return out


def kama(c: np.ndarray, p: int = 30) -> np.ndarray:
    """A flat window has efficiency 0."""
    out = np.full(len(c), NAN)
    if len(c) < p:
        return out
    out[p - 1] = c[p - 1]
    steps = np.abs(np.diff(c, prepend=c[:1]))
    path = np.lib.stride_tricks.sliding_window_view(steps, p)[1:].sum(axis=1)
    pace = (_share(np.abs(c[p:] - c[:-p]), path) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    y = c[p - 1]
    for i, (k, now) in enumerate(zip(pace.tolist(), c[p:].tolist(), strict=True), p):
        y += k * (now - y)
        out[i] = y
    return out


def rolling(x: np.ndarray, p: int, f) -> np.ndarray:
    """f over windows of p values; windows with a gap give NaN."""
    out = np.full(len(x), NAN)
    if len(x) >= p:
        out[p - 1 :] = f(np.lib.stride_tricks.sliding_window_view(x, p), axis=1)
    return out


def stoch_rsi(c: np.ndarray, p: int = 14, k: int = 5, d: int = 3) -> tuple[np.ndarray, np.ndarray]:
    r = rsi(c, p)
    hi, lo = rolling(r, k, np.max), rolling(r, k, np.min)
    fast = 100 * _share(r - lo, hi - lo)
    slow = rolling(fast, d, np.mean)
    return np.where(np.isnan(slow), NAN, fast), slow


def adosc(h, l, c, v, fast: int = 3, slow: int = 10) -> np.ndarray:
    line = np.cumsum(_share((c - l) - (h - c), h - l) * v)
    out = ema_from_first(line, fast) - ema_from_first(line, slow)
    out[: slow - 1] = NAN
    return out


def supertrend(h, l, c, p: int = 7, m: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    n, a, mid = len(c), atr(h, l, c, p, True), (h + l) / 2
    line, way = np.full(n, NAN), np.zeros(n)
    if n <= p:
        return line, way
    up, down = mid[p - 1] + m * a[p - 1], mid[p - 1] - m * a[p - 1]
    trend = -1  # until the close passes the upper band
    for i in range(p, n):
        u, d = mid[i] + m * a[i], mid[i] - m * a[i]
        up = u if u < up or c[i - 1] > up else up
        down = d if d > down or c[i - 1] < down else down
        trend = (1 if c[i] > up else -1) if trend < 0 else (-1 if c[i] < down else 1)
        way[i], line[i] = trend, down if trend == 1 else up
    return line, way


def sar(h, l, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    return sarext(h, l, long=(step, step, most), short=(step, step, most))


def sarext(h, l, start: float = 0.0, offset: float = 0.0, long=(0.02, 0.02, 0.2), short=(0.02, 0.02, 0.2)) -> np.ndarray:
    """Stop and reverse; long and short are (first, step, most) of the acceleration.

    Short legs are long legs of the mirrored prices, so one set of rules serves both: the stop follows the best price, never
    passes the last two bars, and turns where a bar crosses it.
    """
    n = len(h)
    out = np.full(n, NAN)
    if n < 2:
        return out
    ahead, behind, pace = {1: h, -1: -l}, {1: l, -1: -h}, {1: long, -1: short}
    side = 1 if h[1] >= h[0] else -1
    stop, best, k = start or behind[side][0], ahead[side][1], pace[side][0]
    out[1] = side * stop
    for i in range(2, n):
        stop = min(stop + k * (best - stop), behind[side][i - 1], behind[side][i - 2])
        if behind[side][i] < stop:
            stop, side = -(best + abs(stop) * offset), -side
            best, k = ahead[side][i], pace[side][0]
        elif ahead[side][i] > best:
            best, k = ahead[side][i], min(k + pace[side][1], pace[side][2])
        out[i] = side * stop
    return out


def wma(x: np.ndarray, p: int) -> np.ndarray:
    return rolling(x, p, lambda v, axis: (v * np.arange(1, p + 1)).sum(axis=axis) / (p * (p + 1) / 2))


def trima(x: np.ndarray, p: int) -> np.ndarray:
    w = np.minimum(np.arange(1, p + 1), np.arange(p, 0, -1))
    return rolling(x, p, lambda v, axis: (v * w).sum(axis=axis) / w.sum())


def moving_average(x: np.ndarray, p: int, kind: int = 0) -> np.ndarray:
    """0 simple, 1 exponential, 2 weighted, 3 double, 4 triple exponential, 5 triangular, 6 adaptive, 7 T3; a leading gap stays one."""
    s = first_valid(x)
    y = x[s:]
    e = [y]
    for _ in range(3 if kind in (3, 4) else 0):
        e.append(ema(e[-1], p))
    got = [
        lambda: rolling(y, p, np.mean), lambda: ema(y, p), lambda: wma(y, p), lambda: 2 * e[1] - e[2], lambda: 3 * e[1] - 3 * e[2] + e[3], lambda: trima(y, p), lambda: kama(y, p), lambda: t3(y, p),
    ][kind]()
    return np.concatenate((np.full(s, NAN), got))


def macdext(c: np.ndarray, fast: int = 12, fast_kind: int = 1, slow: int = 26, slow_kind: int = 1, signal: int = 9, signal_kind: int = 1) -> tuple[np.ndarray, ...]:
    line = moving_average(c, fast, fast_kind) - moving_average(c, slow, slow_kind)
    sig = moving_average(line, signal, signal_kind)
    line = np.where(np.isnan(sig), NAN, line)
    return line, sig, line - sig


def cusum_breaks(x: np.ndarray, w: int = 20, limit: float = 3.0, slack: float = 0.5) -> np.ndarray:
    """1 where a two-sided sum of z scores (against the w bars before) passes the limit; it starts anew there.

    Bars that have no score, because they or one of the bars before are missing or those don't vary, leave the sums as they are.
    """
    out, up, down = np.zeros(len(x)), 0.0, 0.0
    if w < 2 or len(x) <= w:
        return out
    parts = np.lib.stride_tricks.sliding_window_view(x, w)[:-1]
    with np.errstate(all="ignore"):
        scores = (x[w:] - parts.mean(axis=1)) / parts.std(axis=1, ddof=1)
    for i in np.flatnonzero(np.isfinite(scores)).tolist():
        up, down = max(0.0, up + scores[i] - slack), max(0.0, down - scores[i] - slack)
        if up > limit or down > limit:
            out[i + w], up, down = 1, 0.0, 0.0
    return out


def volume_bar_ids(v: np.ndarray, limit: float) -> np.ndarray:
    """A bar ends with the row that brings its volume to the limit; what exceeds it isn't carried over."""
    out, total = np.zeros(len(v), dtype=np.int64), np.cumsum(v)
    start, bar = 0, 0
    while start < len(v):
        before = total[start - 1] if start else 0.0
        # A step for each bar, not for each row; the sums from 0 are made anew near the end, where rounding could matter.
        near = int(np.searchsorted(total[start:], before + limit * (1 - 1e-9))) + start
        own = float(np.sum(v[start:near]))
        while near < len(v) and own + v[near] < limit:
            own += v[near]
            near += 1
        out[start : near + 1] = bar
        start, bar = near + 1, bar + 1
    return out
