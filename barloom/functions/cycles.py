"""Hilbert-transform cycle measures: one quadrature filter, which the six cycle indicators and the adaptive average share.

The filter keeps its last seven values, so that it can also run bar by bar on a stream.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from barloom.functions.kernels import NAN

# The taps of the transform, how its gain follows the period, and the warm-up rows.
TAPS, GAIN = (0.0962, 0.5769, -0.5769, -0.0962), (0.075, 0.54)
CYCLE_WARMUP, MAMA_WARMUP = 63, 32


def _delays() -> deque:
    return deque([0.0] * 7, maxlen=7)


def _transform(x: deque) -> float:
    """The newest value is the last."""
    return TAPS[0] * x[6] + TAPS[1] * x[4] + TAPS[2] * x[2] + TAPS[3] * x[0]


@dataclass
class Quadrature:
    """In-phase and quadrature parts of smoothed prices and the period of their rotation.

    `floor` is the least period that the next step may start from (0: the first period isn't held to a change by a half or a third).
    """

    floor: float = 0.0
    bars: int = 0
    prices: deque = field(default_factory=lambda: deque(maxlen=4))
    smooth: deque = field(default_factory=_delays)
    detrended: deque = field(default_factory=_delays)
    quad: deque = field(default_factory=_delays)
    phase_in: deque = field(default_factory=_delays)
    rotation: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # smoothed i2, q2, real and imaginary product
    period: float = 0.0

    def step(self, price: float) -> tuple[float, float, float, float]:
        """in-phase, quadrature, period and smoothed price after one more bar."""
        n = self.bars
        self.bars += 1
        self.prices.append(price)
        self.smooth.append(np.dot((1.0, 2.0, 3.0, 4.0), self.prices) / 10 if n >= 3 else price)
        if n < 6:
            return 0.0, 0.0, 0.0, self.smooth[-1]
        before = max(self.period, self.floor)
        gain = GAIN[0] * before + GAIN[1]
        self.detrended.append(_transform(self.smooth) * gain)
        self.quad.append(_transform(self.detrended) * gain if n >= 12 else 0.0)
        self.phase_in.append(self.detrended[3] if n >= 9 else 0.0)
        ahead = _transform(self.phase_in) * gain if n >= 15 else 0.0
        behind = _transform(self.quad) * gain if n >= 18 else 0.0
        i0, q0, re, im = self.rotation
        i2 = 0.2 * (self.phase_in[-1] - behind) + 0.8 * i0
        q2 = 0.2 * (self.quad[-1] + ahead) + 0.8 * q0
        re = 0.2 * (i2 * i0 + q2 * q0) + 0.8 * re
        im = 0.2 * (i2 * q0 - q2 * i0) + 0.8 * im
        self.rotation = (i2, q2, re, im)
        now = 2 * math.pi / math.atan(im / re) if re > 0 and im != 0 else before
        if before > 0:
            now = min(max(now, 0.67 * before), 1.5 * before)
        self.period = 0.2 * min(max(now, 6.0), 50.0) + 0.8 * before
        return self.phase_in[-1], self.quad[-1], self.period, self.smooth[-1]


def degrees(inphase: float, quadrature: float) -> float:
    """The angle; straight up, down or 0 where there is no in-phase part."""
    if inphase:
        return math.degrees(math.atan2(quadrature, inphase))
    return 90.0 * ((quadrature > 0) - (quadrature < 0))


def cycle(close: np.ndarray) -> dict[str, np.ndarray]:
    """All six cycle indicators; NaN during the warm-up, but a trend mode of 0."""
    n = len(close)
    names = ("ht_trendline", "ht_dcperiod", "ht_dcphase", "inphase", "quadrature", "sine", "leadsine")
    out = {x: np.full(n, NAN) for x in names}
    out["ht_trendmode"] = np.zeros(n)
    if n <= CYCLE_WARMUP:
        return out
    q, steady, smooth = Quadrature(), 0.0, np.empty(n)
    for i, price in enumerate(close.tolist()):
        inphase, quadrature, period, smooth[i] = q.step(price)
        if i >= 6:
            steady = 0.33 * period + 0.67 * steady
        if i < CYCLE_WARMUP:
            continue
        angle = degrees(inphase, quadrature)
        length = min(max(math.floor(steady + 0.5), 1), i + 1)
        values = (smooth[i + 1 - length : i + 1].mean(), steady, angle, inphase, quadrature, math.sin(math.radians(angle)), math.sin(math.radians(angle + 45)))
        for x, v in zip(names, values, strict=True):
            out[x][i] = v
        out["ht_trendmode"][i] = float(steady < 20)
    return out


def mama(close: np.ndarray, fast: float = 0.5, slow: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The average whose pace falls with the turn of the phase, and the one that follows it at half that pace."""
    n = len(close)
    lead, follow = np.full(n, NAN), np.full(n, NAN)
    if n <= MAMA_WARMUP:
        return lead, follow
    q, angle = Quadrature(floor=1.0), 0.0
    at = after = 0.0
    for i, price in enumerate(close.tolist()):
        inphase, quadrature, _, _ = q.step(price)
        before, angle = angle, degrees(inphase, quadrature)
        pace = min(max(fast / max(before - angle, 1.0), slow), fast)
        if i < MAMA_WARMUP:
            at = after = price
            continue
        at += pace * (price - at)
        after += 0.5 * pace * (at - after)
        lead[i], follow[i] = at, after
    return lead, follow
