"""Recurrences against plain formulas, bounds, degenerate series, and streams against batches."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.functions import kernels as K
from barloom.streaming import indicators as S

RNG = np.random.default_rng(7)
CLOSE = 100 + np.cumsum(RNG.normal(size=300))
HIGH, LOW, VOLUME = CLOSE + RNG.uniform(0.1, 1, 300), CLOSE - RNG.uniform(0.1, 1, 300), RNG.uniform(100, 200, 300)


def same(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_ema_by_hand():
    same(K.ema(np.array([1.0, 2, 3, 4, 5]), 3), [np.nan, np.nan, 2, 3, 4])
    same(K.ema(np.array([np.nan, 1, 2, 3, 4]), 3), [np.nan, np.nan, np.nan, 2, 3])
    assert np.isnan(K.ema(np.array([1.0]), 3)).all() and len(K.ema(np.array([]), 3)) == 0


def test_rsi_by_hand():
    c = np.array([1.0, 2, 1, 3, 2])
    out = K.rsi(c, 2)
    assert out[2] == pytest.approx(50.0)
    g, l = (0.5 + 2) / 2, 0.25
    assert out[3] == pytest.approx(100 * g / (g + l))


def test_flat_series():
    flat = np.full(80, 5.0)
    assert np.nanmax(K.rsi(flat)) == 0 and np.nanmax(np.abs(K.cmo(flat))) == 0
    assert K.kama(flat)[-1] == 5.0
    d = K.directional(flat, flat, flat)
    assert np.isnan(d["plus_di"]).all()
    assert np.nanmax(K.stoch_rsi(flat)[0]) == 0


def test_macd_warm_up_and_difference():
    line, sig, hist = K.macd(CLOSE)
    assert np.isnan(line[:33]).all() and not np.isnan(line[33:]).any()
    same(hist, line - sig)


def test_sar_flips_and_stays_outside():
    out = K.sar(HIGH, LOW)
    assert np.isnan(out[0]) and not np.isnan(out[1:]).any()
    assert ((out[2:] <= HIGH[2:]) | (out[2:] >= LOW[2:])).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(1e-3, 1e6), min_size=2, max_size=120))
def test_bounds(values):
    c = np.array(values)
    r, m = K.rsi(c), K.cmo(c)
    assert len(r) == len(c) and np.nanmin(np.append(r, 0)) >= 0 and np.nanmax(np.append(r, 0)) <= 100
    assert np.nanmax(np.abs(np.append(m, 0))) <= 100


@pytest.mark.parametrize("name", ["EMA", "RSI", "ATR", "MACD", "SUPERTREND"])
def test_stream_is_batch(name):
    batch = {
        "EMA": lambda: (K.ema(CLOSE, 20),), "RSI": lambda: (K.rsi(CLOSE),), "ATR": lambda: (K.atr(HIGH, LOW, CLOSE),), "MACD": lambda: K.macd(CLOSE), "SUPERTREND": lambda: K.supertrend(HIGH, LOW, CLOSE),
    }[name]()
    make, ins, _ = S.STEPPERS[name]
    stepper, cols = make(), {"close": CLOSE, "high": HIGH, "low": LOW, "volume": VOLUME}
    got = [stepper.step(*row) for row in zip(*(cols[c] for c in ins), strict=True)]
    got = np.array([g if isinstance(g, tuple) else (g,) for g in got], dtype=float).T
    for a, b in zip(batch, got, strict=True):
        same(a, b)


def test_volume_bars_start_from_zero():
    assert K.volume_bar_ids(np.array([3.0, 8, 2, 9, 1]), 10).tolist() == [0, 0, 1, 1, 2]


def test_bootstrap_repeats_and_blocks_are_runs():
    from barloom.operators.backtest import bootstrap_path

    r = RNG.normal(0, 0.01, 50)
    a, b = bootstrap_path(r, 3, 42, 5), bootstrap_path(r, 3, 42, 5)
    same(a, b)
    steps = np.concatenate(([a[0]], a[1:] / a[:-1])) - 1
    at = [int(np.argmin(np.abs(r - x))) for x in steps]
    assert all((at[i + 1] - at[i]) % 50 == 1 for k in range(0, 50, 5) for i in range(k, k + 4))


def test_implied_volatility_round_trip():
    from barloom.functions import derivatives as D

    s, k, t, v = np.full(5, 100.0), np.array([80.0, 90, 100, 110, 120]), np.full(5, 0.5), np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    call = np.array([1, 0, 1, 0, 1])
    price = D._np_bsm(s, k, 0.03, 0.01, t, v, call)
    got = D._implied(price, s, k, np.full(5, 0.03), np.full(5, 0.01), t, call)
    np.testing.assert_allclose(D._np_bsm(s, k, 0.03, 0.01, t, got, call), price, atol=1e-9)
    american = D._american(s, k, np.full(5, 0.03), np.full(5, 0.01), t, v, call)
    assert (american >= price - 1e-9).all()
    assert math.isnan(D._implied(np.array([-1.0]), s[:1], k[:1], np.full(1, 0.03), np.full(1, 0.01), t[:1], call[:1])[0])


def test_dtw_is_the_plain_recursion():
    from barloom.operators.series_pairs import dtw_distance

    def plain(a, b, w):
        best = {}
        for i in range(len(a)):
            for j in range(len(b)):
                if w is not None and abs(i - j) >= w:
                    continue
                came = [best.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1))]
                best[i, j] = (a[i] - b[j]) ** 2 + (0 if i == j == 0 else min(came))
        return math.sqrt(best.get((len(a) - 1, len(b) - 1), math.inf))

    for n, m, w in ((1, 1, None), (5, 9, None), (12, 12, 3), (7, 4, 5), (3, 9, 2)):
        a, b = RNG.normal(size=n), RNG.normal(size=m)
        assert dtw_distance(a, b, w) == pytest.approx(plain(a, b, w))
    assert math.isnan(dtw_distance(np.array([]), np.array([1.0])))


def test_extended_forms_reduce_to_the_plain_ones():
    same(K.sarext(HIGH, LOW), K.sar(HIGH, LOW))
    for a, b in zip(K.macdext(CLOSE), K.macd(CLOSE), strict=True):
        same(a, b)
    for kind in range(8):
        got = K.moving_average(CLOSE, 5, kind)
        assert len(got) == len(CLOSE) and not np.isnan(got[40:]).any()
    same(K.wma(np.array([1.0, 2, 3]), 3), [np.nan, np.nan, 14 / 6])
