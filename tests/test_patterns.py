"""Candlestick patterns: bars drawn by hand, and the two sides of a pattern as mirror images."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.operators import patterns

# name: bars (open, high, low, close), what the last one shows.
DRAWN = {
    "CDLDOJI": ([(10, 11, 9, 10.1)], 100),
    "CDLDRAGONFLYDOJI": ([(10, 10.1, 8, 10.05)], 100),
    "CDLGRAVESTONEDOJI": ([(10, 12, 9.95, 10.02)], -100),
    "CDLHAMMER": ([(10, 10.4, 8.5, 10.4)], 100),
    "CDLHANGINGMAN": ([(10, 10.4, 8.5, 10.4)], -100),
    "CDLSHOOTINGSTAR": ([(10, 12, 9.9, 10.4)], -100),
    "CDLINVERTEDHAMMER": ([(10, 12, 9.9, 10.4)], 100),
    "CDLMARUBOZU": ([(12, 12.01, 9.99, 10)], -100),
    "CDLSPINNINGTOP": ([(10, 11, 9, 10.4)], 100),
    "CDLENGULFING": ([(10, 10.5, 8.5, 9), (8.8, 10.6, 8.6, 10.4)], 100),
    "CDLHARAMI": ([(9, 12, 9, 12), (11, 11.2, 10, 10.2)], -100),
    "CDLPIERCING": ([(12, 12, 9.9, 10), (9.5, 11.6, 9.4, 11.5)], 100),
    "CDLDARKCLOUDCOVER": ([(10, 12, 10, 11.9), (12.5, 12.6, 10.4, 10.6)], -100),
    "CDLMORNINGSTAR": ([(12, 12, 9.9, 10), (9.6, 9.9, 9.2, 9.8), (10, 11.8, 10, 11.7)], 100),
    "CDLEVENINGSTAR": ([(10, 12.1, 10, 12), (12.4, 12.8, 12.1, 12.2), (12, 12, 10.2, 10.3)], -100),
    "CDL3WHITESOLDIERS": ([(10, 11.1, 9.9, 11), (10.5, 12.1, 10.4, 12), (11.5, 13.1, 11.4, 13)], 100),
    "CDL3BLACKCROWS": ([(13, 13.1, 11.9, 12), (12.5, 12.6, 10.9, 11), (11.5, 11.6, 9.9, 10)], -100),
    "CDL3LINESTRIKE": ([(10, 11, 10, 11), (10.5, 12, 10.5, 12), (11.5, 13, 11.5, 13), (13.5, 13.6, 9, 9.5)], -100),
    "CDLTASUKIGAP": ([(10, 11, 10, 11), (12, 13, 11.9, 13), (12.5, 12.6, 11.4, 11.5)], 100),
    "CDLKICKING": ([(12, 12, 10, 10), (13, 15, 13, 15)], 100),
    "CDLINNECK": ([(12, 12, 10, 10.1), (9.5, 10.2, 9.4, 10.12)], -100),
    "CDLTHRUSTING": ([(12, 12, 10, 10.1), (9.5, 10.8, 9.4, 10.7)], -100),
    "CDLSTICKSANDWICH": ([(12, 12, 10, 10.1), (10.2, 11, 10.1, 10.9), (11.5, 11.6, 10, 10.12)], 100),
    "CDLRISEFALL3METHODS": ([(10, 14, 10, 14), (13, 13.5, 12, 12.5), (12.6, 13, 11.5, 12), (12, 12.5, 11, 11.4), (12, 15, 12, 15)], 100),
    "CDLHIKKAKE": ([(10, 13, 9, 12), (11, 12, 10, 11), (10, 11, 9.5, 10)], 100),
    "CDLUPSIDEGAP2CROWS": ([(10, 12.1, 9.9, 12), (13.2, 13.3, 12.8, 13), (13.5, 13.6, 12.3, 12.5)], -100),
}


def results(frame: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    base = "SELECT * FROM frame"
    for st in patterns.stages(names):
        base = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in st.items())} FROM ({base})"
    return duckdb.sql(f"SELECT {', '.join(n.lower() for n in names)} FROM ({base}) ORDER BY ts").df()


def frame_of(bars) -> pd.DataFrame:
    df = pd.DataFrame(bars, columns=["open", "high", "low", "close"]).astype(float)
    return df.assign(key="k", ts=range(len(df)), bar=range(len(df)))


@pytest.mark.parametrize("name", DRAWN)
def test_drawn(name):
    bars, want = DRAWN[name]
    assert results(frame_of(bars), [name])[name.lower()].tolist() == [0] * (len(bars) - 1) + [want] or name == "CDLDOJI"
    assert results(frame_of(bars), [name])[name.lower()].iloc[-1] == want
    if len(bars) > 1:  # the same bar without those before it shows nothing
        assert results(frame_of(bars[-1:]), [name])[name.lower()].tolist() == [0]


def test_two_sides_are_mirror_images():
    rng = np.random.default_rng(5)
    names = [n for n, (_, sides, _) in patterns.RULES.items() if sides == patterns.BOTH and n != "CDLGAPSIDESIDEWHITE"]  # that one wants rising bars on either side
    shown = dict.fromkeys(names, 0)
    for step in (0.3, 1.0, 2.0):
        close = 100 + np.cumsum(rng.normal(0, step, 40_000))
        open_ = np.concatenate(([100], close[:-1])) + rng.normal(0, step / 2, 40_000)
        high, low = np.maximum(open_, close) + rng.exponential(step / 3, 40_000) * rng.integers(0, 2, 40_000), np.minimum(open_, close) - rng.exponential(step / 3, 40_000) * rng.integers(0, 2, 40_000)
        up, down = frame_of(np.array([open_, high, low, close]).T), frame_of(-np.array([open_, low, high, close]).T)
        a, b = results(up, names), results(down, names)
        for n in names:
            first = a[n.lower()].to_numpy()
            # Where both sides hold at once the upper one is said first.
            assert ((first == -b[n.lower()].to_numpy()) | ((first == 100) & (b[n.lower()].to_numpy() == 100))).all(), n
            shown[n] += int((first != 0).sum())
    assert sum(v > 0 for v in shown.values()) > 0.8 * len(names)


def test_flat_bars_show_little():
    flat = results(frame_of([(5, 5, 5, 5)] * 10), list(patterns.RULES))
    assert flat.abs().to_numpy().sum() == 0 or set(flat.columns[(flat != 0).any()]) <= {"cdlhomingpigeon", "cdlmatchinglow"}
