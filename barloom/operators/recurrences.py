"""Indicators by recurrence: one fused pass over each key for all that are asked for.

A key's rows go to one Python worker, sorted there; parallelism is the number of keys, and a key has to fit into a worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.functions import cycles as C
from barloom.functions import kernels as K

Kernel = Callable[..., dict[str, np.ndarray]]


def _macd_like(f, names):
    return lambda close, **kw: dict(zip(names, f(close, **kw), strict=True))


def _dema(close, p=30):
    e = K.ema(close, p)
    return {"dema": 2 * e - K.ema(e, p)}


def _tema(close, p=30):
    a = K.ema(close, p)
    b = K.ema(a, p)
    return {"tema": 3 * a - 3 * b + K.ema(b, p)}


def _trix(close, p=30):
    e = K.ema(K.ema(K.ema(close, p), p), p)
    before = np.concatenate(([np.nan], e[:-1]))
    return {"trix": 100 * K._share(e - before, before)}


def _keltner(high, low, close, p=20, atr_p=10, m=2.0):
    mid, a = K.ema(close, p), K.atr(high, low, close, atr_p, True)
    return {"upper": mid + m * a, "middle": np.where(np.isnan(a), np.nan, mid), "lower": mid - m * a}


def _chandelier(high, low, close, p=22, m=3.0):
    a = K.atr(high, low, close, p, True)
    return {"long_exit": K.rolling(high, p, np.max) - m * a, "short_exit": K.rolling(low, p, np.min) + m * a}


def _family(name):
    return lambda high, low, close, p=14: {name: K.directional(high, low, close, p)[name]}


def _natr(high, low, close, p=14):
    a = K.atr(high, low, close, p)
    return {"natr": np.where(close == 0, np.nan, 100 * K._share(a, close))}


def _regime(high, low, close, p=14, level=25.0):
    a = K.directional(high, low, close, p)["adx"]
    return {"regime": np.where(np.isnan(a), -1.0, (a > level).astype(float))}


CYCLES = {
    "HT_TRENDLINE": ("ht_trendline",), "HT_DCPERIOD": ("ht_dcperiod",), "HT_DCPHASE": ("ht_dcphase",), "HT_PHASOR": ("inphase", "quadrature"), "HT_SINE": ("sine", "leadsine"), "HT_TRENDMODE": ("ht_trendmode",),
}


def _cycle(outs):
    def run(close):
        got = C.cycle(close)
        return {o: got[o] for o in outs}

    return run


HLC = ("high", "low", "close")
# name: (inputs, kernel, outputs)
RECURRENCES: dict[str, tuple[tuple[str, ...], Kernel, tuple[str, ...]]] = {
    "EMA": (("close",), lambda close, p=30: {"ema": K.ema(close, p)}, ("ema",)),
    "DEMA": (("close",), _dema, ("dema",)),
    "TEMA": (("close",), _tema, ("tema",)),
    "T3": (("close",), lambda close, p=5, v=0.7: {"t3": K.t3(close, p, v)}, ("t3",)),
    "KAMA": (("close",), lambda close, p=30: {"kama": K.kama(close, p)}, ("kama",)),
    "MACD": (("close",), _macd_like(K.macd, ("macd", "signal", "hist")), ("macd", "signal", "hist")),
    "MACDFIX": (("close",), lambda close, signal=9: dict(zip(("macd", "signal", "hist"), K.macd(close, 12, 26, signal), strict=True)), ("macd", "signal", "hist")),
    "PPO": (("close",), _macd_like(K.ppo, ("ppo", "signal", "hist")), ("ppo", "signal", "hist")),
    "APO": (("close",), lambda close, fast=12, slow=26: {"apo": K.ema(close, fast) - K.ema(close, slow)}, ("apo",)),
    "TRIX": (("close",), _trix, ("trix",)),
    "RSI": (("close",), lambda close, p=14: {"rsi": K.rsi(close, p)}, ("rsi",)),
    "CMO": (("close",), lambda close, p=14: {"cmo": K.cmo(close, p)}, ("cmo",)),
    "STOCHRSI": (("close",), _macd_like(K.stoch_rsi, ("fastk", "fastd")), ("fastk", "fastd")),
    "ATR": (HLC, lambda high, low, close, p=14: {"atr": K.atr(high, low, close, p)}, ("atr",)),
    "NATR": (HLC, _natr, ("natr",)),
    **{x.upper(): (HLC, _family(x), (x,)) for x in ("plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr")},
    "ADOSC": ((*HLC, "volume"), lambda high, low, close, volume, fast=3, slow=10: {"adosc": K.adosc(high, low, close, volume, fast, slow)}, ("adosc",)),
    "KELTNER_CHANNELS": (HLC, _keltner, ("upper", "middle", "lower")),
    "CHANDELIER_EXIT": (HLC, _chandelier, ("long_exit", "short_exit")),
    "SAR": (("high", "low"), lambda high, low, step=0.02, most=0.2: {"sar": K.sar(high, low, step, most)}, ("sar",)),
    "SAREXT": (("high", "low"), lambda high, low, **kw: {"sarext": K.sarext(high, low, **kw)}, ("sarext",)),
    "MACDEXT": (("close",), _macd_like(K.macdext, ("macd", "signal", "hist")), ("macd", "signal", "hist")),
    "REGIME_ADX": (HLC, _regime, ("regime",)),
    "CUSUM_BREAKS": (("close",), lambda close, w=20, limit=3.0, slack=0.5: {"break": K.cusum_breaks(close, w, limit, slack)}, ("break",)),
    "MAMA": (("close",), lambda close, fast=0.5, slow=0.05: dict(zip(("mama", "fama"), C.mama(close, fast, slow), strict=True)), ("mama", "fama")),
    **{name: (("close",), _cycle(outs), outs) for name, outs in CYCLES.items()},
}
#: Averages by kind: 0 simple, 1 exponential, 2 weighted, 3 double, 4 triple exponential, 5 triangular, 6 adaptive, 7 T3.
RECURRENCES["MA_TYPE"] = (("close",), lambda close, p=30, matype=0: {"ma": K.moving_average(close, p, matype)}, ("ma",))
RECURRENCES |= {f"MA_{k}": (("close",), lambda close, p=30, k=k: {"ma": K.moving_average(close, p, k)}, ("ma",)) for k in range(1, 8)}
RECURRENCES["SUPERTREND"] = (HLC, lambda high, low, close, p=7, m=3.0: dict(zip(("line", "direction"), K.supertrend(high, low, close, p, m), strict=True)), ("line", "direction"))


def apply_recurrences(bars: DataFrame, specs: list[tuple[str, dict]], prefix: bool = False) -> DataFrame:
    """bars with the outputs of all specs (name, parameters) added, by one pass over each key."""
    plan = [(*RECURRENCES[name], kw, f"{name.lower()}_{i}_" if prefix else "") for i, (name, kw) in enumerate(specs)]
    names = [tag + o for _, _, outs, _, tag in plan for o in outs]
    kept = [f for f in bars.schema.fields if f.name not in names]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ts")
        series = {c: rows[c].to_numpy().astype(float) for ins, *_ in plan for c in ins}  # missing values are NaN here
        cols = {f.name: rows[f.name] for f in kept}
        for ins, kernel, _, kw, tag in plan:
            for o, x in kernel(*(series[c] for c in ins), **kw).items():
                cols[tag + o] = pa.array(x, pa.float64(), mask=np.isnan(x))
        return pa.table({c: cols[c] for c in [f.name for f in kept] + names})

    schema = StructType([*kept, *[StructField(x, DoubleType()) for x in names]])
    return bars.groupBy("key").applyInArrow(run, schema)
