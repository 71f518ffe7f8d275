"""Indicators by name: one registry, many in one plan, feature tables, and windows over chunks of long series.

However many are asked for, those over windows share one shuffle and one sort, and all recurrences are one pass over each key.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom import config
from barloom.errors import ParameterError, RegistryError, check_timeperiod
from barloom.operators import patterns
from barloom.operators import window_indicators as W_
from barloom.operators.recurrences import RECURRENCES, apply_recurrences
from barloom.plans.frames import agg, fixed, lag, wma
from barloom.plans.staged import Stages, _spark, apply_stages, outputs

_one = lambda out, e: [{out: e}]
#: Window indicators that take parameters; the others are as in `window_indicators.INDICATORS`.
MAKERS: dict[str, Callable[..., Stages]] = {
    "SMA": lambda timeperiod=30: W_.sma(p=timeperiod), "WMA": lambda timeperiod=30: _one("wma", wma("close", timeperiod)), "TRIMA": lambda timeperiod=30: W_.trima(timeperiod),
    "BBANDS": lambda timeperiod=5, nbdevup=2.0, nbdevdn=2.0: W_.bbands(timeperiod, nbdevup, nbdevdn), "MOM": lambda timeperiod=10: _one("mom", f"close - {lag('close', timeperiod)}"),
    **{k.upper(): (lambda timeperiod=10, k=k: W_.roc(k, timeperiod)) for k in ("roc", "rocp", "rocr", "rocr100")},
    "WILLR": lambda timeperiod=14: W_.willr(timeperiod), "AROON": lambda timeperiod=14: W_.aroon(timeperiod), "AROONOSC": lambda timeperiod=14: W_.aroon(timeperiod, True), "CCI": lambda timeperiod=14: W_.cci(timeperiod), "MFI": lambda timeperiod=14: W_.mfi(timeperiod),
    "STOCH": lambda fastk_period=5, slowk_period=3, slowd_period=3: W_.stoch(fastk_period, slowk_period, slowd_period), "STOCHF": lambda fastk_period=5, fastd_period=3: W_.stoch(fastk_period, 1, fastd_period, ("fastk", "fastd")),
    "ULTOSC": lambda timeperiod1=7, timeperiod2=14, timeperiod3=28: W_.ultosc(timeperiod1, timeperiod2, timeperiod3),
    "STDDEV": lambda timeperiod=5, nbdev=1.0: _one("stddev", f"{nbdev!r} * ({agg('stddev_pop', 'close', timeperiod)})"), "VAR": lambda timeperiod=5: _one("var", agg("var_pop", "close", timeperiod)),
    **{k.upper(): (lambda timeperiod=14, k=k: W_.linear(k, timeperiod)) for k in ("linearreg", "linearreg_slope", "linearreg_intercept", "linearreg_angle", "tsf")},
    "MIDPOINT": lambda timeperiod=14: _one("midpoint", f"({agg('max', 'close', timeperiod)} + {agg('min', 'close', timeperiod)}) / 2"), "MIDPRICE": lambda timeperiod=14: _one("midprice", f"({agg('max', 'high', timeperiod)} + {agg('min', 'low', timeperiod)}) / 2"),
    "SUM": lambda timeperiod=30: _one("sum", agg("sum", "close", timeperiod)), "MAX": lambda timeperiod=30: _one("max", agg("max", "close", timeperiod)), "MIN": lambda timeperiod=30: _one("min", agg("min", "close", timeperiod)),
    "DONCHIAN": lambda timeperiod=20: W_.donchian(timeperiod), "HULL_MA": lambda timeperiod=16: W_.hull(timeperiod), "VWMA": lambda timeperiod=20: W_.vwma(timeperiod), "CHOPPINESS_INDEX": lambda timeperiod=14: W_.choppiness(timeperiod),
    "VWAP": lambda timeperiod=0: W_.vwap(timeperiod), "PIVOT_POINTS": lambda method="classic": W_.pivots(method), "ZSCORE": lambda window=20: W_.zscore(window),
}
#: What the parameters of recurrences are called in their kernels.
RENAMED = {"timeperiod": "p", "fastperiod": "fast", "slowperiod": "slow", "signalperiod": "signal", "acceleration": "step", "maximum": "most", "vfactor": "v", "fastlimit": "fast", "slowlimit": "slow", "multiplier": "m"}

Spec = str | tuple
_CUSTOM: dict[str, Callable[..., DataFrame]] = {}


def register_indicator(name: str, f: Callable[..., DataFrame]) -> None:
    """f takes a table of bars and parameters, and gives it back with columns added."""
    if not name or not callable(f):
        raise ParameterError("an indicator needs a name and a function")
    _CUSTOM[name.upper()] = f


def unregister_indicator(name: str) -> None:
    if name.upper() not in _CUSTOM:
        raise RegistryError(f"no indicator {name!r} was registered")
    del _CUSTOM[name.upper()]


def list_indicators() -> list[str]:
    return sorted({*MAKERS, *W_.INDICATORS, *RECURRENCES, *patterns.RULES, *_CUSTOM})


def get_indicator(name: str) -> Callable[..., DataFrame]:
    """A function of bars and parameters."""
    if name.upper() not in list_indicators():
        raise RegistryError(f"unknown indicator {name!r}", "list_indicators() names all")
    return lambda bars, **params: compute_many(bars, [(name, params)])


def run_indicator(name: str, bars: DataFrame, **params) -> DataFrame:
    return get_indicator(name)(bars, **params)


def _stages_of(name: str, params: dict) -> Stages:
    if name in patterns.RULES:
        return patterns.stages([name])
    if name not in MAKERS:
        if params:
            raise ParameterError(f"{name} takes no parameters here: {', '.join(params)}")
        return W_.INDICATORS[name]
    try:
        return MAKERS[name](**params)
    except TypeError as e:
        raise ParameterError(f"{name}: {e}") from None


def _renamed(stages: Stages, nth: int, names: dict[str, str]) -> Stages:
    """Helpers of different specs kept apart, outputs named."""
    tag = lambda e: re.sub(r"(?<![\w.])_([A-Za-z0-9])", rf"_s{nth}_\1", e)
    return [{(tag(c) if c.startswith("_") else names[c]): tag(_spark(e)) for c, e in st.items()} for st in stages]


def _columns(name: str, outs: list[str], taken: set[str]) -> dict[str, str]:
    """NAME for a single output, NAME_output for several; a number is added where that is taken."""
    out = {}
    for o in outs:
        base = name.lower() if len(outs) == 1 else f"{name.lower()}_{o}"
        column, k = base, 2
        while column in taken:
            column, k = f"{base}_{k}", k + 1
        taken.add(column)
        out[o] = column
    return out


def compute_many(bars: DataFrame, specs: list[Spec]) -> DataFrame:
    """bars (key, ts, bar, prices) and the outputs of all specs: NAME or (NAME, parameters)."""
    taken, stages, loops, custom, order = set(bars.columns), [], [], [], []
    named: dict[str, str] = {}
    for nth, spec in enumerate(specs):
        name, params = (spec, {}) if isinstance(spec, str) else (spec[0], dict(spec[1]))
        name = name.upper()
        params = {k: v for k, v in config.get_defaults_for(name).items() if _takes(name, k)} | params
        for k, v in params.items():
            if "period" in k:
                check_timeperiod(v, k, 0 if name == "VWAP" else 1)
        if name in _CUSTOM:
            custom.append((_CUSTOM[name], params))
        elif name in RECURRENCES:
            names = _columns(name, list(RECURRENCES[name][2]), taken)
            named |= {f"{name.lower()}_{len(loops)}_{o}": c for o, c in names.items()}
            order += names.values()
            loops.append((name, {RENAMED.get(k, k): v for k, v in params.items()}))
        elif name in list_indicators():
            made = _stages_of(name, params)
            names = _columns(name, outputs(made), taken)
            stages.append(_renamed(made, nth, names))
            order += names.values()
        else:
            raise RegistryError(f"unknown indicator {name!r}", "list_indicators() names all")
    merged = [{c: e for st in stages if len(st) > k for c, e in st[k].items()} for k in range(max(map(len, stages), default=0))]
    out = apply_stages(bars, merged) if merged else bars
    if loops:
        out = apply_recurrences(out, loops, prefix=True).withColumnsRenamed(named)
    out = out.select(*bars.columns, *order)
    for f, params in custom:
        out = f(out, **params)
    return out


def _takes(name: str, parameter: str) -> bool:
    if name in MAKERS:
        return parameter in MAKERS[name].__code__.co_varnames[: MAKERS[name].__code__.co_argcount]
    if name in RECURRENCES:
        code = RECURRENCES[name][1].__code__
        return RENAMED.get(parameter, parameter) in code.co_varnames[: code.co_argcount]
    return False


def feature_matrix(bars: DataFrame, specs: list[Spec], nan_policy: str = "keep") -> DataFrame:
    """key, ts and the features; `drop` leaves out rows with a missing one, `fill` takes the last value before."""
    if nan_policy not in ("keep", "drop", "fill"):
        raise ParameterError("nan_policy is keep, drop or fill")
    made = compute_many(bars, specs)
    names = [c for c in made.columns if c not in bars.columns]
    out = made.select("key", "ts", *names)
    if nan_policy == "drop":
        return out.dropna(subset=names)
    if nan_policy == "fill":
        past = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return out.select("key", "ts", *[F.last(c, ignorenulls=True).over(past).alias(c) for c in names])
    return out


# --- chunks of long series -------------------------------------------------------------------------


def chunk_ranges(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of `size` rows, each with `overlap` rows before it."""
    if size < 1 or overlap < 0:
        raise ParameterError("size must be at least 1, overlap at least 0")
    return [(max(0, a - overlap), min(n, a + size)) for a in range(0, n, size)]


def trim_overlap(rows: list, overlap: int) -> list:
    """A chunk's own rows, in the driver's lists."""
    return rows[overlap:] if overlap > 0 else list(rows)


def batch_apply(df: DataFrame, f, columns: list[str]) -> DataFrame:
    """df with f applied to each of the columns: f takes a column (of a plan, not of values) and gives one."""
    return df.withColumns({c: f(F.col(c)) for c in columns})


def split_chunks(bars: DataFrame, size: int, overlap: int) -> DataFrame:
    """bars with chunk, and `own`, which is false for the rows that a chunk has from the one before."""
    if size < 1 or not 0 <= overlap <= size:
        raise ParameterError("size must be at least 1, overlap from 0 to size")
    chunk = F.floor(F.col("bar") / size)
    ahead = F.col("bar") % size >= size - overlap
    both = F.explode(F.when(ahead, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    return bars.withColumn("chunk", both).withColumn("own", F.col("chunk") == chunk)


def stitch_chunks(chunked: DataFrame) -> DataFrame:
    """The chunks' own rows."""
    return chunked.filter("own").drop("chunk", "own")


def chunk_apply(bars: DataFrame, stages: Stages, size: int = 10_000, overlap: int = 100) -> DataFrame:
    """Windows over chunks instead of whole keys, so that one long key is the work of many tasks.

    Exact where no window looks back further than `overlap` rows: a chunk's own rows have all that they need beside them, and the
    first chunk has what the series has.
    """
    parted = split_chunks(bars, size, overlap).withColumn("_key", F.col("key")).withColumn("key", F.struct("_key", "chunk"))
    return stitch_chunks(apply_stages(parted, stages).withColumn("key", F.col("_key")).drop("_key")).select(*bars.columns, *outputs(stages))


def register(add, src) -> None:
    from barloom.plans.recursive_sql import Query
    from barloom.plans.staged import rounded
    from barloom.workers import workers_import

    bars, BARS = src["bars"], src["BARS"]
    specs = [("SMA", {"timeperiod": 12}), ("BBANDS", {"timeperiod": 20}), "WILLR", ("RSI", {"timeperiod": 9}), ("ATR", {"timeperiod": 10}), ("EMA", {"timeperiod": 8})]
    names = ["sma", "bbands_upper", "bbands_middle", "bbands_lower", "willr", "rsi", "atr", "ema"]
    q = Query(BARS).add(g="greatest(close - lag(close) OVER w, 0)", l="greatest(lag(close) OVER w - close, 0)", tr="CASE WHEN bar = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END")
    q.wilder("a", "g", 9).wilder("b", "l", 9).wilder("atr", "tr", 10).ema("ema", "close", 8)
    past = lambda e, p: f"CASE WHEN bar >= {p - 1} THEN (SELECT {e} FROM s0 x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar) END"
    cols = {
        "sma": past("avg(x.close)", 12), "bbands_upper": past("avg(x.close) + 2 * stddev_pop(x.close)", 20), "bbands_middle": past("avg(x.close)", 20), "bbands_lower": past("avg(x.close) - 2 * stddev_pop(x.close)", 20),
        "hh": past("max(x.high)", 14), "ll": past("min(x.low)", 14), "rsi": "CASE WHEN a + b = 0 THEN 0.0 ELSE 100 * a / (a + b) END",
    }
    wide = f"WITH RECURSIVE {', '.join(q.ctes)}, f AS (SELECT *, CASE WHEN hh = ll THEN -50.0 ELSE -100 * (hh - close) / (hh - ll) END AS willr FROM (SELECT t.*, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {q.at} t))"
    shown = ", ".join(f"{fixed(c)} AS {c}" for c in names)
    for policy, sql in (("keep", f"{wide} SELECT key, ts, {shown} FROM f"), ("drop", f"{wide} SELECT key, ts, {shown} FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in names)}")):

        def run(s, d, policy=policy):
            workers_import(s)
            return feature_matrix(bars(s, d), specs, policy).selectExpr("key", "ts", *rounded(names))

        add(f"feature_matrix_{policy}", run, sql)
    chunked = [*W_.sma(p=30), *_renamed(W_.stoch(), 1, {"slowk": "slowk", "slowd": "slowd"})]
    k = "CASE WHEN bar >= 4 THEN CASE WHEN hi = lo THEN 0.0 ELSE 100 * (close - lo) / (hi - lo) END END"
    frame = lambda e, t, p: f"(SELECT {e} FROM {t} x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar)"
    add("ind_chunked", lambda s, d: chunk_apply(bars(s, d), chunked, 100, 40).selectExpr("key", "ts", *rounded(["sma", "slowk", "slowd"])),
        f"""WITH b AS MATERIALIZED ({BARS}), k AS MATERIALIZED (SELECT *, {k} AS k FROM (SELECT *, {frame('max(x.high)', 'b', 5)} AS hi, {frame('min(x.low)', 'b', 5)} AS lo FROM b t)),
 s AS MATERIALIZED (SELECT *, CASE WHEN bar >= 6 THEN {frame('avg(x.k)', 'k', 3)} END AS s, CASE WHEN bar >= 29 THEN {frame('avg(x.close)', 'k', 30)} END AS sma FROM k t),
 d AS (SELECT *, CASE WHEN bar >= 8 THEN {frame('avg(x.s)', 's', 3)} END AS d FROM s t) SELECT key, ts, {fixed('sma')} AS sma, {fixed('CASE WHEN d IS NOT NULL THEN s END')} AS slowk, {fixed('d')} AS slowd FROM d""")  # fmt: skip
