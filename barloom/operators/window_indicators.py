"""Indicators with a bounded or cumulative look-back: each is a list of stages of SQL expressions over windows.

A stage is a dict of columns that may use those of earlier stages; columns that start with an underscore are dropped at
the end. All windows of an indicator share one partitioning and order, so a chain of stages costs one shuffle and one sort.
"""

from __future__ import annotations

from barloom.plans.frames import CUM, L, W, agg, before, div, full, lag, wma

Stages = list[dict[str, str]]
TP = "(high + low + close) / 3"


def sma(x="close", p=30, out="sma") -> Stages:
    return [{out: agg("avg", x, p)}]


def trima(p=30) -> Stages:
    """Triangular weights are those of an average of averages."""
    inner = (p + 1) // 2
    return [{"_a": agg("avg", "close", inner)}, {"trima": agg("avg", "_a", p + 1 - inner)}]


def bbands(p=5, up=2.0, down=2.0) -> Stages:
    return [{"_m": agg("avg", "close", p), "_s": agg("stddev_pop", "close", p)}, {"upper": f"_m + {up} * _s", "middle": "_m", "lower": f"_m - {down} * _s"}]


def frame(x: str, p: int) -> str:
    """The last p values as an array, the newest last."""
    return f"collect_list({x}) {W(p)}"


def mavp(lo=2, hi=30) -> Stages:
    period = f"greatest({lo}, least({hi}, cast(round(periods) AS INT)))"
    total = f"aggregate(slice(_v, {hi + 1} - _p, _p), 0D, (a, v) -> a + v)"
    return [{"_p": period, "_v": frame("close", hi)}, {"mavp": f"CASE WHEN size(_v) = {hi} THEN {total} / _p END"}]


def roc(kind: str, p=10) -> Stages:
    prev = lag("close", p)
    e = {"roc": f"100 * {div(f'close - {prev}', prev)}", "rocp": div(f"close - {prev}", prev), "rocr": div("close", prev), "rocr100": f"100 * {div('close', prev)}"}[kind]
    return [{kind: e}]


def willr(p=14) -> Stages:
    return [{"_h": agg("max", "high", p), "_l": agg("min", "low", p)}, {"willr": "CASE WHEN _h = _l THEN -50.0 ELSE -100 * (_h - close) / (_h - _l) END"}]


def aroon(p=14, osc=False) -> Stages:
    n = p + 1
    at = {"_u": f"{{maxat:high:{n}}}", "_d": f"{{minat:low:{n}}}", "_n": f"count(high) {W(n)}"}
    up, down = (f"CASE WHEN _n = {n} THEN 100.0 * ({x} - (bar - {p})) / {p} END" for x in ("_u", "_d"))
    return [at, {"aroonosc": f"({up}) - ({down})"} if osc else {"aroon_down": down, "aroon_up": up}]


def extreme_at(kind: str, p=30) -> Stages:
    """MAXINDEX and MININDEX: the latest bar of the extreme, -1 until p bars are there."""
    macro, out = ("maxat", "maxindex") if kind == "max" else ("minat", "minindex")
    return [{"_i": f"{{{macro}:close:{p}}}", "_n": f"count(close) {W(p)}"}, {out: f"CASE WHEN _n = {p} THEN _i ELSE -1 END"}]


def cci(p=14) -> Stages:
    mad = f"aggregate(_v, 0D, (a, v) -> a + abs(v - _m)) / {p}"
    return [{"_tp": TP}, {"_m": agg("avg", "_tp", p), "_v": frame("_tp", p)}, {"_mad": f"CASE WHEN _m IS NOT NULL THEN {mad} END"}, {"cci": "CASE WHEN _mad = 0 THEN 0.0 ELSE (_tp - _m) / (0.015 * _mad) END"}]


def mfi(p=14) -> Stages:
    return [
        {"_tp": TP}, {"_d": f"_tp - {lag('_tp')}", "_f": "_tp * volume"},
        {"_p": "CASE WHEN _d > 0 THEN _f WHEN _d IS NOT NULL THEN 0.0 END", "_q": "CASE WHEN _d < 0 THEN _f WHEN _d IS NOT NULL THEN 0.0 END"},
        {"_a": agg("sum", "_p", p), "_b": agg("sum", "_q", p)}, {"mfi": "CASE WHEN _a + _b = 0 THEN 0.0 ELSE 100 * _a / (_a + _b) END"},
    ]


def stoch(k=5, slow=3, d=3, names=("slowk", "slowd"), source=("high", "low", "close")) -> Stages:
    h, l, c = source
    return [
        {"_h": agg("max", h, k), "_l": agg("min", l, k)}, {"_k": f"CASE WHEN _h = _l THEN 0.0 ELSE 100 * ({c} - _l) / (_h - _l) END"},
        {"_s": agg("avg", "_k", slow)}, {"_d": agg("avg", "_s", d)}, {names[0]: "CASE WHEN _d IS NOT NULL THEN _s END", names[1]: "_d"},
    ]


def ultosc(a=7, b=14, c=28) -> Stages:
    pc = lag("close")
    parts = {f"_{n}{p}": agg("sum", f"_{n}", p) for p in (a, b, c) for n in ("bp", "tr")}
    avgs = [f"CASE WHEN _tr{p} = 0 THEN 0.0 ELSE _bp{p} / _tr{p} END" for p in (a, b, c)]
    most = max(a, b, c)
    return [
        {"_pc": pc}, {"_bp": "CASE WHEN _pc IS NOT NULL THEN close - least(low, _pc) END", "_tr": "CASE WHEN _pc IS NOT NULL THEN greatest(high, _pc) - least(low, _pc) END"},
        parts, {"ultosc": f"CASE WHEN bar >= {most} THEN 100 * (4 * ({avgs[0]}) + 2 * ({avgs[1]}) + ({avgs[2]})) / 7 END"},
    ]


def trange(out="trange") -> Stages:
    return [{"_pc": lag("close")}, {out: "greatest(high - low, abs(high - _pc), abs(low - _pc))"}]


def obv() -> Stages:
    return [{"_d": f"close - {lag('close')}"}, {"_v": "CASE WHEN _d > 0 THEN volume WHEN _d < 0 THEN -volume ELSE 0.0 END"}, {"obv": f"sum(_v) {CUM}"}]


def ad() -> Stages:
    return [{"_c": "CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) * volume END"}, {"ad": f"sum(_c) {CUM}"}]


def linear(kind: str, p=14) -> Stages:
    """Least squares over p bars with x = 0..p-1."""
    fit = {"_b": full("close", p, f"regr_slope(close, bar) {W(p)}" if p > 1 else "0.0"), "_m": agg("avg", "close", p)}
    e = {"linearreg": f"_m + _b * {(p - 1) / 2}", "linearreg_slope": "_b", "linearreg_intercept": f"_m - _b * {(p - 1) / 2}", "linearreg_angle": "degrees(atan(_b))", "tsf": f"_m + _b * {(p + 1) / 2}"}[kind]
    return [fit, {kind: e}]


def beta(p=5) -> Stages:
    rets = {"_r0": f"{div('real0', lag('real0'))} - 1", "_r1": f"{div('real1', lag('real1'))} - 1"}
    return [rets, {"_v": full("_r0", p, f"var_pop(_r0) {W(p)}"), "_c": full("_r0", p, f"covar_pop(_r1, _r0) {W(p)}")}, {"beta": div("_c", "_v")}]


def correl(p=30) -> Stages:
    return [{"_a": agg("stddev_pop", "real0", p), "_b": agg("stddev_pop", "real1", p), "_c": full("real0", p, f"covar_pop(real0, real1) {W(p)}")}, {"correl": div("_c", "_a * _b")}]


def vwap(p=0) -> Stages:
    w = CUM if p == 0 else W(p)
    got = {"_a": f"sum({TP} * volume) {w}", "_b": f"sum(volume) {w}", "_n": f"count(close) {w}"}
    return [got, {"vwap": f"CASE WHEN _n >= {max(p, 1)} THEN {div('_a', '_b')} END"}]


def ichimoku(t=9, k=26, b=52, shift=26) -> Stages:
    mid = {f"_{n}": f"({agg('max', 'high', p)} + {agg('min', 'low', p)}) / 2" for n, p in (("t", t), ("k", k), ("b", b))}
    return [mid, {"_a": "(_t + _k) / 2"}, {"tenkan": "_t", "kijun": "_k", "senkou_a": lag("_a", shift), "senkou_b": lag("_b", shift), "chikou": lag("close", -shift)}]


def donchian(p=20) -> Stages:
    return [{"_u": agg("max", "high", p), "_l": agg("min", "low", p)}, {"upper": "_u", "middle": "(_u + _l) / 2", "lower": "_l"}]


def pivots(method="classic") -> Stages:
    prev = {"_h": lag("high"), "_l": lag("low"), "_c": lag("close")}
    p = {"_p": "(_h + _l + _c) / 3", "_r": "_h - _l"}
    levels = {
        "classic": ("2 * _p - _l", "2 * _p - _h", "_p + _r", "_p - _r"),
        "fibonacci": ("_p + 0.382 * _r", "_p - 0.382 * _r", "_p + 0.618 * _r", "_p - 0.618 * _r"),
        "camarilla": ("_c + _r * 1.1 / 12", "_c - _r * 1.1 / 12", "_c + _r * 1.1 / 6", "_c - _r * 1.1 / 6"),
    }
    if method not in levels:
        raise ValueError(f"unknown pivot method: {method}")
    return [prev, p, {"pp": "_p", **dict(zip(("r1", "s1", "r2", "s2"), levels[method], strict=True))}]


def hull(p=16) -> Stages:
    half, root = p // 2, max(1, round(p**0.5))
    return [{"_a": wma("close", half), "_b": wma("close", p)}, {"_x": "2 * _a - _b"}, {"hull_ma": wma("_x", root)}]


def vwma(p=20) -> Stages:
    return [{"_a": agg("sum", "close * volume", p), "_b": agg("sum", "volume", p)}, {"vwma": div("_a", "_b")}]


def choppiness(p=14) -> Stages:
    import math

    rng = "(_h - _l)"
    return [
        *trange("_tr"), {"_s": f"sum(_tr) {W(p)}", "_h": agg("max", "high", p), "_l": agg("min", "low", p)},
        {"choppiness": f"CASE WHEN bar >= {p} AND {rng} > 0 AND _s > 0 THEN 100 * log10(_s / nullif({rng}, 0)) / {math.log10(p)} END"},
    ]


def zscore(p=20) -> Stages:
    return [{"_m": agg("avg", "close", p), "_s": agg("stddev_pop", "close", p)}, {"zscore": div("close - _m", "_s")}]


def variance_break(short=10, long=30, threshold=2.0) -> Stages:
    return [
        {"_r": f"close - {lag('close')}"},
        {"_a": f"var_samp(close) {before(short)}", "_b": f"var_samp(close) {before(long)}", "_n": f"count(close) {before(long)}"},
        {"variance_break": f"CASE WHEN _n = {long} AND _b > 0 AND _a / nullif(_b, 0) > {threshold} THEN 1 ELSE 0 END"},
    ]


def cross(fast=5, slow=20) -> Stages:
    pf, ps = lag("_f"), lag("_s")
    return [{"_f": agg("avg", "close", fast), "_s": agg("avg", "close", slow)}, {"_pf": pf, "_ps": ps}, {"crossing": "CASE WHEN _pf <= _ps AND _f > _s THEN 1 WHEN _pf >= _ps AND _f < _s THEN -1 ELSE 0 END"}]


def threshold(level: str, up=True) -> Stages:
    test = f"_p <= {level} AND close > {level}" if up else f"_p >= {level} AND close < {level}"
    return [{"_p": lag("close")}, {"alert": f"CASE WHEN {test} THEN 1 ELSE 0 END"}]


def realized(kind: str, w=20, days=252.0) -> Stages:
    """Annualized volatility estimators over w bars."""
    import math

    u, d, c = "ln(high / open)", "ln(low / open)", "ln(close / open)"
    root = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN sqrt(greatest(0.0, ({e}) * {days})) END"  # noqa: E731  greatest passes over NULL
    if kind == "close_to_close":
        return [{"_pc": lag("close")}, {"_r": "ln(close / nullif(_pc, 0))"}, {"_q": agg("sum", "_r * _r", w)}, {kind: root(f"_q / {w}")}]
    if kind == "parkinson":
        return [{"_q": agg("sum", "ln(high / low) * ln(high / low)", w)}, {kind: root(f"_q / {4 * math.log(2) * w}")}]
    if kind == "garman_klass":
        return [{"_x": f"0.5 * ({u} - {d}) * ({u} - {d}) - {2 * math.log(2) - 1} * {c} * {c}"}, {"_q": agg("avg", "_x", w)}, {kind: root("_q")}]
    if kind == "rogers_satchell":
        return [{"_x": f"{u} * ({u} - {c}) + {d} * ({d} - {c})"}, {"_q": agg("avg", "_x", w)}, {kind: root("_q")}]
    k = 0.34 / (1.34 + (w + 1) / (w - 1))
    return [
        {"_pc": lag("close")}, {"_o": "ln(open / nullif(_pc, 0))", "_c": c, "_x": f"{u} * ({u} - {c}) + {d} * ({d} - {c})"},
        {"_vo": agg("var_samp", "_o", w), "_vc": full("_o", w, f"var_samp(_c) {W(w)}"), "_rs": full("_o", w, f"avg(_x) {W(w)}")},
        {kind: root(f"_vo + {k} * _vc + {1 - k} * _rs")},
    ]


def iv_rank(w=20) -> Stages:
    return [{"_h": agg("max", "close", w), "_l": agg("min", "close", w)}, {"iv_rank": "CASE WHEN _h = _l THEN 0.0 ELSE (close - _l) / (_h - _l) END"}]


def iv_percentile(w=20) -> Stages:
    return [{"_v": frame("close", w)}, {"iv_percentile": f"CASE WHEN size(_v) = {w} THEN size(filter(_v, v -> v <= close)) / {float(w)} END"}]


# What each takes from a series, beside the stages.
INDICATORS: dict[str, Stages] = {
    "SMA": sma(p=30), "WMA": [{"wma": wma("close", 30)}], "TRIMA": trima(), "BBANDS": bbands(), "MA": sma(p=30, out="ma"), "MAVP": mavp(),
    "MIDPOINT": [{"midpoint": f"({agg('max', 'close', 14)} + {agg('min', 'close', 14)}) / 2"}],
    "MIDPRICE": [{"midprice": f"({agg('max', 'high', 14)} + {agg('min', 'low', 14)}) / 2"}],
    "MOM": [{"mom": f"close - {lag('close', 10)}"}], "ROC": roc("roc"), "ROCP": roc("rocp"), "ROCR": roc("rocr"), "ROCR100": roc("rocr100"),
    "WILLR": willr(), "AROON": aroon(), "AROONOSC": aroon(osc=True), "CCI": cci(), "MFI": mfi(),
    "BOP": [{"bop": "CASE WHEN high = low THEN 0.0 ELSE (close - open) / (high - low) END"}],
    "STOCH": stoch(), "STOCHF": stoch(5, 1, 3, ("fastk", "fastd")), "ULTOSC": ultosc(), "TRANGE": trange(), "AD": ad(), "OBV": obv(),
    "STDDEV": [{"stddev": agg("stddev_pop", "close", 5)}], "VAR": [{"var": agg("var_pop", "close", 5)}],
    "LINEARREG": linear("linearreg"), "LINEARREG_SLOPE": linear("linearreg_slope"), "LINEARREG_INTERCEPT": linear("linearreg_intercept"), "LINEARREG_ANGLE": linear("linearreg_angle"), "TSF": linear("tsf"),
    "BETA": beta(), "CORREL": correl(),
    "AVGPRICE": [{"avgprice": "(open + high + low + close) / 4"}], "MEDPRICE": [{"medprice": "(high + low) / 2"}], "TYPPRICE": [{"typprice": TP}], "WCLPRICE": [{"wclprice": "(high + low + 2 * close) / 4"}],
    "VWAP": vwap(), "VWAP_ROLLING": vwap(20), "ICHIMOKU": ichimoku(), "DONCHIAN": donchian(), "PIVOT_CLASSIC": pivots(), "PIVOT_FIBONACCI": pivots("fibonacci"), "PIVOT_CAMARILLA": pivots("camarilla"),
    "HULL_MA": hull(), "VWMA": vwma(), "CHOPPINESS_INDEX": choppiness(),
    "ADD": [{"add": "high + low"}], "SUB": [{"sub": "high - low"}], "MULT": [{"mult": "high * low"}], "DIV": [{"div": div("high", "low")}],
    "SUM": [{"sum": agg("sum", "close", 30)}], "MAX": [{"max": agg("max", "close", 30)}], "MIN": [{"min": agg("min", "close", 30)}],
    "MAXINDEX": extreme_at("max"), "MININDEX": extreme_at("min"),
    "MATH_TRANSFORMS": [
        {"_x": "close / (close + 1000)"}, {"acos": "acos(least(1.0, _x))", "asin": "asin(least(1.0, _x))", "atan": "atan(_x)", "ceil": "cast(ceil(close) AS DOUBLE)", "cos": "cos(_x)", "cosh": "cosh(_x)", "exp": "exp(_x)",
                                 "floor": "cast(floor(close) AS DOUBLE)", "ln": "ln(close)", "log10": "log10(close)", "sin": "sin(_x)", "sinh": "sinh(_x)", "sqrt": "sqrt(close)", "tan": "tan(_x)", "tanh": "tanh(_x)"},
    ],
    "ZSCORE": zscore(), "VARIANCE_BREAK": variance_break(), "CHECK_CROSS": cross(), "CHECK_THRESHOLD": threshold("1500"),
    "CLOSE_TO_CLOSE_VOL": realized("close_to_close"), "PARKINSON_VOL": realized("parkinson"), "GARMAN_KLASS_VOL": realized("garman_klass"), "ROGERS_SATCHELL_VOL": realized("rogers_satchell"), "YANG_ZHANG_VOL": realized("yang_zhang"),
    "IV_RANK": iv_rank(), "IV_PERCENTILE": iv_percentile(), "IV_ZSCORE": [{"_m": agg("avg", "close", 20), "_s": agg("stddev_pop", "close", 20)}, {"iv_zscore": div("close - _m", "_s")}],
    "DRAWDOWN": [{"_m": f"max(close) {CUM}"}, {"drawdown": div("close - _m", "_m")}],
    "FORWARD_FILL": [{"_x": "CASE WHEN bar % 3 = 1 THEN NULL ELSE close END"}, {"_g": f"count(_x) {CUM}"}, {"filled": f"max(_x) OVER (PARTITION BY key, _g)"}],
    "FUNDING_PNL": [{"funding_pnl": f"sum(-volume * (close / open - 1)) {CUM}"}],
    "SESSION_BOUNDARY": [{"session_start": f"CASE WHEN lag(ts) {L} IS NULL OR cast(lag(ts) {L} AS DATE) <> cast(ts AS DATE) THEN 1 ELSE 0 END"}],
    "SMA_CROSSOVER_SIGNAL": [{"_f": agg("avg", "close", 10), "_s": agg("avg", "close", 30)}, {"signal": "CASE WHEN _f IS NULL OR _s IS NULL THEN NULL WHEN _f > _s THEN 1 ELSE -1 END"}],
}
