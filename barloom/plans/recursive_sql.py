"""The recurrences as SQL for an engine with recursive queries, to hold the operators' results against."""

from __future__ import annotations

import re

from barloom.plans.frames import DIGITS, fixed

GAIN, LOSS = "greatest(close - lag(close) OVER w, 0)", "greatest(lag(close) OVER w - close, 0)"


class Query:
    """A chain of common tables; each recurrence adds one and a column."""

    def __init__(self, bars: str):
        self.ctes, self.at, self.n = [f"s0 AS MATERIALIZED ({bars})"], "s0", 0

    def add(self, **cols: str) -> Query:
        self.n += 1
        items = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        self.ctes.append(f"s{self.n} AS MATERIALIZED (SELECT *, {items} FROM {self.at} WINDOW w AS (PARTITION BY key ORDER BY bar))")
        self.at = f"s{self.n}"
        return self

    def follow(self, out: str, x: str, first: int, count: int, a: float, b: float, seed: str = "avg", extra: str = "") -> Query:
        """out = seed(x over `count` bars from `first`) at their last, then a * out + b * x."""
        self.n += 1
        r, last = f"r{self.n}", first + count - 1
        step = extra or f"{a!r} * r.v + {b!r} * b.{x}"
        self.ctes.append(
            f"{r}(key, bar, v) AS (SELECT key, {last}, {seed}({x}) FROM {self.at} WHERE bar BETWEEN {first} AND {last} GROUP BY key HAVING count(*) = {count} "
            f"UNION ALL SELECT b.key, b.bar, {step} FROM {r} r JOIN {self.at} b ON b.key = r.key AND b.bar = r.bar + 1)"
        )
        self.ctes.append(f"s{self.n} AS MATERIALIZED (SELECT t.*, r.v AS {out} FROM {self.at} t LEFT JOIN {r} r ON r.key = t.key AND r.bar = t.bar)")
        self.at = f"s{self.n}"
        return self

    def ema(self, out: str, x: str, p: int, first: int = 0) -> Query:
        k = 2 / (p + 1)
        return self.follow(out, x, first, p, 1 - k, k)

    def wilder(self, out: str, x: str, p: int, first: int = 1) -> Query:
        return self.follow(out, x, first, p, (p - 1) / p, 1 / p)

    def wsum(self, out: str, x: str, p: int, n: int) -> Query:
        return self.follow(out, x, 1, n, (p - 1) / p, 1.0, seed="sum")

    def select(self, **cols: str) -> str:
        items = ", ".join(f"{fixed(e, DIGITS.get(c, 4))} AS {c}" for c, e in cols.items())
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT key, ts, {items} FROM {self.at}"


TR = "CASE WHEN bar = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"
UP, DOWN = "high - lag(high) OVER w", "lag(low) OVER w - low"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


def _family(q: Query, p: int = 14) -> Query:
    q.add(tr=TR, up=UP, down=DOWN).add(pm="CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END", mm="CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END")
    q.wsum("a", "tr", p, p).wsum("b", "pm", p, p).wsum("c", "mm", p, p)
    q.add(plus_di="100 * b / nullif(a, 0)", minus_di="100 * c / nullif(a, 0)").add(dx=f"100 * ({_share('abs(plus_di - minus_di)', 'plus_di + minus_di')})")
    q.wilder("adx", "dx", p, p)
    return q.add(adxr=f"(adx + lag(adx, {p - 1}) OVER w) / 2").wsum("plus_dm", "pm", p, p - 1).wsum("minus_dm", "mm", p, p - 1)


def _nested(base: str, *stages: dict[str, str]) -> str:
    for st in stages:
        base = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in st.items())} FROM ({base})"
    return base


def machine(rows: str, state: dict[str, tuple[str, str]], start: str, *stages: dict[str, str]) -> str:
    """Common tables b and r: state by name (first value, next value) from the bar `start` on; stages see the state and the next bar's columns."""
    first = ", ".join(v[0] for v in state.values())
    step = _nested(f"SELECT r.{', r.'.join(state)}, b.* FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1", *stages)
    return f"b AS MATERIALIZED ({rows}), r(key, bar, {', '.join(state)}) AS (SELECT key, bar, {first} FROM b WHERE bar = {start} UNION ALL SELECT key, bar, {', '.join(v[1] for v in state.values())} FROM ({step}))"


def _out(ctes: str, **cols: str) -> str:
    items = ", ".join(f"{fixed(e, DIGITS.get(c, 4))} AS {c}" for c, e in cols.items())
    return f"WITH RECURSIVE {ctes} SELECT b.key, b.ts, {items} FROM b LEFT JOIN r ON r.key = b.key AND r.bar = b.bar"


def sar_sql(bars: str, name: str) -> str:
    """The stop in the units of its side: short legs are long legs of mirrored prices."""
    rows = f"SELECT *, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM ({bars}) WINDOW w AS (PARTITION BY key ORDER BY bar)"
    ahead, behind = "CASE WHEN {0} > 0 THEN high ELSE -low END", "CASE WHEN {0} > 0 THEN low{1} ELSE -high{1} END"
    old = lambda k: f"CASE WHEN side > 0 THEN l{k} ELSE -h{k} END"
    state = {
        "side": ("CASE WHEN high >= h1 THEN 1 ELSE -1 END", "nside"), "stop": ("CASE WHEN high >= h1 THEN l1 ELSE -h1 END", "nstop"),
        "best": ("CASE WHEN high >= h1 THEN high ELSE -low END", "nbest"), "pace": ("0.02::DOUBLE", "npace"),
    }
    ctes = machine(
        rows, state, "1", {"s": f"least(stop + pace * (best - stop), {old(1)}, {old(2)})", "now": behind.format("side", "")}, {"turn": "now < s"},
        {"nside": "CASE WHEN turn THEN -side ELSE side END", "nstop": "CASE WHEN turn THEN -best ELSE s END", "far": ahead.format("CASE WHEN turn THEN -side ELSE side END")},
        {"nbest": "CASE WHEN turn THEN far ELSE greatest(best, far) END", "npace": "CASE WHEN turn THEN 0.02 WHEN far > best THEN least(pace + 0.02, 0.2) ELSE pace END"},
    )
    return _out(ctes, **{name: "r.side * r.stop"})


def supertrend_sql(bars: str, p: int = 7, m: float = 3.0) -> str:
    q = Query(bars).add(tr=TR).wilder("a", "tr", p, 0)
    rows = f"SELECT *, (high + low) / 2 + {m} * a AS u, (high + low) / 2 - {m} * a AS d, lag(close) OVER (PARTITION BY key ORDER BY bar) AS c1 FROM {q.at}"
    state = {"up": ("u", "nup"), "down": ("d", "ndown"), "way": ("-1", "nway")}
    ctes = machine(rows, state, str(p - 1), {"nup": "CASE WHEN u < up OR c1 > up THEN u ELSE up END", "ndown": "CASE WHEN d > down OR c1 < down THEN d ELSE down END"},
                   {"nway": "CASE WHEN way < 0 THEN CASE WHEN close > nup THEN 1 ELSE -1 END ELSE CASE WHEN close < ndown THEN -1 ELSE 1 END END"})
    return _out(f"{', '.join(q.ctes)}, {ctes}", line=f"CASE WHEN b.bar >= {p} THEN CASE WHEN r.way > 0 THEN r.down ELSE r.up END END", direction=f"CASE WHEN b.bar >= {p} THEN cast(r.way AS DOUBLE) ELSE 0.0 END")


def cusum_sql(bars: str, w: int = 20, limit: float = 3.0, slack: float = 0.5) -> str:
    before = f"OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    rows = f"SELECT *, (close - avg(close) {before}) / nullif(stddev_samp(close) {before}, 0) AS z FROM ({bars})"
    state = {"up": ("0.0::DOUBLE", "CASE WHEN hit THEN 0.0 ELSE u END"), "down": ("0.0::DOUBLE", "CASE WHEN hit THEN 0.0 ELSE d END"), "brk": ("false", "hit")}
    ctes = machine(rows, state, str(w - 1), {"u": f"CASE WHEN z IS NULL THEN up ELSE greatest(0.0, up + z - {slack}) END", "d": f"CASE WHEN z IS NULL THEN down ELSE greatest(0.0, down - z - {slack}) END"}, {"hit": f"u > {limit} OR d > {limit}"})
    return _out(ctes, **{"break": "CASE WHEN r.brk THEN 1.0 ELSE 0.0 END"})


def cycles_sql(bars: str, floor: float | None) -> str:
    """Common tables of the quadrature filter, with its last seven values as lists; floor: the least period to go on from (the adaptive average's)."""
    win = "OVER (PARTITION BY key ORDER BY bar)"
    fir = lambda x: f"(0.0962 * {x}[7] + 0.5769 * {x}[5] - 0.5769 * {x}[3] - 0.0962 * {x}[1])"
    smooth = f"CASE WHEN bar >= 3 THEN (4 * close + 3 * lag(close) {win} + 2 * lag(close, 2) {win} + lag(close, 3) {win}) / 10 ELSE close END"
    rows = f"SELECT *, 0.0962 * sm + 0.5769 * lag(sm, 2) {win} - 0.5769 * lag(sm, 4) {win} - 0.0962 * lag(sm, 6) {win} AS f0 FROM (SELECT *, {smooth} AS sm FROM ({bars}))"
    zeros = "[0.0::DOUBLE, 0, 0, 0, 0, 0, 0]"
    zero = "0.0::DOUBLE"
    state = {
        "det": (zeros, "det1"), "quad": (zeros, "quad1"), "inn": (zeros, "inn1"), "i2": (zero, "i2n"), "q2": (zero, "q2n"), "re": (zero, "ren"), "im": (zero, "imn"), "per": (zero, "pern"),
        "sp": (zero, "0.33 * pern + 0.67 * sp"), "ph": (zero, "phn"), "ma": ("close", "man"), "fa": ("close", "fan"),
    }
    p0 = "per" if floor is None else f"greatest(per, {floor!r})"
    push = lambda x, new: f"list_append({x}[2:7], {new})"
    change = "CASE WHEN p0 > 0 THEN greatest(0.67 * p0, least(1.5 * p0, raw)) ELSE raw END"
    ctes = machine(
        rows, state, "5", {"p0": p0}, {"gain": "0.075 * p0 + 0.54"}, {"det1": push("det", "f0 * gain")},
        {"quad1": push("quad", f"CASE WHEN bar >= 12 THEN {fir('det1')} * gain ELSE 0 END"), "inn1": push("inn", "CASE WHEN bar >= 9 THEN det1[4] ELSE 0 END")},
        {"ji": f"CASE WHEN bar >= 15 THEN {fir('inn1')} * gain ELSE 0 END", "jq": f"CASE WHEN bar >= 18 THEN {fir('quad1')} * gain ELSE 0 END", "a": "inn1[7]", "c": "quad1[7]"},
        {"i2n": "0.2 * (a - jq) + 0.8 * i2", "q2n": "0.2 * (c + ji) + 0.8 * q2"}, {"ren": "0.2 * (i2n * i2 + q2n * q2) + 0.8 * re", "imn": "0.2 * (i2n * q2 - q2n * i2) + 0.8 * im"},
        {"raw": "CASE WHEN ren > 0 AND imn <> 0 THEN 2 * pi() / atan(imn / ren) ELSE p0 END"}, {"pern": f"0.2 * greatest(6.0, least(50.0, {change})) + 0.8 * p0", "phn": "CASE WHEN a <> 0 THEN degrees(atan2(c, a)) ELSE 90.0 * sign(c) END"},
        {"alpha": "greatest(0.05, least(0.5, 0.5 / greatest(1.0, ph - phn)))"}, {"man": "CASE WHEN bar < 32 THEN close ELSE alpha * close + (1 - alpha) * ma END"},
        {"fan": "CASE WHEN bar < 32 THEN close ELSE 0.5 * alpha * man + (1 - 0.5 * alpha) * fa END"},
    )
    return ctes


def recursive_sql(bars: str) -> dict[str, str]:
    new = lambda: Query(bars)
    out = {
        "EMA": new().ema("e", "close", 30).select(ema="e"),
        "DEMA": new().ema("e", "close", 30).ema("f", "e", 30, 29).select(dema="2 * e - f"),
        "TEMA": new().ema("e", "close", 30).ema("f", "e", 30, 29).ema("g", "f", 30, 58).select(tema="3 * e - 3 * f + g"),
        "TRIX": new().ema("e", "close", 30).ema("f", "e", 30, 29).ema("g", "f", 30, 58).add(h="lag(g) OVER w").select(trix=f"100 * ({_share('g - h', 'h')})"),
        "APO": new().ema("f", "close", 12).ema("s", "close", 26).select(apo="f - s"),
        "RSI": new().add(g=GAIN, l=LOSS).wilder("a", "g", 14).wilder("b", "l", 14).select(rsi=f"100 * ({_share('a', 'a + b')})"),
        "CMO": new().add(g=GAIN, l=LOSS).wilder("a", "g", 14).wilder("b", "l", 14).select(cmo=f"100 * ({_share('a - b', 'a + b')})"),
        "ATR": new().add(tr=TR).wilder("a", "tr", 14).select(atr="a"),
        "NATR": new().add(tr=TR).wilder("a", "tr", 14).select(natr="100 * a / nullif(close, 0)"),
        "KELTNER_CHANNELS": new().add(tr=TR).wilder("a", "tr", 10, 0).ema("m", "close", 20).select(upper="m + 2.0 * a", middle="m", lower="m - 2.0 * a"),
        "CHANDELIER_EXIT": new().add(tr=TR, hh="CASE WHEN bar >= 21 THEN max(high) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) END", ll="CASE WHEN bar >= 21 THEN min(low) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) END").wilder("a", "tr", 22, 0).select(long_exit="hh - 3.0 * a", short_exit="ll + 3.0 * a"),
        "ADOSC": new().add(x="CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) * volume END").add(ad="sum(x) OVER (PARTITION BY key ORDER BY bar)").follow("f", "ad", 0, 1, 0.5, 0.5).follow("s", "ad", 0, 1, 1 - 2 / 11, 2 / 11).select(adosc="CASE WHEN bar >= 9 THEN f - s END"),
        "STOCHRSI": new().add(g=GAIN, l=LOSS).wilder("a", "g", 14).wilder("b", "l", 14).add(r=f"100 * ({_share('a', 'a + b')})")
        .add(hi="CASE WHEN bar >= 18 THEN max(r) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END", lo="min(r) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
        .add(k=f"100 * ({_share('r - lo', 'hi - lo')})").add(d="CASE WHEN bar >= 20 THEN avg(k) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END").select(fastk="CASE WHEN d IS NOT NULL THEN k END", fastd="d"),
        "KAMA": new().add(d="abs(close - lag(close) OVER w)").add(path="sum(d) OVER (PARTITION BY key ORDER BY bar ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", old="lag(close, 30) OVER w")
        .add(k="power(coalesce(abs(close - old) / nullif(path, 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)").follow("v", "close", 29, 1, 0, 0, extra="r.v + b.k * (b.close - r.v)").select(kama="v"),
        "REGIME_ADX": _family(new()).select(regime="CASE WHEN adx IS NULL THEN -1.0 WHEN adx > 25 THEN 1.0 ELSE 0.0 END"),
    }
    for name, first in (("MACD", "f - s"), ("MACDFIX", "f - s"), ("PPO", f"100 * ({_share('f - s', 's')})")):
        q = new().ema("f", "close", 12).ema("s", "close", 26).add(m=first).ema("sig", "m", 9, 25)
        line = "ppo" if name == "PPO" else "macd"
        out[name] = q.select(**{line: "CASE WHEN sig IS NOT NULL THEN m END", "signal": "sig", "hist": "m - sig"})
    out["MACDEXT"] = out["MACD"]  # with exponential averages it is the plain one
    q = new()
    for i in range(6):
        q.follow(f"e{i + 1}", f"e{i}" if i else "close", 0, 1, 1 - 1 / 3, 1 / 3)
    v = 0.7
    out["T3"] = q.select(t3=f"CASE WHEN bar >= 24 THEN {-(v**3)} * e6 + {3 * v**2 + 3 * v**3} * e5 + {-6 * v**2 - 3 * v - 3 * v**3} * e4 + {1 + 3 * v + v**3 + 3 * v**2} * e3 END")
    out |= {"SAR": sar_sql(bars, "sar"), "SAREXT": sar_sql(bars, "sarext"), "SUPERTREND": supertrend_sql(bars), "CUSUM_BREAKS": cusum_sql(bars)}
    out["MAMA"] = _out(cycles_sql(bars, 1.0), mama="CASE WHEN b.bar >= 32 THEN r.ma END", fama="CASE WHEN b.bar >= 32 THEN r.fa END")
    cycle, late = cycles_sql(bars, None), "b.bar >= 63"
    out |= {
        "HT_DCPERIOD": _out(cycle, ht_dcperiod=f"CASE WHEN {late} THEN r.sp END"), "HT_DCPHASE": _out(cycle, ht_dcphase=f"CASE WHEN {late} THEN r.ph END"),
        "HT_PHASOR": _out(cycle, inphase=f"CASE WHEN {late} THEN r.inn[7] END", quadrature=f"CASE WHEN {late} THEN r.quad[7] END"),
        "HT_SINE": _out(cycle, sine=f"CASE WHEN {late} THEN sin(radians(r.ph)) END", leadsine=f"CASE WHEN {late} THEN sin(radians(r.ph + 45)) END"),
        "HT_TRENDMODE": _out(cycle, ht_trendmode=f"CASE WHEN {late} AND r.sp < 20 THEN 1.0 ELSE 0.0 END"),
        "HT_TRENDLINE": _out(cycle, ht_trendline=f"CASE WHEN {late} THEN (SELECT avg(x.sm) FROM b x WHERE x.key = b.key AND x.bar > b.bar - greatest(1, least(round(r.sp), b.bar + 1)) AND x.bar <= b.bar) END"),
    }
    frame = lambda e, p: f"(SELECT {e} FROM s0 x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar)"
    tri = f"WITH s0 AS MATERIALIZED ({bars}), h AS MATERIALIZED (SELECT t.*, CASE WHEN bar >= 14 THEN {frame('avg(x.close)', 15)} END AS a FROM s0 t)"
    out["MA_2"] = f"WITH s0 AS MATERIALIZED ({bars}) SELECT key, ts, {fixed('CASE WHEN bar >= 29 THEN ' + frame('sum((x.bar - t.bar + 30) * x.close) / 465.0', 30) + ' END')} AS ma FROM s0 t"
    out["MA_5"] = f"{tri} SELECT key, ts, {fixed('CASE WHEN bar >= 29 THEN ' + frame('avg(x.a)', 16).replace('s0 x', 'h x') + ' END')} AS ma FROM h t"
    out["MA_TYPE"] = f"WITH s0 AS MATERIALIZED ({bars}) SELECT key, ts, {fixed('CASE WHEN bar >= 29 THEN ' + frame('avg(x.close)', 30) + ' END')} AS ma FROM s0 t"
    out |= {f"MA_{k}": re.sub(rf" AS {n.lower()} FROM (?!.* FROM )", " AS ma FROM ", out[n]) for k, n in ((1, "EMA"), (3, "DEMA"), (4, "TEMA"), (6, "KAMA"))}
    long = new()
    for i in range(6):
        long.follow(f"e{i + 1}", f"e{i}" if i else "close", 0, 1, 1 - 2 / 31, 2 / 31)
    out["MA_7"] = long.select(ma=f"CASE WHEN bar >= 174 THEN {-(v**3)} * e6 + {3 * v**2 + 3 * v**3} * e5 + {-6 * v**2 - 3 * v - 3 * v**3} * e4 + {1 + 3 * v + v**3 + 3 * v**2} * e3 END")
    for name in ("plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "adx", "adxr"):
        out[name.upper()] = _family(new()).select(**{name: name})
    return out
