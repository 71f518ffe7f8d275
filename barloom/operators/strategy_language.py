"""Rules of trading as text, compiled to one plan: `RSI(14) < 30 and close > SMA(20) or cross_above(EMA(5), EMA(12))`.

The text becomes a condition over columns and the list of indicators that it names; those are computed together, crossings look a bar back, and
no rule is evaluated row by row. A comparison with a value that isn't there yet is false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.errors import ParameterError
from barloom.operators import features
from barloom.operators.recurrences import RECURRENCES
from barloom.plans.staged import outputs

PRICES = ("open", "high", "low", "close", "volume")
TOKEN = re.compile(r"\s*(?:(?P<number>-?\d+\.?\d*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign><=|>=|==|!=|<|>|[(),]))")
COMPARE = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__, "!=": Column.__ne__}


def tokens_of(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ParameterError(f"can't read {text[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def _outputs(name: str) -> list[str]:
    return list(RECURRENCES[name][2]) if name in RECURRENCES else outputs(features._stages_of(name, {}))


@dataclass
class _Reader:
    """Recursive descent: or, and, not, comparison, value."""

    tokens: list[str]
    at: int = 0
    specs: list[features.Spec] = field(default_factory=list)  # indicators in the order of their columns
    crossed: list[tuple[str, str]] = field(default_factory=list)

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise ParameterError(f"expected {want or 'more'} at {' '.join(self.tokens[self.at :]) or 'the end'!r}")
        self.at += 1
        return t

    def word(self) -> str:
        return self.peek().lower()

    def whole(self):
        out = self.either()
        if self.peek():
            raise ParameterError(f"can't read {' '.join(self.tokens[self.at :])!r}")
        return out

    def either(self):
        parts = [self.both()]
        while self.word() == "or":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both(self):
        parts = [self.negated()]
        while self.word() == "and":
            self.take()
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def negated(self):
        if self.word() == "not":
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        left = self.value()
        if self.peek() in COMPARE:
            sign = self.take()
            return ("compare", sign, left, self.value())
        return left

    def value(self):
        t = self.take()
        if t == "(":
            out = self.either()
            self.take(")")
            return out
        if re.fullmatch(r"-?\d+\.?\d*", t):
            return ("number", float(t))
        if not re.match(r"[A-Za-z_]", t) or t.lower() in ("and", "or", "not"):
            raise ParameterError(f"a value is missing before {t!r}")
        if t.lower() in PRICES:
            return ("column", t.lower())
        if t.lower() in ("cross_above", "cross_below"):
            self.take("(")
            a = self.value()
            self.take(",")
            b = self.value()
            self.take(")")
            return ("cross", t.lower() == "cross_above", a, b)
        return self.indicator(t)

    def indicator(self, t: str):
        """NAME or NAME_output, the first number in brackets being the period."""
        numbers = []
        if self.peek() == "(":
            self.take()
            while self.peek() != ")":
                numbers.append(float(self.take()))
                if self.peek() == ",":
                    self.take()
            self.take(")")
        name, out, known = t.upper(), None, features.list_indicators()
        while name not in known:
            name, _, last = name.rpartition("_")
            out = f"{last.lower()}_{out}" if out else last.lower()
            if not name:
                raise ParameterError(f"unknown name {t!r}")
        outs = _outputs(name)
        if out is not None and out not in outs:
            raise ParameterError(f"{name} has no output {out!r}", f"outputs: {', '.join(outs)}")
        params = {"timeperiod": int(numbers[0])} if numbers and features._takes(name, "timeperiod") else {}
        spec = (name, params)
        if spec not in self.specs:
            self.specs.append(spec)
        return ("indicator", self.specs.index(spec), outs.index(out) if out else 0)


def _column(node, names: dict[tuple[int, int], str]) -> Column:
    kind = node[0]
    if kind == "number":
        return F.lit(node[1])
    if kind == "column":
        return F.col(node[1])
    if kind == "indicator":
        return F.col(names[node[1:]])
    parts = [_column(n, names) for n in node[2 if kind in ("compare", "cross") else 1 :] if isinstance(n, tuple)]
    if kind == "compare":
        return F.coalesce(COMPARE[node[1]](*parts), F.lit(False))
    if kind == "cross":
        w = Window.partitionBy("key").orderBy("ts")
        a, b = parts
        before = [F.lag(p).over(w) if n[0] != "number" else p for n, p in zip(node[2:], parts, strict=True)]
        passed = (before[0] <= before[1]) & (a > b) if node[1] else (before[0] >= before[1]) & (a < b)
        return F.coalesce(passed, F.lit(False))
    parts = [p if n[0] in ("compare", "cross", "or", "and", "not") else F.coalesce(p != 0, F.lit(False)) for n, p in zip(node[1:], parts, strict=True)]
    if kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if kind == "or" else out & p
    return out


@dataclass(frozen=True)
class Strategy:
    """A rule; reading its text finds mistakes before anything runs."""

    text: str

    def __post_init__(self) -> None:
        parse_expression(self.text)

    def evaluate(self, bars: DataFrame) -> DataFrame:
        """bars with signal: 1 where the rule holds, else 0."""
        tree, specs = parse_expression(self.text)
        made = features.compute_many(bars, specs) if specs else bars
        new, names = iter([c for c in made.columns if c not in bars.columns]), {}
        for i, (name, _) in enumerate(specs):
            names |= {(i, k): next(new) for k in range(len(_outputs(name)))}
        holds = _column(tree, names)
        if tree[0] in ("number", "column", "indicator"):
            holds = F.coalesce(holds != 0, F.lit(False))
        return made.withColumn("signal", holds.cast("int")).select(*[c for c in bars.columns if c != "signal"], "signal")


def parse_expression(text: str) -> tuple[tuple, list]:
    """The rule as a tree, and the indicators that it names."""
    reader = _Reader(tokens_of(text))
    return reader.whole(), reader.specs


def evaluate(text: str, bars: DataFrame) -> DataFrame:
    return Strategy(text).evaluate(bars)


DSL = "close > sma(20) and not (mom(10) < 0 or cross_below(sma(5), sma(20)))"
LONG = "RSI(9) < 45 and close > EMA(12) or cross_above(MACD_macd, MACD_signal) and not high >= DONCHIAN_upper(15)"


def register(add, src) -> None:
    from barloom.plans.recursive_sql import Query
    from barloom.workers import workers_import

    bars, BARS = src["bars"], src["BARS"]
    past = lambda e, p: f"CASE WHEN bar >= {p - 1} THEN (SELECT {e} FROM s0 x WHERE x.key = t.key AND x.bar > t.bar - {p} AND x.bar <= t.bar) END"
    rows = f"WITH s0 AS MATERIALIZED ({BARS}), v AS MATERIALIZED (SELECT *, {past('avg(x.close)', 20)} AS m20, {past('avg(x.close)', 5)} AS m5, (SELECT x.close FROM s0 x WHERE x.key = t.key AND x.bar = t.bar - 10) AS c10 FROM s0 t)"
    add("sig_dsl", lambda s, d: evaluate(DSL, bars(s, d)).selectExpr("key", "ts", "signal"),
        f"{rows} SELECT v.key, v.ts, CASE WHEN coalesce(v.close > v.m20, false) AND NOT (coalesce(v.close - v.c10 < 0, false) OR coalesce(p.m5 >= p.m20 AND v.m5 < v.m20, false)) THEN 1 ELSE 0 END AS signal FROM v LEFT JOIN v p ON p.key = v.key AND p.bar = v.bar - 1")

    def long(s, d):
        workers_import(s)
        return evaluate(LONG, bars(s, d)).selectExpr("key", "ts", "signal")

    q = Query(BARS).add(g="greatest(close - lag(close) OVER w, 0)", l="greatest(lag(close) OVER w - close, 0)").wilder("a", "g", 9).wilder("b", "l", 9).ema("e", "close", 12).ema("f", "close", 12).ema("s", "close", 26).add(m="f - s").ema("sig", "m", 9, 25)
    top = past("max(x.high)", 15)
    made = f"WITH RECURSIVE {', '.join(q.ctes)}, v AS MATERIALIZED (SELECT t.*, CASE WHEN a + b = 0 THEN 0 ELSE 100 * a / (a + b) END AS rsi, {top} AS top FROM {q.at} t)"
    add("sig_language", long, f"""{made} SELECT v.key, v.ts, CASE WHEN coalesce(v.rsi < 45 AND v.close > v.e, false) OR (coalesce(p.sig IS NOT NULL AND p.m <= p.sig AND v.m > v.sig, false) AND NOT coalesce(v.high >= v.top, false)) THEN 1 ELSE 0 END AS signal
 FROM v LEFT JOIN v p ON p.key = v.key AND p.bar = v.bar - 1""")  # fmt: skip
