"""Candlestick patterns as sentences about the last bars, looked at from one side.

A `View` shows the bars with their market side up or down: what rises, leads or is beyond in one view falls, trails or is
short of it in the other. So a pattern that has a rising and a falling form is told once, and a pair such as the two stars
or the soldiers and the crows is one sentence told from both sides. Bars are counted back from now (0). A bar that closes where it opened
counts as rising prices. The result is 100 for the upper view, -100 for the lower, 0 otherwise and where bars are missing.
"""

from __future__ import annotations

from collections.abc import Callable


class View:
    """Prices, parts and relations of bars as SQL over the columns _o0 (open now), _o1 (a bar ago) and so on."""

    def __init__(self, up: bool):
        self.up = up

    # prices and parts
    def open(self, k: int) -> str:
        return f"_o{k}"

    def close(self, k: int) -> str:
        return f"_c{k}"

    def lead(self, k: int) -> str:
        """The end of the bar on the view's side: its high seen from above."""
        return f"_h{k}" if self.up else f"_l{k}"

    def trail(self, k: int) -> str:
        return f"_l{k}" if self.up else f"_h{k}"

    def fore(self, k: int) -> str:
        """The end of the body on the view's side."""
        return f"{'greatest' if self.up else 'least'}(_o{k}, _c{k})"

    def rear(self, k: int) -> str:
        return f"{'least' if self.up else 'greatest'}(_o{k}, _c{k})"

    def middle(self, k: int) -> str:
        return f"((_o{k} + _c{k}) / 2)"

    def body(self, k: int) -> str:
        return f"abs(_c{k} - _o{k})"

    def span(self, k: int) -> str:
        return f"(_h{k} - _l{k})"

    def fore_wick(self, k: int) -> str:
        return self._off(self.lead(k), self.fore(k))

    def rear_wick(self, k: int) -> str:
        return self._off(self.rear(k), self.trail(k))

    def _off(self, a: str, b: str) -> str:
        return f"({a} - {b})" if self.up else f"({b} - {a})"

    # relations
    def beyond(self, a: str, b: str) -> str:
        return f"{a} {'>' if self.up else '<'} {b}"

    def reaches(self, a: str, b: str) -> str:
        return f"{a} {'>=' if self.up else '<='} {b}"

    def with_it(self, *bars: int) -> str:
        """The bars go the view's way."""
        return " AND ".join(f"_c{k} {'>=' if self.up else '<'} _o{k}" for k in bars)

    def against(self, *bars: int) -> str:
        return View(not self.up).with_it(*bars)

    def advance(self, *values: str) -> str:
        """Each value, from the oldest, beyond the one before."""
        return " AND ".join(self.beyond(b, a) for a, b in zip(values, values[1:]))

    def long(self, share: float, *bars: int) -> str:
        return " AND ".join(f"{self.span(k)} > 0 AND {self.body(k)} >= {self.span(k)} * {share}" for k in bars)

    def near(self, a: str, b: str, share: float, k: int) -> str:
        """a and b differ by at most a share of bar k's span."""
        return f"abs({a} - {b}) <= {self.span(k)} * {share}"


def _all(*parts: str) -> str:
    return " AND ".join(f"({p})" for p in parts)


# --- notions without a side ------------------------------------------------------------------------


def doji(k: int) -> str:
    return f"(_h{k} - _l{k}) > 0 AND abs(_c{k} - _o{k}) <= (_h{k} - _l{k}) * 0.1"


def wicks(k: int, upper: str = "", lower: str = "") -> str:
    """Conditions on the upper and lower wick, each an ending such as '<= x'."""
    said = [f"(_h{k} - greatest(_o{k}, _c{k})) {upper}"] * bool(upper) + [f"(least(_o{k}, _c{k}) - _l{k}) {lower}"] * bool(lower)
    return " AND ".join(said)


def bare(k: int, share: float) -> str:
    """A span, and hardly any wick on either side."""
    most = f"<= (_h{k} - _l{k}) * {share}"
    return f"(_h{k} - _l{k}) > 0 AND {wicks(k, most, most)}"


def body_of_span(k: int, most: str) -> str:
    """A body, of at most so much of its span."""
    return f"abs(_c{k} - _o{k}) > 0 AND abs(_c{k} - _o{k}) <= (_h{k} - _l{k}) * {most}"


def held(j: int, i: int) -> str:
    """The body of bar j lies in the body of bar i."""
    return f"greatest(_o{j}, _c{j}) <= greatest(_o{i}, _c{i}) AND least(_o{j}, _c{j}) >= least(_o{i}, _c{i})"


def wraps(j: int, i: int) -> str:
    """The body of bar j goes past both ends of the body of bar i."""
    return f"greatest(_o{j}, _c{j}) > greatest(_o{i}, _c{i}) AND least(_o{j}, _c{j}) < least(_o{i}, _c{i})"


def within(j: int, i: int) -> str:
    """Bar j with its wicks in bar i."""
    return f"_h{j} <= _h{i} AND _l{j} >= _l{i}"


def smaller(j: int, i: int, share: float) -> str:
    return f"abs(_c{j} - _o{j}) < abs(_c{i} - _o{i}) * {share}"


def between(x: str, a: str, b: str) -> str:
    return f"{x} >= least({a}, {b}) AND {x} <= greatest({a}, {b})"


def strictly_between(x: str, a: str, b: str) -> str:
    return f"{x} > least({a}, {b}) AND {x} < greatest({a}, {b})"


# --- sentences -------------------------------------------------------------------------------------


def pin(long_wick: str, share: str) -> str:
    """A small body at one end of the bar and a wick of twice its size at the other."""
    twice, once = ">= 2 * abs(_c0 - _o0)", "<= abs(_c0 - _o0)"
    return _all("(_h0 - _l0) > 0", body_of_span(0, share), wicks(0, twice, once) if long_wick == "upper" else wicks(0, once, twice))


def resting_doji(empty: str) -> str:
    """A doji without a wick on one side and with most of its span on the other."""
    none, most = "<= (_h0 - _l0) * 0.1", ">= (_h0 - _l0) * 0.6"
    return _all(doji(0), wicks(0, none, most) if empty == "upper" else wicks(0, most, none))


def crossed_doji() -> str:
    third = ">= (_h0 - _l0) * 0.3"
    return _all(doji(0), wicks(0, third, third))


def star(doji_star: bool) -> Callable[[View], str]:
    """A long bar against the view, a small one, and a long bar back beyond the first one's middle."""

    def told(v: View) -> str:
        small = doji(1) if doji_star else smaller(1, 2, 0.3)
        return _all(v.against(2), v.with_it(0), v.long(0.6, 2, 0), small, v.beyond(v.close(0), v.middle(2)))

    return told


def march(v: View) -> str:
    """Three long bars the view's way, each opening in the body before, with little behind them."""
    opens = [_all(strictly_between(v.open(k), v.open(k + 1), v.close(k + 1))) for k in (1, 0)]
    tails = [f"{v.rear_wick(k)} <= {v.body(k)} * 0.3" for k in range(3)]
    return _all(v.with_it(0, 1, 2), v.long(0.6, 2), v.long(0.5, 1, 0), *opens, *tails, v.advance(v.close(2), v.close(1), v.close(0)), v.advance(v.lead(2), v.lead(1), v.lead(0)))


def harami(share: float) -> Callable[[View], str]:
    def told(v: View) -> str:
        return _all(v.against(1), v.long(0.5, 1), v.with_it(0), held(0, 1), smaller(0, 1, share))

    return told


def engulfing(v: View) -> str:
    return _all(v.against(1), v.with_it(0), wraps(0, 1))


def confirmed(first: Callable[[View], str]) -> Callable[[View], str]:
    """A pattern of two bars a bar ago, and a close beyond it."""

    def told(v: View) -> str:
        before = first(v)
        for x in "ohlc":
            before = before.replace(f"_{x}1", f"_{x}2").replace(f"_{x}0", f"_{x}1")
        return _all(before, v.beyond(v.close(0), v.close(1)))

    return told


def opening_past(v: View) -> str:
    """A long bar against the view, then one the view's way that opens past its end."""
    return _all(v.against(1), v.long(0.4, 1), v.with_it(0), v.beyond(v.lead(1) if not v.up else v.trail(1), v.open(0)))


def neck(goal: Callable[[View], str]) -> Callable[[View], str]:
    """Price falls, opens below the low and comes back up to a goal; it is told from above, whichever sign the pattern has."""
    return lambda _: _all(opening_past(View(True)), goal(View(True)))


def strike(v: View) -> str:
    """Three bars against the view, then one that opens past the last and closes beyond the first one's open."""
    return _all(v.against(1, 2, 3), View(not v.up).advance(v.close(3), v.close(2), v.close(1)), v.with_it(0), v.beyond(v.close(1), v.open(0)), v.beyond(v.close(0), v.open(3)))


def breakaway(v: View) -> str:
    falls = View(not v.up)
    return _all(v.against(4), v.long(0.4, 4), falls.beyond(v.close(3), v.trail(4)), falls.advance(v.close(3), v.close(2), v.close(1)), v.with_it(0), strictly_between(v.close(0), v.close(3), v.close(4)),
                v.beyond(v.close(0), v.close(3)))


def abandoned(v: View) -> str:
    return _all(v.against(2), v.with_it(0), v.long(0.5, 2, 0), doji(1), v.beyond(v.trail(2), v.lead(1)), v.beyond(v.trail(0), v.lead(1)))


def meeting(v: View) -> str:
    return _all(v.against(1), v.with_it(0), v.long(0.5, 1, 0), v.near(v.close(0), v.close(1), 0.02, 1))


def parting(v: View) -> str:
    return _all(v.against(1), v.with_it(0), "(_h1 - _l1) > 0", v.long(0.5, 0), v.near(v.open(0), v.open(1), 0.02, 1))


def kicking(v: View) -> str:
    return _all(v.against(1), v.with_it(0), bare(1, 0.02), bare(0, 0.02), v.beyond(v.open(0), v.open(1)))


def kicking_by_length(v: View) -> str:
    """The longer bar of the two says which way it goes (the later one of equals)."""
    later, earlier = _all(v.against(1), v.with_it(0), "(_h0 - _l0) >= (_h1 - _l1)"), _all(v.with_it(1), v.against(0), "(_h0 - _l0) < (_h1 - _l1)")
    return _all(bare(1, 0.02), bare(0, 0.02), "_o0 <> _c1", f"({later}) OR ({earlier})")


def doji_star(v: View) -> str:
    return _all(v.against(1), v.long(0.6, 1), doji(0), v.beyond(v.trail(1), v.fore(0)))


def harami_cross(v: View) -> str:
    return _all(v.against(1), v.long(0.5, 1), doji(0), between(v.middle(0), v.open(1), v.close(1)))


def trap(v: View) -> str:
    """An inside bar, and a bar that moves away against the view."""
    return _all(within(1, 2), View(not v.up).beyond(v.lead(0), v.lead(1)), View(not v.up).beyond(v.trail(0), v.trail(1)))


def late_trap(v: View) -> str:
    """An inside bar and a false move against the view, taken back beyond the inside bar."""
    return _all(within(2, 3), v.against(3), v.beyond(v.trail(2), v.trail(1)), v.beyond(v.lead(0), v.lead(2)), v.beyond(v.trail(0), v.trail(2)))


def three_methods(v: View) -> str:
    """A long bar, three small ones back within it, and a long one on."""
    return _all(v.with_it(4, 0), v.against(1, 2, 3), within(3, 4), within(2, 4), within(1, 4), v.long(0.5, 4, 0), v.beyond(v.close(0), v.close(4)), v.beyond(v.open(0), v.close(1)))


def gap_and_back(v: View, close_in: str, opens_in: str) -> str:
    return _all(v.with_it(2, 1), v.against(0), v.beyond(v.open(1), v.close(2)), opens_in, close_in)


def tasuki(v: View) -> str:
    opens = _all(v.reaches(v.open(0), v.trail(1)), v.reaches(v.close(1), v.open(0)))
    return gap_and_back(v, strictly_between(v.close(0), v.close(2), v.open(1)), opens)


def gap_three(v: View) -> str:
    return gap_and_back(v, between(v.close(0), v.close(2), v.open(1)), between(v.open(0), v.open(1), v.close(1)))


def side_by_side(v: View) -> str:
    """A gap the view's way, then two rising bars alike."""
    alike = [f"abs({a} - {b}) / nullif({v.body(1)}, 0) <= 0.3" for a, b in ((v.body(0), v.body(1)), (v.open(0), v.open(1)))]
    gap = v.beyond(v.open(1) if v.up else v.close(1), v.close(2) if v.up else v.open(2))
    return _all(v.with_it(2), View(True).with_it(1, 0), *alike, gap)


def tristar(v: View) -> str:
    return _all(doji(2), doji(1), doji(0), v.beyond(v.trail(2), v.trail(1)), v.beyond(v.lead(2), v.lead(1)), v.beyond(v.close(0), v.close(1)))


def flush(k_open: bool) -> Callable[[View], str]:
    """Nothing to speak of between the body and the span's end: at the open behind it, or at the close before it."""

    def told(v: View) -> str:
        if k_open:
            return _all(v.with_it(0), v.long(0.6, 0), f"abs({v.open(0)} - {v.trail(0)}) <= {v.span(0)} * 0.01")
        return _all(v.with_it(0), v.long(0.4, 0), f"{v._off(v.lead(0), v.close(0))} <= {v.span(0)} * 0.01")

    return told


def coloured(condition: str) -> Callable[[View], str]:
    """A shape without a side takes the sign of its bar's colour."""
    return lambda v: _all(v.with_it(0), condition)


def hard_climb(v: View) -> str:
    """Three bars against the view that lose strength: smaller bodies, or longer wicks in their direction."""
    w = View(not v.up)
    opens = [between(w.open(k), w.open(k + 1), w.close(k + 1)) for k in (1, 0)]
    weaker = [f"{w.body(k)} < {w.body(k + 1)}" for k in (1, 0)] + [f"{w.fore_wick(k)} > {w.fore_wick(k + 1)}" for k in (0, 1)]
    return _all(w.with_it(0, 1, 2), w.advance(w.close(2), w.close(1), w.close(0)), *opens, " OR ".join(weaker))


def stalled(v: View) -> str:
    w = View(not v.up)
    return _all(w.with_it(0, 1, 2), w.long(0.4, 2), w.advance(w.close(2), w.close(1), w.close(0)), between(w.open(1), w.open(2), w.close(2)), f"{w.open(0)} >= {w.close(1)} * 0.99", smaller(0, 1, 0.7))


def crows_after_gap(v: View) -> str:
    return _all(v.against(2), v.with_it(1, 0), v.beyond(v.close(2), v.close(1)), v.beyond(v.open(0), v.open(1)), strictly_between(v.close(0), v.open(2), v.close(2)))


def two_crows_above(v: View) -> str:
    return _all(v.against(2), v.long(0.4, 2), v.with_it(1, 0), v.beyond(v.close(2), v.open(1)), v.beyond(v.open(1), v.open(0)), strictly_between(v.close(0), v.close(2), v.open(1)))


def identical(v: View) -> str:
    spans = [f"{v.span(k)} > 0" for k in range(3)]
    return _all(v.with_it(0, 1, 2), *spans, v.advance(v.close(2), v.close(1), v.close(0)), *[v.near(v.open(k), v.close(k + 1), 0.03, k + 1) for k in (1, 0)])


def shrinking(v: View) -> str:
    last = f"{v.body(0)} <= {v.body(1)} * 0.6"
    return _all(v.against(0, 1, 2), within(1, 2), within(0, 1), last, wicks(0, upper=f"<= {v.body(0)} * 0.2"))


def swallowed(v: View) -> str:
    return _all(v.against(0, 1, 2, 3), bare(3, 0.02), bare(2, 0.02), "_o1 < _c2", "_h1 >= _c2", wraps_range(0, 1), "_o0 >= _o1", "_c0 <= _c1")


def wraps_range(j: int, i: int) -> str:
    return within(i, j)


def ladder(v: View) -> str:
    falls = View(not v.up)
    wick = wicks(1, upper=f">= {v.body(1)} * 1.5")
    return _all(v.against(4, 3, 2), falls.advance(v.close(4), v.close(3), v.close(2)), wick, v.with_it(0), v.long(0.5, 0), v.beyond(v.close(0), v.close(2)))


def mat_hold(v: View) -> str:
    stays = [v.reaches(v.trail(k), v.open(4)) for k in (3, 2, 1)]
    return _all(v.with_it(4, 0), v.against(3, 2, 1), v.long(0.5, 4, 0), *stays, v.beyond(v.close(0), v.close(4)))


def sandwich(v: View) -> str:
    return _all(v.against(2, 0), v.with_it(1), v.near(v.close(0), v.close(2), 0.02, 2), v.reaches(v.open(1), v.close(2)), v.reaches(v.open(2), v.close(1)))


def river(v: View) -> str:
    return _all(v.against(2, 1), v.long(0.4, 2), v.beyond(v.trail(2), v.trail(1)), f"{v.rear_wick(1)} > 0", v.with_it(0), "(_h0 - _l0) > 0", f"{v.body(0)} <= {v.span(0)} * 0.5", v.advance(v.trail(1), v.close(0), v.close(1)))


BOTH, UP, DOWN = (True, False), (True,), (False,)
Told = Callable[[View], str]
# name: bars, sides, sentence. The names and the shares used in the sentences.
RULES: dict[str, tuple[int, tuple[bool, ...], Told]] = {
    "CDL2CROWS": (3, DOWN, crows_after_gap),
    "CDL3BLACKCROWS": (3, DOWN, march),
    "CDL3INSIDE": (3, BOTH, confirmed(harami(0.5))),
    "CDL3LINESTRIKE": (4, BOTH, strike),
    "CDL3OUTSIDE": (3, BOTH, confirmed(engulfing)),
    "CDL3STARSINSOUTH": (3, UP, shrinking),
    "CDL3WHITESOLDIERS": (3, UP, march),
    "CDLABANDONEDBABY": (3, BOTH, abandoned),
    "CDLADVANCEBLOCK": (3, DOWN, hard_climb),
    "CDLBELTHOLD": (1, BOTH, flush(True)),
    "CDLBREAKAWAY": (5, BOTH, breakaway),
    "CDLCLOSINGMARUBOZU": (1, BOTH, flush(False)),
    "CDLCONCEALBABYSWALL": (4, UP, swallowed),
    "CDLCOUNTERATTACK": (2, BOTH, meeting),
    "CDLDARKCLOUDCOVER": (2, DOWN, lambda v: _all(v.against(1), v.long(0.5, 1), v.with_it(0), v.beyond(v.trail(1), v.open(0)), strictly_between(v.close(0), v.middle(1), v.open(1)))),
    "CDLDOJI": (1, UP, lambda _: doji(0)),
    "CDLDOJISTAR": (2, BOTH, doji_star),
    "CDLDRAGONFLYDOJI": (1, UP, lambda _: resting_doji("upper")),
    "CDLENGULFING": (2, BOTH, engulfing),
    "CDLEVENINGDOJISTAR": (3, DOWN, star(True)),
    "CDLEVENINGSTAR": (3, DOWN, star(False)),
    "CDLGAPSIDESIDEWHITE": (3, BOTH, side_by_side),
    "CDLGRAVESTONEDOJI": (1, DOWN, lambda _: resting_doji("lower")),
    "CDLHAMMER": (1, UP, lambda _: pin("lower", "(1 / 3.0)")),
    "CDLHANGINGMAN": (1, DOWN, lambda _: pin("lower", "0.4")),
    "CDLHARAMI": (2, BOTH, harami(0.6)),
    "CDLHARAMICROSS": (2, BOTH, harami_cross),
    "CDLHIGHWAVE": (1, BOTH, coloured(_all("(_h0 - _l0) <> 0", "abs(_c0 - _o0) <= (_h0 - _l0) * 0.3", wicks(0, ">= (_h0 - _l0) * 0.3", ">= (_h0 - _l0) * 0.3")))),
    "CDLHIKKAKE": (3, BOTH, trap),
    "CDLHIKKAKEMOD": (4, BOTH, late_trap),
    "CDLHOMINGPIGEON": (2, UP, lambda v: _all(v.against(1, 0), held(0, 1))),
    "CDLIDENTICAL3CROWS": (3, DOWN, identical),
    "CDLINNECK": (2, DOWN, neck(lambda v: v.near(v.close(0), v.close(1), 0.03, 1))),
    "CDLINVERTEDHAMMER": (1, UP, lambda _: pin("upper", "0.4")),
    "CDLKICKING": (2, BOTH, kicking),
    "CDLKICKINGBYLENGTH": (2, BOTH, kicking_by_length),
    "CDLLADDERBOTTOM": (5, UP, ladder),
    "CDLLONGLEGGEDDOJI": (1, UP, lambda _: crossed_doji()),
    "CDLLONGLINE": (1, BOTH, lambda v: _all(v.with_it(0), v.long(0.7, 0))),
    "CDLMARUBOZU": (1, BOTH, lambda v: _all(v.with_it(0), v.long(0.95, 0), bare(0, 0.025))),
    "CDLMATCHINGLOW": (2, UP, lambda v: _all(v.against(1, 0), v.near(v.close(0), v.close(1), 0.02, 1))),
    "CDLMATHOLD": (5, UP, mat_hold),
    "CDLMORNINGDOJISTAR": (3, UP, star(True)),
    "CDLMORNINGSTAR": (3, UP, star(False)),
    "CDLONNECK": (2, DOWN, neck(lambda v: v.near(v.close(0), v.trail(1), 0.03, 1))),
    "CDLPIERCING": (2, UP, neck(lambda v: strictly_between(v.close(0), v.middle(1), v.open(1)))),
    "CDLRICKSHAWMAN": (1, UP, lambda v: _all(crossed_doji(), v.near(v.middle(0), "((_h0 + _l0) / 2)", 0.15, 0))),
    "CDLRISEFALL3METHODS": (5, BOTH, three_methods),
    "CDLSEPARATINGLINES": (2, BOTH, parting),
    "CDLSHOOTINGSTAR": (1, DOWN, lambda _: pin("upper", "(1 / 3.0)")),
    "CDLSHORTLINE": (1, BOTH, coloured(_all("(_h0 - _l0) <> 0", body_of_span(0, "0.3")))),
    "CDLSPINNINGTOP": (1, BOTH, coloured(_all("(_h0 - _l0) > 0", body_of_span(0, "(1 / 3.0)"), wicks(0, "> abs(_c0 - _o0)", "> abs(_c0 - _o0)")))),
    "CDLSTALLEDPATTERN": (3, DOWN, stalled),
    "CDLSTICKSANDWICH": (3, UP, sandwich),
    "CDLTAKURI": (1, UP, lambda v: _all("(_h0 - _l0) <> 0", wicks(0, "<= (_h0 - _l0) * 0.1", f">= ({v.body(0)} + 0.0001) * 3"))),
    "CDLTASUKIGAP": (3, BOTH, tasuki),
    "CDLTHRUSTING": (2, DOWN, neck(lambda v: strictly_between(v.close(0), v.close(1), v.middle(1)))),
    "CDLTRISTAR": (3, BOTH, tristar),
    "CDLUNIQUE3RIVER": (3, UP, river),
    "CDLUPSIDEGAP2CROWS": (3, DOWN, two_crows_above),
    "CDLXSIDEGAP3METHODS": (3, BOTH, gap_three),
}


def stages(names: list[str]) -> list[dict[str, str]]:
    """One set of lags, deep enough for all the names, then a column for each."""
    deep = max(RULES[x][0] for x in names)
    lags = {f"_{x[0]}{k}": f"lag({x}, {k}) OVER (PARTITION BY key ORDER BY ts)" if k else x for k in range(deep) for x in ("open", "high", "low", "close")}
    out = {}
    for name in names:
        n, sides, told = RULES[name]
        cases = " ".join(f"WHEN bar >= {n - 1} AND {told(View(up))} THEN {100 if up else -100}" for up in sides)
        out[name.lower()] = f"CASE {cases} ELSE 0 END"
    return [lags, out]
