"""Option chains and strategies: strikes by selector, smiles and term structures, futures curves, payoffs, values and greeks of legs.

A chain is rows (chain, strike, vol, ..); what needs its order is a window or an aggregation over it. A strategy's legs are few and known to
the driver: they are a constant array that grid points are exploded over, so nothing is joined.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from datetime import date
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.errors import ParameterError
from barloom.functions.derivatives import COMMON, black76, bsm, contracts, digital, greeks
from barloom.plans.frames import fixed
from barloom.plans.staged import Stages, apply_stages, as_sql, outputs, rounded

# --- one contract at a time ------------------------------------------------------------------------


def at_columns(df: DataFrame, stages: Stages, out: list[str], **changed: Column) -> DataFrame:
    """df with the stages' outputs (renamed by `out`) for contracts of which some columns are changed."""
    kept = {c: F.col(c) for c in changed}
    moved = df.withColumns({f"__{c}": kept[c] for c in changed}).withColumns(changed)
    got = apply_stages(moved, stages)
    made = dict(zip(outputs(stages), out, strict=True))
    return got.withColumnsRenamed(made).withColumns({c: F.col(f"__{c}") for c in changed}).drop(*[f"__{c}" for c in changed])


def black76_greeks(df: DataFrame) -> DataFrame:
    """delta, gamma, vega, theta and rho with respect to the forward (spot); theta is a central difference of a day in the price."""
    valid = "spot > 0 AND strike > 0 AND t > 0 AND vol > 0"
    h = F.greatest(F.lit(1e-6), F.least(F.col("t"), F.lit(1.0 / 365)))
    early, late = F.greatest(F.col("t") - h, F.lit(1e-8)), F.col("t") + h
    out = at_columns(at_columns(at_columns(df, black76(), ["__p"]), black76(), ["__early"], t=early), black76(), ["__late"], t=late)
    sided = "CASE WHEN is_call = 1 THEN _d * _n1 ELSE -_d * _m1 END"
    d1 = [s if "_d1" not in s else {"_d1": "(ln(spot / strike) + 0.5 * vol * vol * t) / _s"} for s in COMMON]
    made = apply_stages(out, [*d1, {"delta": sided, "gamma": "_d * _p1 / (spot * _s)", "vega": "_d * spot * _p1 * sqrt(t)"}])
    made = made.withColumns({"theta": F.when(F.expr(valid), (F.col("__early") - F.col("__late")) / (late - early)), "rho": F.when(F.expr(valid), -F.col("t") * F.col("__p"))})
    return made.drop("__p", "__early", "__late")


def digital_greeks(df: DataFrame, kind: str = "cash", bump: float = 1e-3) -> DataFrame:
    """delta, gamma and vega of digital options by central differences: a thousandth of the spot, a thousandth of volatility."""
    names = [f"__{kind}{i}" for i in range(5)]
    other = "asset" if kind == "cash" else "cash"
    moves = [{}, {"spot": F.col("spot") * (1 + bump)}, {"spot": F.col("spot") * (1 - bump)}, {"vol": F.col("vol") + bump}, {"vol": F.greatest(F.col("vol") - bump, F.lit(1e-12))}]
    out = df
    for name, move in zip(names, moves, strict=True):
        out = at_columns(out, digital(), [name, "__x"] if kind == "cash" else ["__x", name], **move).drop("__x")
    mid, up, down, more, less = (F.col(n) for n in names)
    eps = F.col("spot") * bump
    vega = F.when(F.col("vol") - bump > 0, (more - less) / (2 * bump)).otherwise((more - mid) / bump)
    return out.withColumns({"delta": (up - down) / (2 * eps), "gamma": (up - 2 * mid + down) / (eps * eps), "vega": vega}).drop(*names, other)


# --- chains ----------------------------------------------------------------------------------------


def selector_of(selector: str, is_call: bool) -> tuple[str, float]:
    """('steps', n) from ATM, ITMn and OTMn, ('delta', x) from DELTAx; steps count upwards."""
    m = re.fullmatch(r"(ATM)|(ITM|OTM)(\d*)|DELTA([-+.\d]+)", selector.strip().upper())
    if not m:
        raise ParameterError(f"unknown selector {selector!r}", "ATM, ITM<n>, OTM<n> or DELTA<x>")
    if m[1]:
        return "steps", 0
    if m[2]:
        n = int(m[3] or 1)
        return "steps", n if (m[2] == "OTM") == is_call else -n
    try:
        return "delta", float(m[4])
    except ValueError:
        raise ParameterError(f"unknown selector {selector!r}", "as in DELTA0.25") from None


def select_strike(chain: DataFrame, selector: str = "ATM", is_call: bool = True, by: str = "chain") -> DataFrame:
    """chain, strike: of each chain (strike, spot; rate, carry, t, vol for deltas) the one that is selected; null where the steps lead out of it."""
    kind, x = selector_of(selector, is_call)
    if kind == "delta":
        valued = apply_stages(chain.filter("strike IS NOT NULL AND vol IS NOT NULL").withColumn("is_call", F.lit(int(is_call))), greeks())
        return valued.groupBy(by).agg(F.min_by("strike", F.struct(F.abs(F.col("delta") - x), F.col("strike"))).alias("strike"))
    w = Window.partitionBy(by).orderBy("strike")
    placed = chain.withColumn("_n", F.row_number().over(w))
    at = placed.groupBy(by).agg(F.min_by("_n", F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("_n"))).alias("_at"))
    return at.join(placed.select(by, "strike", "_n"), [by]).groupBy(by).agg(F.max(F.when(F.col("_n") == F.col("_at") + int(x), F.col("strike"))).alias("strike"))


def smile_metrics(chain: DataFrame, by: str = "chain") -> DataFrame:
    """atm_iv, risk_reversal_25d, butterfly_25d, skew_slope, convexity of each chain with three strikes or more.

    Quotes of one strike follow each other by volatility. Between them the smile is vertical: its slope is infinite, or NaN where the volatilities are the same too.
    """
    calls = apply_stages(chain.withColumn("is_call", F.lit(1)), greeks()).withColumnRenamed("delta", "_dc").drop("gamma", "vega", "theta", "rho")
    both = apply_stages(calls.withColumn("is_call", F.lit(0)), greeks()).withColumnRenamed("delta", "_dp")
    w = Window.partitionBy(by).orderBy("strike", "vol")
    x = F.log(F.col("strike") / F.col("spot"))
    rows = both.withColumns({"_n": F.row_number().over(w), "_x": x}).withColumns({f"_{c}{s}": f(c).over(w) for c in ("_x", "vol") for s, f in (("b", F.lag), ("a", F.lead))})
    slope = lambda dy, dx: F.when(dx == 0, dy * float("inf")).otherwise(F.try_divide(dy, dx))
    left, right = slope(F.col("vol") - F.col("_volb"), F.col("_x") - F.col("__xb")), slope(F.col("_vola") - F.col("vol"), F.col("__xa") - F.col("_x"))
    rows = rows.withColumn("_bend", right - left)
    near = lambda what, to: F.min_by(what, F.struct(F.abs(to), F.col("_n")))
    atm = F.col("strike") - F.col("spot")
    got = rows.groupBy(by).agg(
        near("vol", atm).alias("atm_iv"), near("vol", F.col("_dc") - 0.25).alias("_c"), near("vol", F.col("_dp") + 0.25).alias("_p"), F.regr_slope("vol", "_x").alias("skew_slope"),
        near("_bend", atm).alias("convexity"), F.count("*").alias("_k"),
    )
    return got.filter("_k >= 3").select(by, "atm_iv", (F.col("_c") - F.col("_p")).alias("risk_reversal_25d"), ((F.col("_c") + F.col("_p")) / 2 - F.col("atm_iv")).alias("butterfly_25d"), "skew_slope", "convexity")


def term_structure_slope(points: DataFrame, by: str = "chain", tenor: str = "t", iv: str = "vol") -> DataFrame:
    return points.groupBy(by).agg(F.regr_slope(iv, tenor).alias("slope"))


def interpolate(points: DataFrame, target: Column, by: str = "chain", x: str = "t", y: str = "vol") -> DataFrame:
    """value at the target of each chain's points, on straight lines between them and flat beyond: from its points as a sorted array."""
    made = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
    below, above = F.filter("_p", lambda p: p["x"] < target), F.filter("_p", lambda p: p["x"] >= target)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    share = F.when(b["x"] == a["x"], 0.0).otherwise((target - a["x"]) / (b["x"] - a["x"]))
    return made.select(by, F.when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(a["y"] + share * (b["y"] - a["y"])).alias("value"))


# --- futures curves --------------------------------------------------------------------------------


def calendar_spreads(curve: DataFrame, by: str = "curve", tenor: str = "tenor", price: str = "price") -> DataFrame:
    """The price of each contract less that of the one before it; the first has none. Contracts of one tenor follow each other by price, then by their other columns (but maps)."""
    others = [f.name for f in curve.schema if f.name not in (by, tenor, price) and "map<" not in f.dataType.simpleString()]
    w = Window.partitionBy(by).orderBy(tenor, price, *others)
    return curve.withColumn("spread", F.col(price) - F.lag(price).over(w)).filter("spread IS NOT NULL")


def curve_slope(curve: DataFrame, by: str = "curve", tenor: str = "tenor", price: str = "price") -> DataFrame:
    return curve.groupBy(by).agg(F.regr_slope(price, tenor).alias("slope"))


def curve_summary(curve: DataFrame, by: str = "curve", tenor: str = "tenor", price: str = "price", spot: str = "spot") -> DataFrame:
    """front_basis, average_basis, slope and is_contango (no contract below the one before it)."""
    w = Window.partitionBy(by).orderBy(tenor)
    falls = (F.col(price) < F.lag(price).over(w)).cast("int")
    gap = F.col(price) - F.col(spot)
    return curve.withColumn("_falls", F.coalesce(falls, F.lit(0))).groupBy(by).agg(F.min_by(gap, tenor).alias("front_basis"), F.avg(gap).alias("average_basis"), F.regr_slope(price, tenor).alias("slope"), (F.max("_falls") == 0).alias("is_contango"))


# --- strategies ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PayoffLeg:
    """A leg held: option, future or stock."""

    instrument: str = "option"
    side: str = "long"
    option_type: str = "call"
    strike: float = 0.0
    premium: float = 0.0
    entry_price: float = 0.0
    quantity: float = 1.0
    multiplier: float = 1.0
    t: float = 0.0
    vol: float = 0.0
    rate: float = 0.0
    carry: float = 0.0

    def __post_init__(self) -> None:
        if self.instrument not in ("option", "future", "stock") or self.side not in ("long", "short") or self.option_type not in ("call", "put"):
            raise ParameterError("a leg is an option, future or stock, long or short, a call or put")
        if self.instrument == "option" and not self.strike > 0:
            raise ParameterError("an option needs a strike above 0")

    @property
    def scale(self) -> float:
        return self.quantity * self.multiplier * (1 if self.side == "long" else -1)


def _over_legs(grid: DataFrame, legs: list[PayoffLeg]) -> DataFrame:
    """Every grid point (spot) with every leg's numbers."""
    one = lambda leg: F.struct(*[F.lit(v).alias(k) for k, v in (asdict(leg) | {"scale": float(leg.scale), "is_call": int(leg.option_type == "call")}).items()])
    return grid.withColumn("leg_", F.explode(F.array(*map(one, legs)))).select("*", "leg_.*").drop("leg_")


def _summed(grid: DataFrame, rows: DataFrame, **totals: Column) -> DataFrame:
    return rows.groupBy(*grid.columns).agg(*[F.sum(e).alias(n) for n, e in totals.items()])


def strategy_payoff(grid: DataFrame, legs: list[PayoffLeg]) -> DataFrame:
    """payoff at expiry for each row of grid (spot, ..)."""
    gain = F.when(F.col("instrument") == "option", F.greatest(F.lit(0.0), F.when(F.col("is_call") == 1, F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot"))) - F.col("premium")).otherwise(F.col("spot") - F.col("entry_price"))
    return _summed(grid, _over_legs(grid, legs), payoff=F.col("scale") * gain)


def leg_payoff(grid: DataFrame, instrument: str = "option", **terms) -> DataFrame:
    """payoff of one option, future or stock."""
    return strategy_payoff(grid, [PayoffLeg(instrument, **terms)])


def strategy_value(grid: DataFrame, legs: list[PayoffLeg]) -> DataFrame:
    """value before expiry, with options by Black, Scholes and Merton, for each row of grid."""
    rows = apply_stages(_over_legs(grid, legs), bsm())
    gain = F.when(F.col("instrument") == "option", F.col("price") - F.col("premium")).otherwise(F.col("spot") - F.col("entry_price"))
    return _summed(grid, rows, value=F.col("scale") * gain)


def aggregate_greeks(grid: DataFrame, legs: list[PayoffLeg]) -> DataFrame:
    """delta, gamma, vega, theta and rho of all legs for each row of grid; a future or stock has a delta of 1."""
    rows = apply_stages(_over_legs(grid, legs), greeks())
    option = F.col("instrument") == "option"
    return _summed(grid, rows, **{g: F.col("scale") * F.when(option, F.col(g)).otherwise(float(g == "delta")) for g in ("delta", "gamma", "vega", "theta", "rho")})


# The names of selectors, presets and modes, and the fields of their records.
class ExpirySelectorKind(StrEnum):
    CURRENT_WEEK = "current_week"
    NEXT_WEEK = "next_week"
    CURRENT_MONTH = "current_month"
    NEXT_MONTH = "next_month"
    EXPLICIT_DATE = "explicit_date"


class StrikeSelectorKind(StrEnum):
    ATM = "atm"
    ITM = "itm"
    OTM = "otm"
    DELTA = "delta"
    EXPLICIT = "explicit"


class LegPreset(StrEnum):
    STRADDLE = "straddle"
    STRANGLE = "strangle"
    IRON_CONDOR = "iron_condor"
    BULL_CALL_SPREAD = "bull_call_spread"
    BEAR_PUT_SPREAD = "bear_put_spread"
    CUSTOM = "custom"


class RiskMode(StrEnum):
    PER_LEG = "per_leg"
    COMBINED_PNL = "combined_pnl"


def _not_negative(record) -> None:
    bad = [k for k, v in asdict(record).items() if isinstance(v, (int, float)) and v < 0]
    if bad:
        raise ParameterError(f"{', '.join(bad)} must not be negative")


@dataclass(frozen=True)
class ExpirySelector:
    kind: ExpirySelectorKind = ExpirySelectorKind.CURRENT_MONTH
    explicit_date: date | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "kind", ExpirySelectorKind(self.kind))
        if (self.kind is ExpirySelectorKind.EXPLICIT_DATE) != (self.explicit_date is not None):
            raise ParameterError("an explicit expiry, and only that, has a date")

    def pick(self, expiries: list[date], today: date) -> date:
        """The expiry that is meant: a week or month is that of its last one, and moves on once it has passed."""
        ahead = sorted(e for e in expiries if e >= today)
        if self.explicit_date is not None:
            ahead = [e for e in ahead if e == self.explicit_date]
        elif "month" in self.kind:
            months: dict[tuple[int, int], date] = {(e.year, e.month): e for e in ahead}
            ahead = list(months.values())
        at = 1 if self.kind.startswith("next") else 0
        if len(ahead) <= at:
            raise ParameterError(f"there is no expiry {self.kind}")
        return ahead[at]


@dataclass(frozen=True)
class StrikeSelector:
    kind: StrikeSelectorKind = StrikeSelectorKind.ATM
    steps: int = 0
    delta: float | None = None
    explicit_strike: float | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "kind", StrikeSelectorKind(self.kind))
        need = {StrikeSelectorKind.DELTA: self.delta is not None, StrikeSelectorKind.EXPLICIT: (self.explicit_strike or 0) > 0}
        if self.steps < 0 or not need.get(self.kind, True) or (self.delta is not None and not 0 < abs(self.delta) < 1):
            raise ParameterError(f"a strike selector {self.kind} needs steps of 0 or more, a delta within 1, or a strike above 0")

    @property
    def text(self) -> str:
        return {"itm": f"ITM{self.steps}", "otm": f"OTM{self.steps}", "delta": f"DELTA{self.delta}"}.get(self.kind, "ATM")


@dataclass(frozen=True)
class RiskControl:
    stop_loss_type: str | None = None
    stop_loss_value: float | None = None
    target_type: str | None = None
    target_value: float | None = None
    trailstop_type: str | None = None
    trailstop_value: float | None = None
    breakeven_trigger: float | None = None

    def __post_init__(self) -> None:
        _not_negative(self)


@dataclass(frozen=True)
class SimulationLimits:
    max_premium_outlay: float | None = None
    max_loss_per_trade: float | None = None
    daily_max_drawdown: float | None = None
    cooldown_bars: int = 0
    reentry_allowed: bool = True

    def __post_init__(self) -> None:
        _not_negative(self)


@dataclass(frozen=True)
class StrategyLeg:
    underlying: str
    expiry_selector: ExpirySelector | None = None
    strike_selector: StrikeSelector | None = None
    option_type: str | None = None
    side: str = "long"
    quantity: float = 1
    instrument: str = "option"
    premium_limit: float | None = None

    def __post_init__(self) -> None:
        if not self.underlying or self.side not in ("long", "short") or not self.quantity or self.instrument not in ("option", "future", "stock"):
            raise ParameterError("a leg has an underlying, a side (long or short), a quantity and an instrument (option, future or stock)")
        if self.instrument == "option" and (self.option_type not in ("call", "put") or self.expiry_selector is None or self.strike_selector is None):
            raise ParameterError("an option is a call or put with an expiry and a strike")
        if (self.premium_limit or 0) < 0:
            raise ParameterError("premium_limit must not be negative")


@dataclass(frozen=True)
class DerivativesStrategy:
    name: str
    preset: LegPreset = LegPreset.CUSTOM
    legs: tuple[StrategyLeg, ...] = ()
    risk_controls: RiskControl = field(default_factory=RiskControl)
    risk_mode: RiskMode = RiskMode.COMBINED_PNL
    commission: float = 0.0
    slippage: float = 0.0
    spread_assumption: float = 0.0
    limits: SimulationLimits = field(default_factory=SimulationLimits)

    def __post_init__(self) -> None:
        object.__setattr__(self, "preset", LegPreset(self.preset))
        object.__setattr__(self, "risk_mode", RiskMode(self.risk_mode))
        if not self.name or not self.legs:
            raise ParameterError("a strategy has a name and a leg at least")
        if min(self.commission, self.slippage, self.spread_assumption) < 0:
            raise ParameterError("costs must not be negative")

    def to_dict(self) -> dict:
        return asdict(self)


# What each preset holds: option type, side, steps out of the money (0: the base strike).
PRESET_LEGS: dict[LegPreset, tuple[tuple[str, str, int], ...]] = {
    LegPreset.STRADDLE: (("call", "long", 0), ("put", "long", 0)),
    LegPreset.STRANGLE: (("call", "long", 1), ("put", "long", 1)),
    LegPreset.BULL_CALL_SPREAD: (("call", "long", 0), ("call", "short", 1)),
    LegPreset.BEAR_PUT_SPREAD: (("put", "long", 0), ("put", "short", 1)),
    LegPreset.IRON_CONDOR: (("put", "short", 1), ("put", "long", 2), ("call", "short", 1), ("call", "long", 2)),
}


def build_strategy_preset(preset: LegPreset | str, *, name: str, underlying: str, expiry_selector: ExpirySelector, base_strike_selector: StrikeSelector | None = None, **settings) -> DerivativesStrategy:
    preset = LegPreset(preset)
    if preset not in PRESET_LEGS:
        raise ParameterError(f"{preset} has no legs of its own")
    base = base_strike_selector or StrikeSelector()
    legs = tuple(StrategyLeg(underlying, expiry_selector, StrikeSelector(StrikeSelectorKind.OTM, steps=n) if n else base, kind, side) for kind, side, n in PRESET_LEGS[preset])
    return DerivativesStrategy(name=name, preset=preset, legs=legs, **settings)


def legs_of(strategy: DerivativesStrategy, chain: DataFrame, t: float) -> list[PayoffLeg]:
    """The strategy's legs in one chain (strike, spot, vol, rate, carry), priced by its volatilities. The chain of one expiry comes to the driver."""
    one = chain.withColumns({"chain": F.lit(0), "t": F.lit(float(t))})
    out = []
    for leg in strategy.legs:
        is_call = leg.option_type == "call"
        strike = leg.strike_selector.explicit_strike if leg.strike_selector.kind is StrikeSelectorKind.EXPLICIT else (select_strike(one, leg.strike_selector.text, is_call).first() or [None, None])[1]
        if strike is None:
            raise ParameterError(f"the chain has no strike {leg.strike_selector.text}")
        row = apply_stages(one.filter(F.col("strike") == strike).withColumn("is_call", F.lit(int(is_call))), bsm()).first()
        out.append(PayoffLeg("option", leg.side, leg.option_type, float(strike), float(row["price"]), 0.0, leg.quantity, 1.0, float(t), float(row["vol"]), float(row["rate"]), float(row["carry"])))
    return out


# --- queries ---------------------------------------------------------------------------------------

LEGS = [
    PayoffLeg("option", "long", "call", 1500.0, 40.0, 0.0, 2.0, 10.0, 0.5, 0.25, 0.03, 0.01), PayoffLeg("option", "short", "put", 1400.0, 35.0, 0.0, 1.0, 10.0, 0.25, 0.3, 0.03, 0.0),
    PayoffLeg("future", "short", entry_price=1450.0, quantity=3.0), PayoffLeg("stock", "long", entry_price=1300.0, quantity=5.0),
]


def register(add, src) -> None:
    from barloom.functions.derivatives import CONTRACTS

    five = ["delta", "gamma", "vega", "theta", "rho"]
    b76 = "exp(-rate * {t}) * CASE WHEN is_call = 1 THEN spot * {n1} - strike * {n2} ELSE strike * (1 - {n2}) - spot * (1 - {n1}) END"
    shown = lambda names: ", ".join(rounded(names))
    add("opt_black76_greeks", lambda s, d: black76_greeks(contracts(s, d)).selectExpr("key", *rounded(five)), _black76_sql(CONTRACTS, shown(five)))
    three = ["delta", "gamma", "vega"]
    add("opt_digital_greeks", lambda s, d: digital_greeks(contracts(s, d)).selectExpr("key", *rounded(three)), _digital_sql(CONTRACTS, shown(three)))

    def chain(s, d):
        c = contracts(s, d)
        spot = c.groupBy("brand").agg(F.avg("spot").alias("spot"))
        return c.drop("spot").join(spot, "brand").withColumnRenamed("brand", "chain").withColumns({"t": F.lit(0.25), "strike": F.col("strike") + F.col("key") / 1000})

    CHAIN = f"SELECT c.brand AS chain, c.key, c.strike + c.key / 1000 AS strike, s.spot, c.rate, c.carry, cast(0.25 AS DOUBLE) AS t, c.vol FROM ({CONTRACTS}) c JOIN (SELECT brand, avg(spot) AS spot FROM ({CONTRACTS}) GROUP BY brand) s USING (brand)"
    for name, selector, call in (("atm", "ATM", True), ("otm2_put", "OTM2", False), ("delta30", "DELTA0.3", True)):
        kind, x = selector_of(selector, call)
        if kind == "steps":
            sql = f"WITH c AS ({CHAIN}), n AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY strike) AS n FROM c), a AS (SELECT chain, arg_min(n, {{'d': abs(strike - spot), 'n': n}}) AS at_ FROM n GROUP BY chain) SELECT a.chain, round(n.strike, 6) AS strike FROM a LEFT JOIN n ON n.chain = a.chain AND n.n = a.at_ + {int(x)}"
        else:
            sql = f"WITH c AS ({CHAIN}), v AS (SELECT *, {_delta_sql('1')} AS delta FROM c) SELECT chain, round(arg_min(strike, {{'d': abs(delta - {x}), 'k': strike}}), 6) AS strike FROM v GROUP BY chain"
        add(f"opt_select_strike_{name}", lambda s, d, q=selector, call=call: select_strike(chain(s, d), q, call).selectExpr("chain", "round(strike, 6) AS strike"), sql)
    metrics = ["atm_iv", "risk_reversal_25d", "butterfly_25d", "skew_slope", "convexity"]
    smile = f"""WITH c AS ({CHAIN}), v AS MATERIALIZED (SELECT *, ln(strike / spot) AS x, {_delta_sql('1')} AS dc, {_delta_sql('0')} AS dp, row_number() OVER (PARTITION BY chain ORDER BY strike) AS n FROM c),
 b AS (SELECT v.*, (a.vol - v.vol) / (a.x - v.x) - (v.vol - p.vol) / (v.x - p.x) AS bend FROM v LEFT JOIN v p ON p.chain = v.chain AND p.n = v.n - 1 LEFT JOIN v a ON a.chain = v.chain AND a.n = v.n + 1),
 k AS (SELECT chain, (SELECT vol FROM b y WHERE y.chain = b.chain ORDER BY abs(strike - spot), n LIMIT 1) AS atm_iv, (SELECT vol FROM b y WHERE y.chain = b.chain ORDER BY abs(dc - 0.25), n LIMIT 1) AS c25,
 (SELECT vol FROM b y WHERE y.chain = b.chain ORDER BY abs(dp + 0.25), n LIMIT 1) AS p25, (SELECT bend FROM b y WHERE y.chain = b.chain ORDER BY abs(strike - spot), n LIMIT 1) AS convexity, covar_pop(vol, x) / var_pop(x) AS skew_slope FROM b GROUP BY chain)
 SELECT chain, {', '.join(f'round({e}, 6) AS {n}' for n, e in zip(metrics, ('atm_iv', 'c25 - p25', '(c25 + p25) / 2 - atm_iv', 'skew_slope', 'convexity'), strict=True))} FROM k"""
    add("opt_smile_metrics", lambda s, d: smile_metrics(chain(s, d)).selectExpr("chain", *[f"round({m}, 6) AS {m}" for m in metrics]), smile)
    tenors = lambda s, d: contracts(s, d).selectExpr("brand AS chain", "t + key / 1e6 AS t", "vol")
    TENORS = f"SELECT brand AS chain, t + key / 1e6 AS t, vol FROM ({CONTRACTS})"
    add("opt_term_structure_slope", lambda s, d: term_structure_slope(tenors(s, d)).selectExpr("chain", "round(slope, 6) AS slope"), f"SELECT chain, round(covar_pop(vol, t) / var_pop(t), 6) AS slope FROM ({TENORS}) GROUP BY chain")
    add("opt_interpolate", lambda s, d: interpolate(tenors(s, d), F.lit(0.2051237)).selectExpr("chain", "round(value, 6) AS value"),
        f"""WITH p AS ({TENORS}), l AS (SELECT chain, max(t) AS x, arg_max(vol, t) AS y FROM p WHERE t < 0.2051237 GROUP BY chain), h AS (SELECT chain, min(t) AS x, arg_min(vol, t) AS y FROM p WHERE t >= 0.2051237 GROUP BY chain)
 SELECT chain, round(CASE WHEN l.x IS NULL THEN h.y WHEN h.x IS NULL THEN l.y ELSE l.y + (0.2051237 - l.x) / (h.x - l.x) * (h.y - l.y) END, 6) AS value FROM l FULL JOIN h USING (chain)""")  # fmt: skip
    curve = lambda s, d: contracts(s, d).selectExpr("brand AS curve", "t + key / 1e6 AS tenor", "strike AS price", "1400.0 AS spot")
    CURVE = f"SELECT brand AS curve, t + key / 1e6 AS tenor, strike AS price, cast(1400 AS DOUBLE) AS spot FROM ({CONTRACTS})"
    lagged = f"SELECT *, (SELECT c.price FROM v c WHERE c.curve = v.curve AND c.n = v.n - 1) AS before FROM v"
    ordered = f"WITH v AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY tenor) AS n FROM ({CURVE})), l AS ({lagged})"
    add("fut_calendar_spreads", lambda s, d: calendar_spreads(curve(s, d)).selectExpr("curve", "round(tenor, 6) AS tenor", "round(spread, 6) AS spread"), f"{ordered} SELECT curve, round(tenor, 6) AS tenor, round(price - before, 6) AS spread FROM l WHERE before IS NOT NULL")
    add("fut_curve_summary", lambda s, d: curve_summary(curve(s, d)).selectExpr("curve", *[f"round({c}, 6) AS {c}" for c in ("front_basis", "average_basis", "slope")], "is_contango"),
        f"{ordered} SELECT curve, round(max(CASE WHEN n = 1 THEN price - spot END), 6) AS front_basis, round(avg(price - spot), 6) AS average_basis, round(covar_pop(price, tenor) / var_pop(tenor), 6) AS slope, count(*) FILTER (price < before) = 0 AS is_contango FROM l GROUP BY curve")
    add("fut_curve_slope", lambda s, d: curve_slope(curve(s, d)).selectExpr("curve", "round(slope, 6) AS slope"), f"SELECT curve, round(covar_pop(price, tenor) / var_pop(tenor), 6) AS slope FROM ({CURVE}) GROUP BY curve")
    grid = lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS key", "p_retailprice AS spot")
    GRID = "SELECT p_partkey AS key, p_retailprice AS spot FROM part"
    value = "SELECT key, spot, " + ", ".join(f"({_leg_price(leg)}) AS v{i}, ({_leg_delta(leg)}) AS d{i}" for i, leg in enumerate(LEGS)) + f" FROM ({GRID})"
    total = lambda x: " + ".join(f"{leg.scale!r} * {x}{i}" for i, leg in enumerate(LEGS))
    add("opt_legs_value", lambda s, d: strategy_value(grid(s, d), LEGS).selectExpr("key", f"{fixed('value', 3)} AS value"), f"SELECT key, {fixed(total('v'), 3)} AS value FROM ({value})")
    add("opt_legs_delta", lambda s, d: aggregate_greeks(grid(s, d), LEGS).selectExpr("key", f"{fixed('delta')} AS delta"), f"SELECT key, {fixed(total('d'))} AS delta FROM ({value})")
    pay = {"option": "greatest(0, {w} * (spot - {k})) - {p}"}
    gain = " + ".join(f"{leg.scale!r} * ({pay['option'].format(w=1 if leg.option_type == 'call' else -1, k=leg.strike, p=leg.premium) if leg.instrument == 'option' else f'spot - {leg.entry_price}'})" for leg in LEGS)
    add("opt_legs_payoff", lambda s, d: strategy_payoff(grid(s, d), LEGS).selectExpr("key", f"{fixed('payoff', 3)} AS payoff"), f"SELECT key, {fixed(gain, 3)} AS payoff FROM ({GRID})")


def _phi(x: str) -> str:
    """The normal distribution function by the approximation that prices use, as one expression."""
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    poly = f"{k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    return f"(0.5 + sign({x}) * (0.5 - exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {poly}))"


def _d1(spot: str, k: str, r: str, q: str, t: str, v: str) -> str:
    return f"((ln({spot} / {k}) + ({r} - {q} + {v} * {v} / 2) * {t}) / ({v} * sqrt({t})))"


def _delta_sql(call: str) -> str:
    return f"exp(-carry * t) * ({_phi(_d1('spot', 'strike', 'rate', 'carry', 't', 'vol'))} - {1 - int(call)})"


def _leg_price(leg: PayoffLeg) -> str:
    if leg.instrument != "option":
        return f"spot - {leg.entry_price}"
    d1 = _d1("spot", *(repr(x) for x in (leg.strike, leg.rate, leg.carry, leg.t, leg.vol)))
    w = 1 if leg.option_type == "call" else -1
    return f"{w} * (spot * exp({-leg.carry * leg.t!r}) * {_phi(f'({w} * {d1})')} - {leg.strike!r} * exp({-leg.rate * leg.t!r}) * {_phi(f'({w} * ({d1} - {leg.vol * leg.t**0.5!r}))')}) - {leg.premium!r}"


def _leg_delta(leg: PayoffLeg) -> str:
    if leg.instrument != "option":
        return "1.0"
    return f"exp({-leg.carry * leg.t!r}) * ({_phi(_d1('spot', *(repr(x) for x in (leg.strike, leg.rate, leg.carry, leg.t, leg.vol))))} - {0 if leg.option_type == 'call' else 1})"


def _bsm_sql(vol: str = "vol") -> str:
    d1 = _d1("spot", "strike", "rate", "carry", "t", vol)
    w = "(CASE WHEN is_call = 1 THEN 1 ELSE -1 END)"
    return f"{w} * (spot * exp(-carry * t) * {_phi(f'({w} * {d1})')} - strike * exp(-rate * t) * {_phi(f'({w} * ({d1} - {vol} * sqrt(t)))')})"


def pricing_sql(base: str) -> dict[str, str]:
    """The priced and derived columns of single contracts, from the textbook in another form than the stages; root finding as recursion."""
    density = "exp(-d1 * d1 / 2) / sqrt(2 * pi())"
    d1 = _d1("spot", "strike", "rate", "carry", "t", "vol")
    rows = f"SELECT *, {d1} AS d1, {d1} - vol * sqrt(t) AS d2, exp(-rate * t) AS dr, exp(-carry * t) AS dq, CASE WHEN is_call = 1 THEN 1 ELSE -1 END AS w FROM ({base})"
    up, down = _phi("(w * d1)"), _phi("(w * d2)")
    cols = {
        "opt_bsm_price": {"price": f"w * (spot * dq * {up} - strike * dr * {down})"},
        "opt_greeks": {
            "delta": f"w * dq * {up}", "gamma": f"dq * {density} / (spot * vol * sqrt(t))", "vega": "strike * dr * exp(-d2 * d2 / 2) / sqrt(2 * pi()) * sqrt(t)",
            "theta": f"-spot * dq * {density} * vol / (2 * sqrt(t)) + w * (carry * spot * dq * {up} - rate * strike * dr * {down})", "rho": f"w * strike * t * dr * {down}",
        },
        "opt_digital": {"cash": f"dr * {down}", "asset": f"spot * dq * {up}"},
        "opt_price_bounds": {"lower_bound": "greatest(0, w * (spot * dq - strike * dr))", "upper_bound": "CASE WHEN w > 0 THEN spot * dq ELSE strike * dr END"},
    }
    out = {n: f"SELECT key, ts, {', '.join(f'{fixed(e)} AS {c}' for c, e in made.items())} FROM ({rows})" for n, made in cols.items()}
    forward = "(ln(spot / strike) + vol * vol / 2 * t) / (vol * sqrt(t))"
    price = f"exp(-rate * t) * w * (spot * {_phi('(w * d)')} - strike * {_phi('(w * (d - vol * sqrt(t)))')})"
    out["opt_black76_price"] = f"SELECT key, ts, {fixed(price)} AS price FROM (SELECT *, {forward} AS d, CASE WHEN is_call = 1 THEN 1 ELSE -1 END AS w FROM ({base}))"
    middle = "((low + high) / 2)"
    steps = f"SELECT key, CASE WHEN under THEN mid ELSE low END, CASE WHEN under THEN high ELSE mid END, n + 1 FROM (SELECT r.*, {middle} AS mid, {_bsm_sql(middle)} < price AS under FROM r JOIN p USING (key) WHERE n < 60)"
    out["opt_implied_volatility"] = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT c.*, {_bsm_sql()} AS price FROM ({base}) c), r(key, low, high, n) AS (SELECT key, 1e-6::DOUBLE, 10.0::DOUBLE, 0 FROM p UNION ALL {steps})
 SELECT p.key, round((low + high) / 2, 3) AS iv, round(price, 6) AS price FROM r JOIN p USING (key) WHERE n = 60"""
    out["opt_american"] = _american_sql(base)
    return out


def _american_sql(base: str) -> str:
    """Barone-Adesi and Whaley: the critical price by bisection instead of Newton steps."""

    def euro(x: str) -> str:
        d = _d1(x, "strike", "rate", "carry", "t", "vol")
        return f"(w * ({x} * dq * {_phi(f'(w * {d})')} - strike * dr * {_phi(f'(w * ({d} - vol * sqrt(t)))')}))"

    def left(x: str) -> str:
        return f"(1 - dq * {_phi('(w * ' + _d1(x, 'strike', 'rate', 'carry', 't', 'vol') + ')')})"

    drift = "(2 * (rate - carry) / (vol * vol))"
    root = f"(1 - {drift} + w * sqrt(power({drift} - 1, 2) + 8 * rate / (vol * vol) / (1 - exp(-rate * t)))) / 2"
    rows = f"SELECT *, {root} AS g, exp(-rate * t) AS dr, exp(-carry * t) AS dq FROM (SELECT *, CASE WHEN is_call = 1 THEN 1 ELSE -1 END AS w FROM ({base}))"
    gap = f"w * (m - strike) - {euro('m')} - w * {left('m')} * m / g"
    steps = f"""r(key, low, high, n) AS (SELECT key, CASE WHEN w > 0 THEN strike ELSE strike / 1e6 END, CASE WHEN w > 0 THEN strike * 1e6 ELSE strike END, 0 FROM p
 UNION ALL SELECT key, CASE WHEN w * gap < 0 THEN m ELSE low END, CASE WHEN w * gap < 0 THEN high ELSE m END, n + 1 FROM (SELECT key, low, high, n, w, m, {gap} AS gap FROM (SELECT p.*, low, high, n, sqrt(low * high) AS m FROM r JOIN p USING (key) WHERE n < 100)))"""
    extra = f"w * (c / g) * {left('c')} * power(spot / c, g)"
    got = f"SELECT *, {euro('spot')} AS european, CASE WHEN w * (c - spot) > 0 THEN {euro('spot')} + {extra} ELSE w * (spot - strike) END AS early FROM (SELECT p.*, sqrt(low * high) AS c FROM r JOIN p USING (key) WHERE n = 100)"
    american = "CASE WHEN (w > 0 AND carry <= 0) OR (w < 0 AND rate <= 0) THEN european ELSE greatest(early, european) END"
    return f"WITH RECURSIVE p AS MATERIALIZED ({rows}), {steps} SELECT key, round(european, 4) AS european, round({american}, 4) AS american, round({american} - european, 4) AS premium FROM ({got})"


def _black76_sql(base: str, shown: str) -> str:
    def price(t: str) -> str:
        d1 = f"((ln(spot / strike) + vol * vol / 2 * {t}) / (vol * sqrt({t})))"
        return f"exp(-rate * {t}) * CASE WHEN is_call = 1 THEN spot * {_phi(d1)} - strike * {_phi(f'({d1} - vol * sqrt({t}))')} ELSE strike * {_phi(f'(vol * sqrt({t}) - {d1})')} - spot * {_phi(f'(-{d1})')} END"

    rows = f"SELECT *, (ln(spot / strike) + vol * vol / 2 * t) / (vol * sqrt(t)) AS d1, greatest(t - least(t, 1 / 365.0), 1e-8) AS t0, t + least(t, 1 / 365.0) AS t1 FROM ({base}) WHERE t > 0"
    made = f"""SELECT key, exp(-rate * t) * ({_phi('d1')} - CASE WHEN is_call = 1 THEN 0 ELSE 1 END) AS delta, exp(-rate * t - d1 * d1 / 2) / sqrt(2 * pi()) / (spot * vol * sqrt(t)) AS gamma,
 exp(-rate * t - d1 * d1 / 2) / sqrt(2 * pi()) * spot * sqrt(t) AS vega, ({price('t0')} - ({price('t1')})) / (t1 - t0) AS theta, -t * {price('t')} AS rho FROM ({rows})"""
    return f"SELECT key, {shown} FROM ({made})"


def _digital_sql(base: str, shown: str) -> str:
    def price(spot: str, vol: str) -> str:
        d2 = f"({_d1(spot, 'strike', 'rate', 'carry', 't', vol)} - {vol} * sqrt(t))"
        return f"exp(-rate * t) * CASE WHEN is_call = 1 THEN {_phi(d2)} ELSE {_phi(f'(-{d2})')} END"

    up, down, mid = price("(spot * 1.001)", "vol"), price("(spot * 0.999)", "vol"), price("spot", "vol")
    made = f"SELECT key, ({up} - {down}) / (0.002 * spot) AS delta, ({up} - 2 * {mid} + {down}) / (1e-6 * spot * spot) AS gamma, ({price('spot', '(vol + 0.001)')} - {price('spot', '(vol - 0.001)')}) / 0.002 AS vega FROM ({base}) WHERE t > 0"
    return f"SELECT key, {shown} FROM ({made})"
