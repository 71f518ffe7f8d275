"""A simulated account that takes bars one by one: orders, stops, limits on losses, margin and costs.

Stops and goals are seen from the position's side: what is ahead of a long position lies above, of a short one below. Positions are
weights of the capital; every return is a share of it. The order within a bar: margin call, trailing stop, halt after losses, stop and
goal (if both are met, the one nearer to the open), time limit, limit and market orders, borrowing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from barloom.functions.commission import Commission

NAN = float("nan")
SAME = 1e-12


@dataclass(frozen=True)
class Rules:
    """0 switches a rule off."""

    fill_mode: str = "market_open"  # or market_close
    stop_loss_pct: float = 0.0
    take_profit_pct: float = 0.0
    trailing_stop_pct: float = 0.0
    breakeven_pct: float = 0.0
    max_hold_bars: int = 0
    slippage_bps: float = 0.0
    slippage_pct_range: float = 0.0
    margin_ratio: float = 0.0
    margin_call_pct: float = 0.5
    daily_loss_limit: float = 0.0
    total_loss_limit: float = 0.0
    initial_capital: float = 100_000.0
    periods_per_year: float = 252.0
    commission: Commission = field(default_factory=Commission)

    def __post_init__(self) -> None:
        if self.fill_mode not in ("market_open", "market_close"):
            raise ValueError("fill_mode is market_open or market_close")
        bad = [k for k, v in vars(self).items() if isinstance(v, (int, float)) and not v >= 0]
        if bad:
            raise ValueError(f"{', '.join(bad)} must not be negative")


class Fill(NamedTuple):
    position: float
    fill_price: float
    bar_return: float
    strategy_return: float


class Account:
    """State between bars; `step` gives what the bar did."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.close: float | None = None
        self.halted, self.worth, self.last = False, 1.0, 0.0
        self._flat()

    def _flat(self) -> None:
        self.position = 0.0
        self.entry = self.best = self.floor = NAN  # floor: the stop at the entry price, once it is armed
        self.age = 0
        self.margin, self.margin_entry = 0.0, NAN

    def _fee(self, price: float, weight: float, is_buy: bool) -> float:
        return self.rules.commission.of_weight(price, weight, is_buy, self.rules.initial_capital)

    def _moved(self, price: float, weight: float) -> float:
        """What a weight makes from the last close to a price."""
        return weight * (price - self.close) / self.close if self.close else 0.0

    def _leave(self, price: float, extra: float = 0.0) -> float:
        """Close the position; its return less costs."""
        made = self._moved(price, self.position) - extra - self._fee(price, abs(self.position), self.position < 0)
        self._flat()
        return made

    def step(self, open: float, high: float, low: float, close: float, want: float, limit: float = NAN) -> Fill:
        """want: the position asked for before this bar, limit: the price it is asked for at (NaN: any)."""
        if self.close is None:
            self.close = close
            return Fill(0.0, NAN, 0.0, 0.0)
        out = self._bar(open, high, low, close, want, limit)
        self.close, self.last = close, out.strategy_return
        return out

    def _bar(self, open: float, high: float, low: float, close: float, want: float, limit: float) -> Fill:
        r, began = self.rules, self.position
        if began and self.margin > 0 and self.margin_entry and self.margin + began * (open - self.margin_entry) / self.margin_entry <= r.margin_call_pct * self.margin:
            return Fill(0.0, open, 0.0, self._leave(open))
        at_open = r.fill_mode == "market_open"
        market = open if at_open else close
        slip = r.slippage_pct_range * (high - low) / close if r.slippage_pct_range > 0 and close > 0 else r.slippage_bps / 10_000
        side = math.copysign(1.0, began) if began else 0.0
        ahead, behind = (high, low) if side > 0 else (low, high)
        if side and r.trailing_stop_pct > 0:
            self.best = max(self.best, high) if side > 0 else min(self.best, low)
        moved = self._moved(close, 1.0)
        self.worth *= 1 + self.last
        self.halted = self.halted or 0 < r.daily_loss_limit < -self.last or (r.total_loss_limit > 0 and self.worth < 1 - r.total_loss_limit)
        if self.halted:
            return Fill(0.0, market, moved, self._leave(market)) if began else Fill(0.0, NAN, moved, 0.0)
        price, made = self._stopped(open, ahead, behind, side, slip)
        if began and self.position and r.max_hold_bars and self.age >= r.max_hold_bars:
            price = market * (1 - side * slip)
            made = self._leave(price)
        if not began or self.position:
            price, made = self._order(close, high, low, market, at_open, want, limit, slip, moved)
        if self.position < 0 and r.commission.short_borrow_rate_annual > 0:
            value = -self.position * (price if price > 0 else close)
            made -= r.commission.short_borrow_cost(value, r.periods_per_year)
        self.age = 0 if not self.position else self.age + 1 if began * self.position > 0 else 1
        return Fill(self.position, price, moved, made)

    def _stopped(self, open: float, ahead: float, behind: float, side: float, slip: float) -> tuple[float, float]:
        """Price and return if a stop or the goal was met; NaN and 0 otherwise."""
        r = self.rules
        if not side:
            return NAN, 0.0
        if r.trailing_stop_pct > 0:
            stop = self.best * (1 - side * r.trailing_stop_pct)
            if side * (behind - stop) <= 0:
                lost = 0.0 if self.close else abs(self.position) * r.trailing_stop_pct
                return stop, self._leave(stop, slip + lost)
        if r.breakeven_pct > 0 and math.isnan(self.floor) and side * (ahead - self.entry * (1 + side * r.breakeven_pct)) >= 0:
            self.floor = self.entry
        stop = self.floor if not math.isnan(self.floor) else self.entry * (1 - side * r.stop_loss_pct) if r.stop_loss_pct > 0 else NAN
        goal = self.entry * (1 + side * r.take_profit_pct) if r.take_profit_pct > 0 else NAN
        met = [p for p, hit in ((stop, side * (behind - stop) <= 0), (goal, side * (ahead - goal) >= 0)) if hit]
        if not met:
            return NAN, 0.0
        price = met[0] if len(met) == 1 or abs(open - stop) < abs(goal - open) else goal
        return price, self._leave(price, slip)

    def _order(self, close: float, high: float, low: float, market: float, at_open: bool, want: float, limit: float, slip: float, moved: float) -> tuple[float, float]:
        r, has = self.rules, self.position
        base = market
        if abs(want - has) > SAME and not math.isnan(limit):
            met = low <= limit if want > has else high >= limit
            want, base = (want, limit) if met else (has, market)
        if abs(want - has) <= SAME:
            self.position = want
            return NAN, has * moved
        price = base * (1 + slip if want > has else 1 - slip)
        if at_open and price:
            made = (self._moved(price, has) - self._fee(price, abs(has), has < 0)) if has else 0.0
            made += (want * (close - price) / price - self._fee(price, abs(want), want > 0)) if want else 0.0
        else:
            made = has * moved - self._fee(close or 1.0, abs(want - has), want > has)
        if not want:
            self._flat()
            return price, made
        turned = has * want <= 0
        self.entry = self.best = price
        if has and turned:
            self.floor = NAN
        if turned and r.margin_ratio > 0:
            self.margin, self.margin_entry = abs(want) * r.margin_ratio, price
        self.position = want
        return price, made


def simulate(open, high, low, close, signal, rules: Rules, limit=None) -> dict[str, np.ndarray]:
    """Whole series: the signal and the limit price of a bar are acted on in the next one; missing signals ask for no position."""
    n = len(close)
    want = np.concatenate(([0.0], np.nan_to_num(np.asarray(signal, dtype=float))[:-1])) if n else np.empty(0)
    at = np.full(n, NAN) if limit is None else np.concatenate(([NAN], np.asarray(limit, dtype=float)[:-1]))
    account = Account(rules)
    cols = (np.asarray(x, dtype=float).tolist() for x in (open, high, low, close, want, at))
    fills = [account.step(*bar) for bar in zip(*cols, strict=True)]
    out = {name: np.array([f[k] for f in fills], dtype=float) for k, name in enumerate(Fill._fields)}
    out["equity"] = np.cumprod(1 + out["strategy_return"])
    return out
