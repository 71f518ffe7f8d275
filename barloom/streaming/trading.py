"""Trading on streams: a close-only backtest and a paper account, a state for each key, one output row for each bar."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.functions.account import SAME, Account, Fill, Rules
from barloom.functions.commission import Commission
from barloom.streaming.indicators import keyed_steps

NAN = float("nan")


@dataclass
class StreamingBacktest:
    """Positions taken at the close that the signal comes with; slippage scales the equity, commission is taken off it."""

    commission_per_trade: float = 0.0
    slippage_bps: float = 0.0
    position: float = 0.0
    entry: float = NAN
    equity: float = 1.0
    close: float = NAN
    total_commission: float = 0.0
    wins: list[float] = field(default_factory=lambda: [0, 0.0])  # how many, their sum
    losses: list[float] = field(default_factory=lambda: [0, 0.0])

    @property
    def n_trades(self) -> int:
        return int(self.wins[0] + self.losses[0])

    def step(self, close: float, signal: float) -> tuple[float, float, float, float]:
        """position, bar_return, equity, n_trades after a bar."""
        made = 0.0
        if self.position and not math.isnan(self.close):
            made = self.position * (close / self.close - 1)
            self.equity *= 1 + made
        want = 0.0 if signal is None or math.isnan(signal) else signal
        if abs(want - self.position) > SAME:
            self.equity = self.equity * (1 - self.slippage_bps / 10_000) - self.commission_per_trade
            self.total_commission += self.commission_per_trade
            if self.position:
                gain = self.position * (close / self.entry - 1)
                side = self.wins if gain >= 0 else self.losses
                side[0] += 1
                side[1] += abs(gain)
            self.position, self.entry = want, close if want else NAN
        self.close = close
        return self.position, made, self.equity, float(self.n_trades)

    def summary(self) -> dict[str, float]:
        mean = lambda side: side[1] / side[0] if side[0] else 0.0
        win, gain, loss = self.wins[0] / self.n_trades if self.n_trades else 0.0, mean(self.wins), mean(self.losses)
        kelly = min(1.0, max(0.0, win - (1 - win) * loss / gain)) if gain > 0 else 0.0
        return {"equity": self.equity, "n_trades": self.n_trades, "total_commission": self.total_commission, "win_rate": win, "avg_win": gain, "avg_loss": loss, "kelly_fraction": kelly}

    def reset(self) -> None:
        self.__init__(self.commission_per_trade, self.slippage_bps)


class _PaperAccount(Account):
    """Costs of a fill go by weight times price."""

    def _fee(self, price: float, weight: float, is_buy: bool) -> float:
        r = self.rules
        return r.commission.cost_fraction(weight * price * r.initial_capital, 1.0, is_buy, r.initial_capital)


class PaperTrader:
    """Bars one by one: a signal is acted on at the next bar's open; stops and goals as in the account."""

    def __init__(self, initial_capital: float = 100_000.0, stop_loss_pct: float = 0.0, take_profit_pct: float = 0.0, trailing_stop_pct: float = 0.0, breakeven_pct: float = 0.0, slippage_bps: float = 0.0, commission: Commission | None = None):
        self.rules = Rules(initial_capital=initial_capital, stop_loss_pct=stop_loss_pct, take_profit_pct=take_profit_pct, trailing_stop_pct=trailing_stop_pct, breakeven_pct=breakeven_pct, slippage_bps=slippage_bps, commission=commission or Commission())
        self.reset()

    def reset(self) -> None:
        self.account, self.equity, self.bar, self.pending = _PaperAccount(self.rules), 1.0, -1, 0.0
        self.trades: list[dict] = []
        self.open_trade: tuple[int, float, float] | None = None  # bar, price, position
        self.equity_curve: list[float] = []

    @property
    def position(self) -> float:
        return self.account.position

    @property
    def equity_abs(self) -> float:
        return self.equity * self.rules.initial_capital

    def step(self, open: float, high: float, low: float, close: float, signal: float) -> tuple[float, float, float, float]:
        """position, fill price (NaN: none), equity, gain of the bar."""
        before = self.account.position
        want, self.pending = self.pending, 0.0 if signal is None or math.isnan(signal) else signal
        self.bar += 1
        fill: Fill = self.account.step(open, high, low, close, want)
        worth, self.equity = self.equity, self.equity * (1 + fill.strategy_return)
        self.equity_curve.append(self.equity)
        if not math.isnan(fill.fill_price):
            if before and self.open_trade:
                at, price, held = self.open_trade
                gain = held * (fill.fill_price / price - 1) if price else 0.0
                self.trades.append({"entry_bar": at, "exit_bar": self.bar, "entry_price": price, "exit_price": fill.fill_price, "position": held, "pnl_pct": gain, "pnl_abs": gain * self.rules.initial_capital})
            self.open_trade = (self.bar, fill.fill_price, fill.position) if fill.position else None
        return fill.position, fill.fill_price, self.equity, self.equity - worth


def stream_backtest(bars: DataFrame, **params) -> DataFrame:
    """key, ts, position, bar_return, equity, n_trades for a stream (or a table) of bars with signals."""
    return keyed_steps(bars, StreamingBacktest, ("close", "signal"), ("position", "bar_return", "equity", "n_trades"), params)


def stream_paper_trader(bars: DataFrame, **params) -> DataFrame:
    """key, ts, position, fill_price, equity, pnl_bar."""
    return keyed_steps(bars, PaperTrader, ("open", "high", "low", "close", "signal"), ("position", "fill_price", "equity", "pnl_bar"), params)


def register(add, src) -> None:
    from barloom.plans.account_sql import account_sql
    from barloom.plans.frames import W, fixed
    from barloom.streaming.indicators import as_stream, run_available

    hourly, HOURLY = src["hourly"], src["HOURLY"]
    numbered = f"SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS bar FROM ({HOURLY})"
    signal = f"CASE WHEN bar >= 9 THEN CASE WHEN avg(close) {W(3)} > avg(close) {W(10)} THEN 0.0101 ELSE -0.0101 END END"

    def signals(s, d):
        from barloom.sources.bars import numbered as number

        return s.sql(f"SELECT key, ts, open, high, low, close, cast({signal} AS DOUBLE) AS signal FROM {{b}}", b=number(hourly(s, d)))

    cols = ["position", "bar_return", "equity", "n_trades"]
    add("stream_backtest", lambda s, d: run_available(stream_backtest(as_stream(signals(s, d)), slippage_bps=5.0)).selectExpr("key", "ts", *[f"{fixed(c)} AS {c}" for c in cols]),
        f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, {signal} AS signal FROM ({numbered})),
 r(key, bar, pos, entry, eq, c0, made, n) AS (SELECT key, bar, coalesce(signal, 0.0)::DOUBLE, close, 1.0::DOUBLE, close, 0.0::DOUBLE, 0 FROM b WHERE bar = 0
 UNION ALL SELECT key, bar, want, CASE WHEN changed THEN close ELSE entry END, grown * CASE WHEN changed THEN 0.9995 ELSE 1 END, close, gain, n + CASE WHEN changed AND pos <> 0 THEN 1 ELSE 0 END FROM (
  SELECT *, eq * (1 + gain) AS grown, abs(want - pos) > 1e-12 AS changed FROM (
   SELECT r.key, b.bar, r.pos, r.entry, r.eq, r.n, b.close, coalesce(b.signal, 0.0)::DOUBLE AS want, CASE WHEN r.c0 = 0 THEN 0.0 ELSE r.pos * (b.close / r.c0 - 1) END AS gain FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1)))
 SELECT key, ts, {fixed('pos')} AS position, {fixed('made')} AS bar_return, {fixed('eq')} AS equity, {fixed('n')} AS n_trades FROM r JOIN b USING (key, bar)""")  # fmt: skip
    paper = ["position", "fill_price", "equity", "pnl_bar"]
    rules = Rules(stop_loss_pct=0.301237, trailing_stop_pct=0.501237, slippage_bps=5.1237)
    got = account_sql(f"SELECT *, {signal} AS signal, cast(NULL AS DOUBLE) AS limit_price FROM ({numbered})", rules, 12)
    add("stream_paper_trader", lambda s, d: run_available(stream_paper_trader(as_stream(signals(s, d)), stop_loss_pct=0.301237, trailing_stop_pct=0.501237, slippage_bps=5.1237)).selectExpr("key", "ts", *[f"{fixed(c)} AS {c}" for c in paper]),
        f"""WITH a AS ({got}) SELECT key, ts, {fixed('position')} AS position, {fixed('fill_price')} AS fill_price, {fixed('equity')} AS equity,
 {fixed('equity - coalesce(lag(equity) OVER (PARTITION BY key ORDER BY ts), 1.0)')} AS pnl_bar FROM a""")  # fmt: skip
