"""The simulated account as one recursive query, to hold the kernel's results against: a row of state, carried from bar to bar."""

from __future__ import annotations

from barloom.functions.account import Rules

STATE = ("pos", "entry", "best", "flr", "age", "halted", "worth", "ret", "fill", "moved", "c0", "deposit", "m_entry")


def account_sql(base: str, rules: Rules, digits: int = 8) -> str:
    """base: key, ts, bar, open, high, low, close, signal, limit_price."""
    r, c = rules, rules.commission
    at_open = r.fill_mode == "market_open"
    slip = f"CASE WHEN close > 0 THEN {r.slippage_pct_range!r} * (high - low) / close ELSE {r.slippage_bps / 10_000!r} END" if r.slippage_pct_range > 0 else repr(r.slippage_bps / 10_000)

    def fee(weight: str, price: str, buy: str) -> str:
        value = f"({weight}) * {r.initial_capital!r}"
        cost = c.cost(value, f"ceil({value} / ({c.lot_size!r} * ({price})))", buy)
        return f"CASE WHEN ({weight}) > 0 AND ({price}) > 0 THEN {cost} / {r.initial_capital!r} ELSE 0.0 END"

    never = "false"
    on = lambda rule, said: said if rule else never
    stages = [
        {"side": "sign(pos)", "market": "open" if at_open else "close", "slip": slip, "called": f"coalesce(pos <> 0 AND deposit > 0 AND deposit + pos * (open - m_entry) / nullif(m_entry, 0) <= {r.margin_call_pct!r} * deposit, false)",
         "asked": "CASE WHEN lim IS NULL OR abs(want - pos) <= 1e-12 OR (want > pos AND low <= lim) OR (want < pos AND high >= lim) THEN want ELSE pos END", "mv": "coalesce((close - c0) / nullif(c0, 0), 0.0)", "grown0": "worth * (1 + ret)", "ahead": "CASE WHEN pos > 0 THEN high ELSE low END", "behind": "CASE WHEN pos > 0 THEN low ELSE high END"},
        {"top": "CASE WHEN side > 0 THEN greatest(best, high) WHEN side < 0 THEN least(best, low) END" if r.trailing_stop_pct else "best",
         "grown": "CASE WHEN called THEN worth ELSE grown0 END",
         "stopped": f"CASE WHEN called THEN halted ELSE halted OR {on(r.daily_loss_limit, f'ret < {-r.daily_loss_limit!r}')} OR {on(r.total_loss_limit, f'grown0 < {1 - r.total_loss_limit!r}')} END"},
        {"trail": f"top * (1 - side * {r.trailing_stop_pct!r})"},
        {"trailed": on(r.trailing_stop_pct, "side <> 0 AND side * (behind - trail) <= 0")},
        {"base": f"CASE WHEN {on(r.breakeven_pct, f'NOT trailed AND flr IS NULL AND side * (ahead - entry * (1 + side * {r.breakeven_pct!r})) >= 0')} THEN entry ELSE flr END"},
        {"stop": f"coalesce(base, {f'entry * (1 - side * {r.stop_loss_pct!r})' if r.stop_loss_pct else 'NULL'})", "goal": f"entry * (1 + side * {r.take_profit_pct!r})" if r.take_profit_pct else "cast(NULL AS DOUBLE)"},
        {"lost": "coalesce(side * (behind - stop) <= 0, false)", "won": "coalesce(side * (ahead - goal) >= 0, false)"},
        {"bracket": "CASE WHEN side = 0 THEN NULL WHEN trailed THEN trail WHEN lost AND (NOT won OR abs(open - stop) < abs(goal - open)) THEN stop WHEN won THEN goal END"},
        {"late": f"CASE WHEN {on(r.max_hold_bars, f'side <> 0 AND bracket IS NULL AND age >= {r.max_hold_bars}')} THEN market * (1 - side * slip) END"},
        {"way": "CASE WHEN called THEN 'called' WHEN stopped AND side <> 0 THEN 'halt' WHEN stopped THEN 'none' WHEN bracket IS NOT NULL THEN 'bracket' WHEN late IS NOT NULL THEN 'late' WHEN abs(asked - pos) > 1e-12 THEN 'order' ELSE 'keep' END"},
        {"px": "CASE way WHEN 'called' THEN open WHEN 'halt' THEN market WHEN 'bracket' THEN bracket WHEN 'late' THEN late WHEN 'order' THEN coalesce(lim, market) * CASE WHEN asked > pos THEN 1 + slip ELSE 1 - slip END END", "next": "CASE way WHEN 'order' THEN asked WHEN 'keep' THEN asked ELSE 0.0 END"},
        {"out_": f"CASE WHEN side <> 0 AND px IS NOT NULL THEN coalesce(pos * (px - c0) / nullif(c0, 0), 0.0) - ({fee('abs(pos)', 'px', 'pos < 0')}) ELSE 0.0 END",
         "in_": f"CASE WHEN next <> 0 AND px IS NOT NULL THEN next * (close - px) / px - ({fee('abs(next)', 'px', 'next > 0')}) ELSE 0.0 END"},
        {"made": f"CASE way WHEN 'none' THEN 0.0 WHEN 'keep' THEN pos * mv WHEN 'bracket' THEN out_ - slip WHEN 'order' THEN {'out_ + in_' if at_open else f"pos * mv - ({fee('abs(asked - pos)', 'close', 'asked > pos')})"} ELSE out_ END"},
        {"paid": f"made - CASE WHEN next < 0 THEN {c.short_borrow_rate_annual / r.periods_per_year!r} * abs(next) * coalesce(px, close) ELSE 0.0 END", "turned": "next <> 0 AND pos * next <= 0"},
        {"n_dep": f"CASE WHEN next = 0 THEN 0.0 WHEN turned THEN abs(next) * {r.margin_ratio!r} ELSE deposit END", "n_mentry": "CASE WHEN next = 0 THEN NULL WHEN turned THEN px ELSE m_entry END", "n_entry": "CASE WHEN next = 0 THEN NULL WHEN px IS NOT NULL THEN px ELSE entry END", "n_best": "CASE WHEN next = 0 THEN NULL WHEN px IS NOT NULL THEN px ELSE top END", "n_flr": "CASE WHEN next = 0 OR turned THEN NULL ELSE base END",
         "n_age": "CASE WHEN next = 0 THEN 0 WHEN turned THEN 1 ELSE age + 1 END"},
    ]
    step = "SELECT r.*, b.bar AS nb, b.open, b.high, b.low, b.close, coalesce(p.signal, 0.0) AS want, p.limit_price AS lim FROM r JOIN b ON b.key = r.key AND b.bar = r.bar + 1 JOIN b p ON p.key = r.key AND p.bar = r.bar"
    for st in stages:
        step = f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in st.items())} FROM ({step})"
    null = "cast(NULL AS DOUBLE)"
    names = ", ".join(STATE)
    return f"""WITH RECURSIVE b AS MATERIALIZED ({base}), r(key, bar, {names}) AS (
 SELECT key, bar, 0.0::DOUBLE, {null}, {null}, {null}, 0, false, 1.0::DOUBLE, 0.0::DOUBLE, {null}, 0.0::DOUBLE, close, 0.0::DOUBLE, {null} FROM b WHERE bar = 0
 UNION ALL SELECT key, nb, next, n_entry, n_best, n_flr, n_age, stopped, grown, paid, px, CASE WHEN called THEN 0.0 ELSE mv END, close, n_dep, n_mentry FROM ({step})),
 e AS (SELECT key, bar, product(1 + ret) OVER w AS equity FROM r WINDOW w AS (PARTITION BY key ORDER BY bar))
 SELECT b.key, b.ts, r.pos AS position, round(r.fill, {digits}) AS fill_price, round(r.moved, {digits}) AS bar_return, round(r.ret, {digits}) AS strategy_return, e.equity
 FROM r JOIN b ON b.key = r.key AND b.bar = r.bar JOIN e ON e.key = r.key AND e.bar = r.bar"""
