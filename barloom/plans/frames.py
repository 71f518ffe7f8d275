"""Window frames and guards, as SQL text that Spark's parser (and any ANSI engine) reads.

Series are rows (key, ts, bar, ...), bar counting from 0 within a key. A value that needs p rows is NULL until p
non-null ones are there. Divisions go by NULLIF, so a zero denominator gives NULL.
"""

from __future__ import annotations

L = "OVER (PARTITION BY key ORDER BY ts)"
CUM = "OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def W(p: int) -> str:
    return f"OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


def before(p: int) -> str:
    """The p rows before this one."""
    return f"OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN {p} PRECEDING AND 1 PRECEDING)"


def full(x: str, p: int, e: str) -> str:
    return f"CASE WHEN count({x}) {W(p)} = {p} THEN {e} END"


def agg(f: str, x: str, p: int) -> str:
    return full(x, p, f"{f}({x}) {W(p)}")


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {L}" if k >= 0 else f"lead({x}, {-k}) {L}"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def wma(x: str, p: int) -> str:
    """Weights 1..p, the newest row p: the mean, and how the values go with the row numbers (which stays exact on long series)."""
    return full(x, p, f"avg({x}) {W(p)} + 2 * covar_pop({x}, bar) {W(p)} / {p + 1}.0")


# Digits kept of results for comparison where 4 would be more than doubles of their size hold alike.
DIGITS = {"var": 1, "mult": 1, "ad": 2, "adosc": 2, "vwap": 6}


def fixed(e: str, digits: int = 4) -> str:
    """e rounded half up by the same arithmetic in any engine."""
    return f"floor(cast({e} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits}"
