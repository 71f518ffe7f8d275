"""Running staged SQL expressions on a DataFrame, and writing the same stages as one SQL query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from barloom.plans.frames import DIGITS, W, fixed

Stages = list[dict[str, str]]


def _spark(e: str) -> str:
    e = re.sub(r"\{maxat:(\w+):(\d+)\}", lambda m: f"(max(named_struct('v', {m[1]}, 'b', bar)) {W(int(m[2]))}).b", e)
    return re.sub(r"\{minat:(\w+):(\d+)\}", lambda m: f"-(min(named_struct('v', {m[1]}, 'b', -bar)) {W(int(m[2]))}).b", e)


def _plain(e: str) -> str:
    e = re.sub(r"\{maxat:(\w+):(\d+)\}", lambda m: f"(max({{'v': {m[1]}, 'b': bar}}) {W(int(m[2]))})['b']", e)
    return re.sub(r"\{minat:(\w+):(\d+)\}", lambda m: f"-((min({{'v': {m[1]}, 'b': -bar}}) {W(int(m[2]))})['b'])", e)


def outputs(stages: Stages) -> list[str]:
    return [c for s in stages for c in s if not c.startswith("_")]


def apply_stages(df: DataFrame, stages: Stages) -> DataFrame:
    """df with the stages' columns; helpers are dropped."""
    made = [c for s in stages for c in s]
    for s in stages:
        df = df.selectExpr("*", *[f"{_spark(e)} AS {c}" for c, e in s.items()])
    return df.drop(*[c for c in made if c.startswith("_")])


def rounded(names: list[str]) -> list[str]:
    return [f"{fixed(c, DIGITS.get(c, 4))} AS {c}" for c in names]


def as_sql(base: str, stages: Stages) -> str:
    """One query over the query `base`, with results rounded."""
    for s in stages:
        base = f"SELECT *, {', '.join(f'{_plain(e)} AS {c}' for c, e in s.items())} FROM ({base})"
    return f"SELECT key, ts, {', '.join(rounded(outputs(stages)))} FROM ({base})"
