"""Named steps over bars, and the way from bars to signals, results and alerts in one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.alerts import AlertManager
from barloom.errors import ParameterError
from barloom.operators.execution import STRATEGIES, Engine
from barloom.operators.features import compute_many

Step = Callable[..., DataFrame]


@dataclass
class Pipeline:
    """Steps by name, each a function from a table to a table or the name of an indicator; `run` chains them into one plan."""

    steps: dict[str, tuple[str | Step, dict]] = field(default_factory=dict)

    def add(self, name: str, step: str | Step, **params) -> Pipeline:
        if name in self.steps:
            raise ParameterError(f"there is a step {name!r} already")
        if not (callable(step) or isinstance(step, str)):
            raise ParameterError("a step is a function or an indicator's name")
        self.steps[name] = (step, params)
        return self

    def remove(self, name: str) -> Pipeline:
        if name not in self.steps:
            raise ParameterError(f"there is no step {name!r}")
        del self.steps[name]
        return self

    def names(self) -> list[str]:
        return list(self.steps)

    def __len__(self) -> int:
        return len(self.steps)

    def run(self, bars: DataFrame) -> DataFrame:
        """bars and what the steps add: an indicator's column is called like its step, several are step_output."""
        out = bars
        for name, (step, params) in self.steps.items():
            if callable(step):
                out = out.transform(step, **params)
                continue
            before = set(out.columns)
            made = compute_many(out, [(step, params)])
            new = [c for c in made.columns if c not in before]
            prefix = f"{step.lower()}_"
            out = made.withColumnsRenamed({new[0]: name} if len(new) == 1 else {c: f"{name}_{c.removeprefix(prefix)}" for c in new})
        return out


def make_pipeline(**steps: tuple[str | Step, dict]) -> Pipeline:
    out = Pipeline()
    for name, (step, params) in steps.items():
        out.add(name, step, **params)
    return out


@dataclass
class Workflow:
    """Indicators, a strategy and alerts; `run` gives a table for each that was asked for."""

    indicators: list[tuple[str, str, dict]] = field(default_factory=list)
    strategy: tuple[str | Step, dict] | None = None
    engine: Engine = field(default_factory=Engine)
    alerts: AlertManager = field(default_factory=AlertManager)

    def add_indicator(self, name: str, indicator: str, **params) -> Workflow:
        self.indicators.append((name, indicator, params))
        return self

    def add_strategy(self, strategy: str | Step, engine: Engine | None = None, **params) -> Workflow:
        if isinstance(strategy, str) and strategy not in STRATEGIES:
            raise ParameterError(f"unknown strategy {strategy!r}", f"known: {', '.join(STRATEGIES)}")
        self.strategy, self.engine = (strategy, params), engine or self.engine
        return self

    def add_alert(self, column: str, level: float, direction: int = 1, condition_id: str | None = None) -> Workflow:
        self.alerts.add_threshold_condition(condition_id or f"{column}_{len(self.alerts.conditions)}", column, level, direction)
        return self

    def run(self, bars: DataFrame) -> dict[str, DataFrame]:
        pipe = Pipeline()
        for name, indicator, params in self.indicators:
            pipe.add(name, indicator, **params)
        out = {"indicators": pipe.run(bars)}
        if self.strategy:
            out["backtest"] = self.engine.run(bars, self.strategy[0], **self.strategy[1])
        if self.alerts.conditions:
            out["alerts"] = self.alerts.events(out["indicators"])
        return out


def run_pipeline(bars: DataFrame, indicators: dict[str, tuple[str, dict]] | None = None, strategy: str | Step | None = None, strategy_params: dict | None = None, alert: tuple[str, float, int] | None = None, engine: Engine | None = None) -> dict[str, DataFrame]:
    flow = Workflow()
    for name, (indicator, params) in (indicators or {}).items():
        flow.add_indicator(name, indicator, **params)
    if strategy:
        flow.add_strategy(strategy, engine, **(strategy_params or {}))
    if alert:
        flow.add_alert(*alert)
    return flow.run(bars)


def run_backtest(strategy: str | Step, bars: DataFrame, engine: Engine | None = None, **params) -> DataFrame:
    """The metrics of a strategy on every key."""
    chosen = engine or Engine()
    return chosen.metrics(chosen.run(bars, strategy, **params))


def register(add, src) -> None:
    from barloom.plans.frames import fixed
    from barloom.workers import workers_import

    bars, BARS = src["bars"], src["BARS"]

    def run(s, d):
        workers_import(s)
        pipe = make_pipeline(mean=("SMA", {"timeperiod": 8}), band=("DONCHIAN", {"timeperiod": 6}), spread=(lambda df: df.withColumn("spread", df["high"] - df["low"]), {}))
        return pipe.run(bars(s, d)).selectExpr("key", "ts", *[f"{fixed(c)} AS {c}" for c in ("mean", "band_upper", "band_middle", "band_lower", "spread")])

    past = "CASE WHEN bar >= {1} THEN (SELECT {0} FROM b x WHERE x.key = t.key AND x.bar >= t.bar - {1} AND x.bar <= t.bar) END"
    top, low = past.format("max(x.high)", 5), past.format("min(x.low)", 5)
    add("pipeline_steps", run, f"WITH b AS MATERIALIZED ({BARS}) SELECT key, ts, {fixed(past.format('avg(x.close)', 7))} AS mean, {fixed(top)} AS band_upper, {fixed(f'({top} + {low}) / 2')} AS band_middle, {fixed(low)} AS band_lower, {fixed('high - low')} AS spread FROM b t")
