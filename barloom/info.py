"""What there is: indicators, methods, and what they take."""

from __future__ import annotations

import importlib
import inspect
import pkgutil

import barloom
from barloom.operators import features, patterns
from barloom.operators.recurrences import RECURRENCES
from barloom.operators.window_indicators import INDICATORS

VERSION = "0.2.0"
MODULES = ("operators", "functions", "sources", "streaming")


def indicators(category: str | None = None) -> list[str]:
    """Names; category: window, recurrence, pattern or custom."""
    groups = {"window": {*features.MAKERS, *INDICATORS}, "recurrence": {*RECURRENCES}, "pattern": {*patterns.RULES}, "custom": {*features._CUSTOM}}
    if category is not None and category not in groups:
        raise ValueError(f"category is one of {', '.join(groups)}")
    return sorted(groups[category] if category else set().union(*groups.values()))


def methods(category: str | None = None) -> dict[str, list[str]]:
    """Public functions and classes by module."""
    out: dict[str, list[str]] = {}
    for part in MODULES if category is None else (category,):
        package = importlib.import_module(f"barloom.{part}")
        for m in pkgutil.iter_modules(package.__path__):
            module = importlib.import_module(f"barloom.{part}.{m.name}")
            out[f"{part}.{m.name}"] = sorted(n for n, f in vars(module).items() if not n.startswith("_") and (inspect.isfunction(f) or inspect.isclass(f)) and f.__module__ == module.__name__)
    return out


def about() -> dict[str, str | int]:
    return {"name": "barloom", "version": VERSION, "indicators": len(indicators()), "doc": (barloom.__doc__ or "").strip()}


def describe_indicator(name: str) -> dict:
    """Its kind, its parameters with their defaults, and its outputs."""
    from barloom.plans.staged import outputs

    key = name.upper()
    if key in features.MAKERS:
        f = features.MAKERS[key]
        return {"name": key, "kind": "window", "parameters": _defaults(f), "outputs": outputs(f())}
    if key in RECURRENCES:
        ins, kernel, outs = RECURRENCES[key]
        back = {v: k for k, v in reversed(features.RENAMED.items())}
        return {"name": key, "kind": "recurrence", "parameters": {back.get(k, k): v for k, v in _defaults(kernel).items() if k not in ins}, "outputs": list(outs)}
    if key in INDICATORS:
        return {"name": key, "kind": "window", "parameters": {}, "outputs": outputs(INDICATORS[key])}
    if key in patterns.RULES:
        return {"name": key, "kind": "pattern", "parameters": {}, "outputs": [key.lower()], "bars": patterns.RULES[key][0]}
    return {"name": key, "kind": "custom", "parameters": _defaults(features.get_indicator(key)), "outputs": []}


def _defaults(f) -> dict:
    return {n: p.default for n, p in inspect.signature(f).parameters.items() if p.kind is p.POSITIONAL_OR_KEYWORD and n != "k" and p.default is not p.empty}


def info(what) -> dict:
    """Signature and docstring of a function, or of an indicator by name."""
    if isinstance(what, str):
        return describe_indicator(what)
    return {"name": what.__name__, "module": what.__module__, "signature": str(inspect.signature(what)), "doc": inspect.getdoc(what) or ""}
