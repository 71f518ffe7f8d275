"""Defaults of parameters: for all indicators (`timeperiod`) or one (`RSI.timeperiod`), held in a context of their own for each thread or task."""

from __future__ import annotations

from contextvars import ContextVar
from typing import Any

_DEFAULTS: ContextVar[dict[str, Any] | None] = ContextVar("barloom_defaults", default=None)


def list_defaults() -> dict[str, Any]:
    return dict(_DEFAULTS.get() or {})


def set_default(key: str, value: Any) -> None:
    if not key or key.startswith(".") or key.endswith("."):
        raise ValueError(f"not a parameter's name: {key!r}")
    _DEFAULTS.set(list_defaults() | {key: value})


def get_default(key: str, fallback: Any = None) -> Any:
    """What is set for the name, else for its last part, else the fallback."""
    found = list_defaults()
    return found.get(key, found.get(key.rpartition(".")[2], fallback))


def get_defaults_for(indicator: str) -> dict[str, Any]:
    """Parameters of one indicator: common ones, and its own over them."""
    found, own = list_defaults(), f"{indicator.upper()}."
    return {k: v for k, v in found.items() if "." not in k} | {k.split(".", 1)[1]: v for k, v in found.items() if k.upper().startswith(own)}


def reset(key: str | None = None) -> None:
    _DEFAULTS.set({} if key is None else {k: v for k, v in list_defaults().items() if k != key})


class Config:
    """`with Config(timeperiod=20, RSI__timeperiod=7):` sets defaults for a block."""

    def __init__(self, **defaults: Any):
        self.defaults = {k.replace("__", "."): v for k, v in defaults.items()}

    def __enter__(self) -> Config:
        self._token = _DEFAULTS.set(list_defaults() | self.defaults)
        return self

    def __exit__(self, *_) -> None:
        _DEFAULTS.reset(self._token)
