"""Error types, and checks of parameters and series before a plan is made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BarloomError(Exception):
    """Base of all errors here; `code` names the kind, `hint` says what to do."""

    code = "E000"

    def __init__(self, message: str, hint: str | None = None):
        self.hint = hint
        super().__init__(f"[{self.code}] {message}" + (f" ({hint})" if hint else ""))


class ParameterError(BarloomError, ValueError):
    code = "E001"


class InputError(BarloomError, ValueError):
    code = "E002"


class PeriodError(ParameterError):
    code = "E003"


class TooShortError(InputError):
    code = "E004"


class LengthMismatchError(InputError):
    code = "E005"


class ConvergenceError(ParameterError):
    code = "E006"


class InvalidInputError(InputError):
    code = "E007"


class RegistryError(BarloomError, KeyError):
    code = "E008"


def check_timeperiod(value: int, name: str = "timeperiod", minimum: int = 1) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise PeriodError(f"{name} must be a whole number, not {value!r}")
    if value < minimum:
        raise PeriodError(f"{name} must be at least {minimum}, not {value}", f"pass {name}={minimum} or more")


def check_equal_length(**arrays) -> None:
    sizes = {k: len(v) for k, v in arrays.items() if v is not None}
    if len(set(sizes.values())) > 1:
        raise LengthMismatchError(f"lengths differ: {', '.join(f'{k}={n}' for k, n in sizes.items())}")


def check_finite(df: DataFrame, column: str) -> None:
    """No null, NaN or infinite value in the column. This runs a job."""
    c = F.col(column)
    if not df.filter(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).isEmpty():
        raise InvalidInputError(f"{column} holds missing or infinite values")


def check_min_length(df: DataFrame, minimum: int, by: str = "key") -> None:
    """At least so many rows for every key. This runs a job."""
    short = df.groupBy(by).count().filter(F.col("count") < minimum).orderBy(by).first()
    if short:
        raise TooShortError(f"{by} {short[by]!r} has {short['count']} rows, {minimum} are needed")
