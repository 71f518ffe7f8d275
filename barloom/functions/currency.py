"""Amounts of money as text: a function for one amount, and an expression for columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Currency:
    code: str
    symbol: str
    decimals: int = 2
    lakh: bool = False  # groups of two digits above the first three

    @staticmethod
    def from_code(code: str) -> Currency | None:
        return CURRENCIES.get(code.upper())

    def _parts(self, amount: float) -> tuple[str, str]:
        """Whole units and the rest, rounded half up before they are parted, so that 0.999 carries over."""
        whole, part = divmod(math.floor(abs(float(amount)) * 10**self.decimals + 0.5), 10**self.decimals)
        return str(whole), f".{part:0{self.decimals}d}" if self.decimals else ""

    def format(self, amount: float) -> str:
        whole, part = self._parts(amount)
        text = re.sub(GROUPS[self.lakh], ",", whole)
        return f"{'-' if amount < 0 else ''}{self.symbol}{text}{part}"

    def column(self, amount: Column) -> Column:
        """The same for a column; null stays null."""
        scale = 10**self.decimals
        units = F.floor((F.abs(amount) * scale + 0.5).cast("decimal(38,6)"))
        rest = units % F.lit(scale)
        whole = F.regexp_replace(((units - rest) / F.lit(scale)).cast("decimal(38,0)").cast("string"), GROUPS[self.lakh], ",")
        part = F.concat(F.lit("."), F.lpad(rest.cast("decimal(38,0)").cast("string"), self.decimals, "0")) if self.decimals else F.lit("")
        return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit(self.symbol), whole, part)


#: Where commas go: before every three digits; or before the last three and every two before those.
GROUPS = {False: r"(?<=\d)(?=(?:\d{3})+$)", True: r"(?<=\d)(?=(?:\d\d)*\d{3}$)"}
# Symbols and decimal places.
CURRENCIES = {c.code: c for c in (Currency("INR", "₹", lakh=True), Currency("USD", "$"), Currency("EUR", "€"), Currency("GBP", "£"), Currency("JPY", "¥", 0), Currency("USDT", "₮"))}


def format_currency(amount: float, currency: str | Currency = "INR") -> str:
    found = currency if isinstance(currency, Currency) else Currency.from_code(currency)
    if found is None:
        raise ValueError(f"unknown currency: {currency}")
    return found.format(amount)
