"""What a trade costs: brokerage, levies, spread and borrowing, as numbers for kernels and as SQL for columns."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Commission:
    """Rates are shares of the traded value; field names are those of the JSON form."""

    flat_per_order: float = 0.0
    rate_of_value: float = 0.0
    per_lot: float = 0.0
    max_brokerage: float = 0.0  # 0: no cap
    spread_bps: float = 0.0  # half of it is paid on each leg
    stt_rate: float = 0.0  # transaction tax
    stt_on_buy: bool = False
    stt_on_sell: bool = False
    exchange_charges_rate: float = 0.0
    regulatory_charges_rate: float = 0.0
    gst_rate: float = 0.0  # on brokerage, exchange and regulatory charges
    stamp_duty_rate: float = 0.0  # on buying only
    lot_size: float = 1.0
    short_borrow_rate_annual: float = 0.0

    def _charges(self) -> tuple[float, float, float]:
        """Rates of the value: always, when buying, when selling; gst on the levies included."""
        levies = (self.exchange_charges_rate + self.regulatory_charges_rate) * (1 + self.gst_rate) + self.spread_bps / 20_000
        return levies, self.stt_rate * self.stt_on_buy + self.stamp_duty_rate, self.stt_rate * self.stt_on_sell

    def cost(self, value: str, lots: str, is_buy: str) -> str:
        """The cost as a SQL expression over expressions."""
        broker = f"({self.flat_per_order!r} + {self.rate_of_value!r} * ({value}) + {self.per_lot!r} * ({lots}))"
        if self.max_brokerage > 0:
            broker = f"least({broker}, {self.max_brokerage!r})"
        always, buying, selling = self._charges()
        return f"({broker} * {1 + self.gst_rate!r} + ({value}) * ({always!r} + CASE WHEN {is_buy} THEN {buying!r} ELSE {selling!r} END))"

    def total_cost(self, value: float, lots: float, is_buy: bool) -> float:
        broker = self.flat_per_order + self.rate_of_value * value + self.per_lot * lots
        if self.max_brokerage > 0:
            broker = min(broker, self.max_brokerage)
        always, buying, selling = self._charges()
        return broker * (1 + self.gst_rate) + value * (always + (buying if is_buy else selling))

    def short_borrow_cost(self, value: float, periods_per_year: float) -> float:
        return max(self.short_borrow_rate_annual, 0.0) / periods_per_year * value if periods_per_year > 0 else 0.0

    def cost_fraction(self, value: float, lots: float, is_buy: bool, capital: float) -> float:
        return self.total_cost(value, lots, is_buy) / capital if capital > 0 else 0.0

    def of_weight(self, price: float, weight: float, is_buy: bool, capital: float) -> float:
        """The cost of trading a weight of the capital at a price, as a share of the capital."""
        if not (price > 0 and weight > 0 and capital > 0):
            return 0.0
        lots = math.ceil(weight * capital / (self.lot_size * price)) if self.lot_size > 0 else 1.0
        return self.cost_fraction(weight * capital, lots, is_buy, capital)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @staticmethod
    def from_json(text: str) -> Commission:
        return Commission(**json.loads(text))

    @staticmethod
    def zero() -> Commission:
        return Commission()

    @staticmethod
    def proportional(rate: float) -> Commission:
        return Commission(rate_of_value=rate)

    @staticmethod
    def preset(name: str) -> Commission:
        return Commission(**PRESETS[name], regulatory_charges_rate=0.000001, gst_rate=0.18)


# Published charges of Indian exchanges and brokers.
PRESETS: dict[str, dict] = {
    "equity_delivery_india": {"rate_of_value": 0.001, "max_brokerage": 20.0, "stt_rate": 0.001, "stt_on_buy": True, "stt_on_sell": True, "exchange_charges_rate": 0.0000297, "stamp_duty_rate": 0.00015},
    "equity_intraday_india": {"rate_of_value": 0.0003, "max_brokerage": 20.0, "stt_rate": 0.00025, "stt_on_sell": True, "exchange_charges_rate": 0.0000297, "stamp_duty_rate": 0.000003},
    "futures_india": {"flat_per_order": 20.0, "stt_rate": 0.0005, "stt_on_sell": True, "exchange_charges_rate": 0.0000019, "stamp_duty_rate": 0.00002, "lot_size": 25.0},
    "options_india": {"flat_per_order": 20.0, "stt_rate": 0.0015, "stt_on_sell": True, "exchange_charges_rate": 0.0000053, "stamp_duty_rate": 0.000003, "lot_size": 25.0},
}


def resolve(commission: Commission | None, per_trade: float) -> Commission:
    """The model if there is one, else a flat fee."""
    return commission or Commission(flat_per_order=max(per_trade, 0.0))
