"""Typed errors. Rule errors carry the rule and the series; model failures become rows, not exceptions."""

from __future__ import annotations


class ForesailError(Exception):
    """Root of all errors raised here."""


class ConfigError(ForesailError):
    pass


class AdapterError(ForesailError):
    """A source cannot be read."""


class SchemaError(ForesailError):
    """A frame has not the columns or types that a step needs."""


class GateError(ForesailError):
    pass


class NotFittedError(ForesailError):
    """A programming error: it is never turned into a failed row."""


class ModelError(ForesailError):
    """A model failed on a fold; the fold's rows say so."""


class FitError(ModelError):
    pass


class TransformError(ModelError):
    pass


class ForecastContractError(ModelError):
    pass


class DataError(ForesailError):
    """A data-quality rule is broken."""

    rule = "data"

    def __init__(self, unique_id: str, detail: str):
        super().__init__(f"{unique_id}: {self.rule}: {detail}")
        self.unique_id, self.detail = unique_id, detail


def _rule(name: str, rule: str) -> type[DataError]:
    return type(name, (DataError,), {"rule": rule, "__doc__": f"Rule {rule}."})


MissingColumnError = _rule("MissingColumnError", "schema")
TimestampError = _rule("TimestampError", "timestamp")
NonNumericTargetError = _rule("NonNumericTargetError", "non_numeric_y")
DuplicateTimestampError = _rule("DuplicateTimestampError", "duplicates")
TradingCalendarError = _rule("TradingCalendarError", "trading_calendar")
IrregularFrequencyError = _rule("IrregularFrequencyError", "irregular_frequency")
LongGapError = _rule("LongGapError", "long_gap")
TooManyMissingError = _rule("TooManyMissingError", "missing_share")
TooManyZerosError = _rule("TooManyZerosError", "zeros")
NegativeValueError = _rule("NegativeValueError", "negatives")
NonPositivePriceError = _rule("NonPositivePriceError", "non_positive_for_returns")
TooShortError = _rule("TooShortError", "too_short")

BY_RULE = {
    e.rule: e
    for e in (
        MissingColumnError, TimestampError, NonNumericTargetError, DuplicateTimestampError, TradingCalendarError, IrregularFrequencyError,
        LongGapError, TooManyMissingError, TooManyZerosError, NegativeValueError, NonPositivePriceError, TooShortError,
    )
}
