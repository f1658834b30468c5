"""Column helpers (native expressions only)."""

from dimweave.functions.dates import business_days, close_interval, month_name, strict_date, to_day
from dimweave.functions.text import (
    executor_label,
    first_match_label,
    place_label,
    strict_int,
    substr,
)

__all__ = [
    "business_days",
    "close_interval",
    "executor_label",
    "first_match_label",
    "month_name",
    "place_label",
    "strict_date",
    "strict_int",
    "substr",
    "to_day",
]
