"""Lengths of time as users write them: an amount and a unit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The time units a duration may be written in.
UNITS = ("second", "seconds", "minute", "minutes", "hour", "hours", "day", "days")


@dataclass(frozen=True)
class Duration:
    amount: int
    unit: str

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit {self.unit!r} is not one of {', '.join(UNITS)}")
        if self.amount <= 0:
            raise ValueError("amount must be positive")

    def __str__(self) -> str:
        return f"{self.amount} {self.unit}"

    def window(self, ts: Column | str) -> Column:
        """Tumbling slots of this length, aligned to 1970-01-01."""
        return F.window(ts, str(self))

    def trigger(self) -> dict[str, str]:
        """Arguments for ``DataStreamWriter.trigger``."""
        return {"processingTime": str(self)}


def duration(amount: int, unit: str) -> Duration:
    return Duration(amount, unit)
