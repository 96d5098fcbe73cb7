"""All constants of the five questions, as one immutable parameter object, and its reading from configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import UTC, datetime


@dataclass(frozen=True)
class Period:
    """A closed time interval; both ends belong to it. Ends without a time zone are in UTC, whatever the machine's zone."""

    start: datetime
    end: datetime

    def __post_init__(self) -> None:
        for name in ("start", "end"):
            value = getattr(self, name)
            object.__setattr__(self, name, value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC))


# Fixed values of the original deployment.
@dataclass(frozen=True)
class Params:
    currency: str = "US Dollar"
    micro_amount: float = 50.0
    average_divisor: float = 100.0
    average_period: Period = Period(datetime(2022, 9, 1), datetime(2022, 9, 5, 23, 59, 59))
    candidate_period: Period = Period(datetime(2022, 9, 6), datetime(2022, 9, 14, 23, 59, 59))
    graph_period: Period = Period(datetime(2022, 9, 1), datetime(2022, 9, 5, 23, 59, 59))
    conversion_period: Period = Period(datetime(2022, 9, 1), datetime(2022, 9, 5, 23, 59, 59))
    min_intermediaries: int = 5
    formats: tuple[str, ...] = ("Wire", "ACH")
    converted_amount: float = 1.0
    unknown_bank: str = "Unknown Bank"


_RFC3339 = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})")


def timestamp(text: str) -> datetime:
    """An RFC 3339 time, in UTC; its offset is required."""
    if not _RFC3339.fullmatch(text):
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    return datetime.fromisoformat(text).astimezone(UTC)


def comma_list(text: str) -> tuple[str, ...]:
    """The parts between commas, as they stand; an empty text is one empty part."""
    return tuple(text.split(","))


def from_config(config: Mapping[str, str]) -> Params:
    """Parameters from texts by their names in upper case, such as MICRO_AMOUNT or FORMATS (a comma list).

    A period has two, as GRAPH_PERIOD_START and GRAPH_PERIOD_END. What is left out keeps its default; half a
    period, a name that isn't known or a text that can't be read raises ValueError.
    """
    left, values = dict(config), {}
    for f in fields(Params):
        name = f.name.upper()
        if isinstance(f.default, Period):
            ends = [left.pop(f"{name}_{end}", None) for end in ("START", "END")]
            if ends.count(None) == 1:
                raise ValueError(f"{name} has only one end")
            if None not in ends:
                values[f.name] = Period(*map(timestamp, ends))
        elif name in left:
            text = left.pop(name)
            values[f.name] = comma_list(text) if isinstance(f.default, tuple) else type(f.default)(text)
    if left:
        raise ValueError(f"unknown parameters: {sorted(left)}")
    return Params(**values)
