"""Scalar conversions with a defined result for bad input (null, never an error)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Times as clients write them.
MINUTES = "yyyy/MM/dd H:mm"
#: The same, with seconds and their fraction where a text has them.
EXACT = "yyyy/MM/dd H:mm[:ss[.SSSSSS]]"
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_amount(text: Column) -> Column:
    """Decimal text as double; blanks, suffixes and other text give null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_bank(text: Column) -> Column:
    """Bank id as int; leading zeros vanish, anything but a whole number gives null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))


def to_timestamp(text: Column, form: str = MINUTES) -> Column:
    """A time of that form in UTC, whatever the session's time zone; null when malformed."""
    return F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{form} xx"))


def utc_day(ts: Column) -> Column:
    """The date in UTC, whatever the session's time zone."""
    micros, day = F.unix_micros(ts), F.lit(86_400_000_000)
    return F.date_from_unix_date(((micros - F.pmod(micros, day)) / day).cast("int"))


def two_decimals(amount: Column) -> Column:
    """Text with two decimals, by the number's exact value, ties to even; null for null."""
    return F.call_function("format_number", amount, F.lit("0.00"))


def to_usd(amount: Column, rate: Column) -> Column:
    """Units of a currency into dollars; a missing or zero rate gives null."""
    return F.when(rate != 0, amount / rate)
