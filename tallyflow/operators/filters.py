"""Predicates. Each is a plain column expression, so it reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.params import Period


def inside(period: Period, column: str = "ts") -> Column:
    """Both ends are instants: neither the machine's time zone nor the session's moves them."""
    return F.col(column).between(F.lit(period.start), F.lit(period.end))


def by_currency(txn: DataFrame, currency: str) -> DataFrame:
    return txn.where(F.col("payment_currency") == currency)


def below(df: DataFrame, column: str, amount: float) -> DataFrame:
    return df.where(F.col(column) < amount)


def in_period(txn: DataFrame, period: Period) -> DataFrame:
    return txn.where(inside(period))


def by_format(txn: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    return txn.where(F.col("payment_format").isin(*formats))


def tag_period(txn: DataFrame, first: Period, second: Period) -> DataFrame:
    """Adds ``period`` 1 or 2; where both hold the first wins, rows in neither go (already at the scan)."""
    return txn.where(inside(first) | inside(second)).withColumn("period", F.when(inside(first), 1).otherwise(2))
