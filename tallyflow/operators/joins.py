"""Joins with small dimensions. No hints: the adaptive planner broadcasts a side by its measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalars import to_usd, utc_day
from tallyflow.operators.aggregates import Keys


def with_bank_name(df: DataFrame, banks: DataFrame, unknown: str, by: Keys = ()) -> DataFrame:
    names = banks.select(*by, F.col("bank_id").alias("from_bank"), "bank_name")
    return df.join(names, [*by, "from_bank"], "left").withColumn("bank_name", F.coalesce("bank_name", F.lit(unknown)))


def below_average(candidates: DataFrame, averages: DataFrame, divisor: float, by: Keys = ()) -> DataFrame:
    """Rows under their format's average over ``divisor``; formats without an average give nothing."""
    return candidates.join(averages, [*by, "payment_format"]).where(F.col("amount") < F.col("avg_amount") / divisor)


def with_usd(txn: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``usd``; rows without a rate, or with rate 0, go."""
    day = txn.withColumn("rate_date", utc_day(F.col("ts")))
    dim = rates.where("rate <> 0").select("rate_date", F.col("currency").alias("payment_currency"), "rate")
    return day.join(dim, ["rate_date", "payment_currency"]).withColumn("usd", to_usd(F.col("amount"), F.col("rate")))
