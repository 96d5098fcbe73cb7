"""Keyed and global aggregates; all combine before the shuffle.

``by`` are columns that every key has in front, such as a client's: what has other values there never meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = tuple[str, ...]


def largest_per_bank(txn: DataFrame, by: Keys = ()) -> DataFrame:
    """The row with the largest amount of each bank; ties go to the smallest account, then text."""
    best = F.min(F.struct((-F.col("amount")).alias("negated"), "account", "amount_text", "amount")).alias("best")
    return txn.where("amount IS NOT NULL").groupBy(*by, "from_bank").agg(best).select(*by, "from_bank", "best.account", "best.amount", "best.amount_text")


def average_by_format(txn: DataFrame, by: Keys = ()) -> DataFrame:
    return txn.groupBy(*by, "payment_format").agg(F.avg("amount").alias("avg_amount"))


def row_count(df: DataFrame, by: Keys = (), owners: DataFrame | None = None) -> DataFrame:
    """One row, also for no input; with ``by`` one for each of the ``owners`` (distinct values of those columns), also for those without rows."""
    if not by:
        return df.agg(F.count(F.lit(1)).alias("count"))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    return counts if owners is None else owners.join(counts, list(by), "left").select(*by, F.coalesce("count", F.lit(0).cast("long")).alias("count"))
