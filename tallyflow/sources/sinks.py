"""CSV results, one folder per question; Spark's commit protocol makes a rerun safe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalars import two_decimals
from tallyflow.operators.aggregates import Keys


def as_text(name: str, result: DataFrame, by: Keys = ()) -> DataFrame:
    """The columns as they are written: question 1 with two decimals, 2 and 3 with the source's own text, quarantined rows as they were read."""
    if name == "q1":
        return result.select(*by, "account", "to_account", two_decimals(F.col("amount")).alias("amount"))
    if name == "q2":
        return result.select(*by, "bank_name", "account", F.col("amount_text").alias("amount"))
    if name == "q3":
        return result.select(*by, "account", F.col("amount_text").alias("amount"))
    if name == "q4":
        return result.select(*by, F.col("bank").cast("string").alias("bank"), "account")
    return result if name == "quarantine" else result.select(*by, "count")


def write_csv(name: str, result: DataFrame, folder: str, by: Keys = ()) -> str:
    """Writes ``folder/<name>_result.csv``, in as many part files as the result has partitions.

    With ``by`` it has a folder for each value of those columns, and only the folders of values that the result has are replaced.
    """
    path = f"{folder}/{name}_result.csv"
    writer = as_text(name, result, by).write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else writer).csv(path)
    return path
