"""The same questions over a stream of transactions (Structured Streaming)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.scalars import MINUTES, to_bank
from tallyflow.operators import aggregates, filters, joins
from tallyflow.params import Params
from tallyflow.sources.commits import CommittedTable
from tallyflow.sources.tables import ACCOUNTS_CSV, IS_ROW, TRANSACTIONS_CSV, decode_transactions

#: The time of the payment that closes a stream.
CLOSED = datetime(9999, 1, 1)


def read_csv_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16, time_form: str = MINUTES) -> DataFrame:
    """New CSV files of a folder as typed transactions; rows that cannot be decoded go."""
    raw = spark.readStream.schema(TRANSACTIONS_CSV).option("header", True).option("maxFilesPerTrigger", files_per_trigger).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(folder)
    return decode_transactions(raw, time_form).where(IS_ROW)


def read_banks_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New CSV files of a folder as (bank_id, bank_name); rows without a readable bank go, names of a bank may repeat."""
    raw = spark.readStream.schema(ACCOUNTS_CSV).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return raw.select(to_bank(F.col("raw_bank")).alias("bank_id"), "bank_name").where("bank_id IS NOT NULL")


def close(spark: SparkSession, folder: str, at: datetime = CLOSED) -> None:
    """Ends a stream of CSV files: adds one of a payment without bank, currency, format and amount, at a time past all others.

    It is no answer to any question; it only tells the streams that nothing earlier comes any more.
    """
    row = (at.strftime("%Y/%m/%d %H:%M"), "0", "", "0", "", "", "", "", "", "")
    spark.createDataFrame([row], ", ".join(f"c{i} string" for i in range(10))).coalesce(1).write.mode("append").option("header", True).csv(folder)


def q1_stream(txn: DataFrame, p: Params) -> DataFrame:
    """Append mode; no state."""
    return filters.below(filters.by_currency(txn, p.currency), "amount", p.micro_amount).select("account", "to_account", "amount")


def q2_stream(txn: DataFrame, p: Params) -> DataFrame:
    """Update or complete mode, without names; one state row a bank."""
    return aggregates.largest_per_bank(filters.by_currency(txn, p.currency))


def q2_named_stream(txn: DataFrame, banks: DataFrame, p: Params) -> DataFrame:
    """Update or complete mode: (from_bank, bank_name, account, amount, amount_text) of each bank with payments.

    Names and payments are two kinds of rows of one stream, and a bank's state takes them in any order: a bank
    shows up with its first payment, under the name for unknown ones until its own comes, which may be last. Of several names
    the smallest counts. Both sides combine before the shuffle, so a bank of very many payments is no burden.
    """
    paid = filters.by_currency(txn, p.currency).where("amount IS NOT NULL")
    best = F.struct((-F.col("amount")).alias("negated"), "account", "amount_text", "amount")
    payments = paid.select(F.col("from_bank").alias("bank"), F.lit(None).cast("string").alias("name"), best.alias("best"))
    names = banks.select(F.col("bank_id").alias("bank"), F.col("bank_name").alias("name"), F.lit(None).cast(payments.schema["best"].dataType).alias("best"))
    state = payments.unionByName(names).groupBy("bank").agg(F.min("name").alias("name"), F.min("best").alias("best"))
    return state.where("best IS NOT NULL").select(F.col("bank").alias("from_bank"), F.coalesce("name", F.lit(p.unknown_bank)).alias("bank_name"), "best.account", "best.amount", "best.amount_text")


def q5_stream(txn: DataFrame, rates: DataFrame, p: Params) -> DataFrame:
    """Complete mode; the rates are a static side."""
    wanted = filters.by_format(filters.in_period(txn, p.conversion_period), p.formats)
    return aggregates.row_count(filters.below(joins.with_usd(wanted, rates), "usd", p.converted_amount))


def stream_id(rows: DataFrame) -> str:
    """Inside foreachBatch: the identity of the stream that counts the batches, which its checkpoint keeps."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def drain(result: DataFrame, table: CommittedTable, mode: str, checkpoint: str) -> None:
    """Processes what is there, into ``table`` under the stream's batch numbers, and ends; the checkpoint makes it go on from there.

    A batch whose rows are committed and whose end Spark hasn't recorded comes again after a restart, with the same number, and is skipped.
    """
    query = (result.writeStream.outputMode(mode).foreachBatch(lambda rows, batch: table.write(rows, batch, stream_id(rows)) and None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def settled(txn: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream of transactions has brought so far, as a table for the batch questions.

    A later call goes on from there.
    """
    query = txn.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return txn.sparkSession.read.schema(txn.schema).parquet(folder)
