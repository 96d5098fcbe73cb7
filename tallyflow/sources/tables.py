"""Readers: CSV pairs as submitted by clients, Parquet, and the test tables.

Canonical columns of a transaction: ts, from_bank, account, to_bank, to_account,
amount_text, amount, payment_currency, payment_format. Of a bank: bank_id, bank_name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.scalars import MINUTES, to_amount, to_bank, to_timestamp
from tallyflow.operators.aggregates import Keys

CANONICAL = ["ts", "from_bank", "account", "to_bank", "to_account", "amount_text", "amount", "payment_currency", "payment_format"]
RAW = ["raw_ts", "raw_from_bank", "account", "raw_to_bank", "to_account", "unused_5", "unused_6", "amount_text", "payment_currency", "payment_format"]
TRANSACTIONS_CSV = T.StructType([T.StructField(c, T.StringType()) for c in [*RAW, "_corrupt"]])
#: Decoded rows that are transactions.
IS_ROW = "reason IS NULL OR reason = 'amount'"
ACCOUNTS_CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("bank_name", "raw_bank", "unused_2", "unused_3", "unused_4")])


def decode_transactions(raw: DataFrame, time_form: str = MINUTES) -> DataFrame:
    """Typed columns beside the raw ones; ``reason`` tells what cannot be decoded: the row or only its amount.

    A row is bad when its time or a bank can't be read or it has too few fields; further fields don't matter,
    and empty texts are texts. A bad amount is null: questions that need amounts leave the row out. Times are
    as clients write them, to the minute, unless another ``time_form`` (``scalars.EXACT``) is told.
    """
    short = F.col("payment_format").isNull() & (F.col("_corrupt").isNotNull() & (F.size(F.split("_corrupt", ",")) < len(RAW)))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("account", "to_account", "amount_text", "payment_currency", "payment_format")}
    typed = raw.withColumns({
        "ts": to_timestamp(F.col("raw_ts"), time_form), "from_bank": to_bank(F.col("raw_from_bank")),
        "to_bank": to_bank(F.col("raw_to_bank")), "amount": to_amount(F.col("amount_text")),
    })
    bad = F.col("ts").isNull() | F.col("from_bank").isNull() | F.col("to_bank").isNull() | F.coalesce(short, F.lit(False))
    return typed.withColumn("reason", F.when(bad, "row").when(F.col("amount").isNull(), "amount")).withColumns(texts)


def decoded_csv(spark: SparkSession, path: str, by: Keys = (), time_form: str = MINUTES) -> DataFrame:
    """Every row of the files as ``decode_transactions`` gives it. Columns go by position; bad rows never fail the job.

    With ``by``, a column name, each row has there the client of its file, ``client_<name>_transactions.csv``.
    """
    raw = (spark.read.schema(TRANSACTIONS_CSV).option("header", True).option("enforceSchema", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path))
    return decode_transactions(raw.select("*", *_client(by, "transactions")), time_form)


def _client(by: Keys, kind: str) -> list[Column]:
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # Spark gives an address
    return [F.regexp_extract(path, rf"/client_([^/]*)_{kind}\.csv", 1).alias(c) for c in by]


def read_transactions_csv(spark: SparkSession, path: str, by: Keys = (), time_form: str = MINUTES) -> tuple[DataFrame, DataFrame]:
    """(transactions, quarantined rows with their reason), of ``decoded_csv``. Rows of which only the amount is bad are in both."""
    decoded = decoded_csv(spark, path, by, time_form)
    return decoded.where(IS_ROW).select(*by, *CANONICAL), decoded.where("reason IS NOT NULL").select(*by, *RAW, "reason")


def read_banks_csv(spark: SparkSession, path: str, by: Keys = ()) -> DataFrame:
    """One row per bank id; of several names the smallest stays. ``by`` takes the client of files ``client_<name>_accounts.csv``."""
    raw = spark.read.schema(ACCOUNTS_CSV).option("header", True).csv(path)
    return unique_banks(raw.select(*_client(by, "accounts"), to_bank(F.col("raw_bank")).alias("bank_id"), "bank_name"), by)


def unique_banks(banks: DataFrame, by: Keys = ()) -> DataFrame:
    return banks.where("bank_id IS NOT NULL").groupBy(*by, "bank_id").agg(F.min("bank_name").alias("bank_name"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def testdata_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions: the user pays the customer named in its properties."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    payer = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("int").alias("from_bank"))
    payee = customers.select(F.col("c_custkey").alias("payee"), F.col("c_nationkey").cast("int").alias("to_bank"))
    # How the test tables' kinds stand for currencies and formats.
    currency = F.when(F.col("event_id") % 8 == 5, "Euro").when(F.col("event_id") % 8 == 6, "Yuan").when(F.col("event_id") % 8 == 7, "Bitcoin").otherwise("US Dollar")
    formats = {"view": "Cash", "click": "Wire", "purchase": "ACH", "signup": "Cheque", "error": "Credit Card"}
    kind = F.lit(None).cast("string")
    for event_type, name in formats.items():
        kind = F.when(F.col("event_type") == event_type, name).otherwise(kind)
    # The table's times are in UTC. Where the session's zone is another, they are moved to it before they become instants.
    zone = spark.conf.get("spark.sql.session.timeZone")
    ts = F.col("ts") if zone == "UTC" or events.schema["ts"].dataType != T.TimestampNTZType() else F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    return (events.withColumn("payee", F.get_json_object("props", "$.k").try_cast("bigint"))
            .join(payer, "user_id").join(payee, "payee")
            .select(ts.cast("timestamp").alias("ts"), "from_bank", F.col("user_id").cast("string").alias("account"),
                    "to_bank", F.col("payee").cast("string").alias("to_account"), F.col("value").cast("string").alias("amount_text"),
                    F.col("value").alias("amount"), currency.alias("payment_currency"), kind.alias("payment_format")))


def testdata_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` as banks; nation 0 is left out so that the default name is exercised."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey <> 0")
    return unique_banks(nation.select(F.col("n_nationkey").cast("int").alias("bank_id"), F.col("n_name").alias("bank_name")))
