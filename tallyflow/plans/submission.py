"""A client's pair of CSV files to five result files: one pass over the input, and no result of an input that isn't whole."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.scalars import MINUTES
from tallyflow.operators.aggregates import Keys
from tallyflow.params import Params
from tallyflow.plans.questions import needed, questions
from tallyflow.sources.shared import file_system, scope, written
from tallyflow.sources.sinks import as_text
from tallyflow.sources.tables import CANONICAL, IS_ROW, RAW, decoded_csv, read_banks_csv


class IncompleteInput(ValueError):
    """Rows are missing, or there are more than were declared."""


@dataclass(frozen=True)
class Rows:
    """How many rows were read, how many of them are transactions (some without a readable amount), and how many are none."""

    read: int
    accepted: int
    without_amount: int
    bad: int
    clients: tuple[str, ...] = ()

    def check(self, declared: int | None) -> None:
        if self.read != self.accepted + self.bad:
            raise IncompleteInput(f"{self.read} rows were read, but {self.accepted} accepted and {self.bad} refused")
        if declared is not None and self.read != declared:
            raise IncompleteInput(f"{declared} rows were declared, but {self.read} were read")


def _watched(decoded: DataFrame, by: Keys) -> tuple[DataFrame, Observation]:
    seen = Observation()
    count = {"read": "true", "accepted": IS_ROW, "without_amount": "reason = 'amount'", "bad": "reason = 'row'"}
    clients = [F.collect_set(by[0]).alias("clients")] if by else []
    return decoded.observe(seen, *[F.count_if(F.expr(f"coalesce({e}, false)")).alias(k) for k, e in count.items()], *clients), seen


def read_once(spark: SparkSession, path: str, p: Params, declared: int | None = None, by: Keys = (), time_form: str = MINUTES) -> tuple[DataFrame, DataFrame, Rows]:
    """(transactions that any question needs, rows that can't be read, counts of all), of one pass over the files.

    What is needed of the files is written as a table, where the questions prune rows and columns; the rows are
    counted while they pass. With ``declared`` another number of rows raises IncompleteInput. Blank lines and headers are no rows.
    """
    decoded, seen = _watched(decoded_csv(spark, path, by, time_form), by)
    odd = F.col("reason").isNotNull()
    raw = [F.when(odd, F.col(c)).alias(f"raw {c}") for c in RAW]
    table = written(decoded.where(needed(p) | odd).select(*by, *CANONICAL, "reason", *raw), "submission")
    counts = seen.get
    rows = Rows(**counts | {"clients": tuple(sorted(counts.get("clients", ())))})
    rows.check(declared)
    return table.where(IS_ROW).where(needed(p)).select(*by, *CANONICAL), table.where("reason IS NOT NULL").select(*by, *[F.col(f"raw {c}").alias(c) for c in RAW], "reason"), rows


def submit(spark: SparkSession, transactions: str, accounts: str, rates: DataFrame, p: Params, folder: str, declared: int | None = None, by: Keys = (), name: str = "submission", time_form: str = MINUTES) -> dict[str, int]:
    """Answers all five questions in ``folder``, and returns how many rows were read, accepted and refused, and how many each result has.

    Results are written beside their places and moved there when all are whole; ``rows.json``, which is written
    last, has the counts. After a failure nothing of ``folder`` is changed, and intermediate tables are gone at once.

    With ``by`` the files are those of several clients, and the results have a folder for each. A client's folders
    are replaced, those of clients that aren't among the files stay; an answer without rows leaves its client none, but in question 5.
    """
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    try:
        with scope(spark, name):
            txn, refused, rows = read_once(spark, transactions, p, declared, by, time_form)
            owners = spark.createDataFrame([(c,) for c in rows.clients], f"`{by[0]}` string") if by else None
            asked = questions(txn, read_banks_csv(spark, accounts, by), rates, p, by, owners) | {"quarantine": lambda: refused}
            counts = {q: _written(q, ask(), staging, by) for q, ask in asked.items()}
        if counts["quarantine"] != rows.bad + rows.without_amount:
            raise IncompleteInput(f"{rows.bad + rows.without_amount} rows were refused, but {counts['quarantine']} written")
        for q in asked:
            _moved(spark, f"{staging}/{q}_result.csv", f"{folder}/{q}_result.csv", by, rows.clients)
        told = {k: v for k, v in vars(rows).items() if k != "clients"} | counts
        files, place = file_system(spark, f"{folder}/rows.json")
        out = files.create(place, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return told
    finally:
        files, place = file_system(spark, staging)
        files.delete(place, True)


def _written(name: str, result: DataFrame, folder: str, by: Keys) -> int:
    """Writes a result and tells how many rows it has, counted on their way."""
    seen = Observation()
    as_text(name, result, by).observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*by).option("header", True).csv(f"{folder}/{name}_result.csv")
    return seen.get["n"]


def _moved(spark: SparkSession, new: str, place: str, by: Keys, clients: tuple[str, ...]) -> None:
    """Puts a result, or the folders of its clients, in the place of what is there."""
    files, _ = file_system(spark, new)
    name = lambda c: spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by[0], c or None)
    parts = [f"/{name(c)}" for c in clients] if by else [""]
    for part in parts:
        old, made = (spark._jvm.org.apache.hadoop.fs.Path(p + part) for p in (place, new))
        files.delete(old, True)
        if files.exists(made):
            files.mkdirs(old.getParent())
            if not files.rename(made, old):
                raise OSError(f"can't move {made} to {old}")
