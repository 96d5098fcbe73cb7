"""Exchange rates as a dimension table (rate_date, currency, rate): units per dollar."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyflow.sources.shared import written

SCHEMA = "rate_date date, currency string, rate double"

# ISO codes and the names that transactions carry.
CURRENCY_NAMES = {
    "AUD": "Australian Dollar",
    "BRL": "Brazil Real",
    "CAD": "Canadian Dollar",
    "CHF": "Swiss Franc",
    "CNY": "Yuan",
    "EUR": "Euro",
    "GBP": "UK Pound",
    "ILS": "Shekel",
    "INR": "Rupee",
    "JPY": "Yen",
    "MXN": "Mexican Peso",
    "RUB": "Ruble",
    "SAR": "Saudi Riyal",
}

# Bitcoin by day, used as a divisor like every other rate.
BITCOIN = {
    "2022-09-01": 19793.1,
    "2022-09-02": 199999.0,
    "2022-09-03": 19831.4,
    "2022-09-04": 19952.7,
    "2022-09-05": 20126.1,
}


def from_rows(spark: SparkSession, rows: Iterable[tuple[date, str, float]]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def constant(spark: SparkSession, first: date, days: int, rates: dict[str, float]) -> DataFrame:
    """The same rates on each of ``days`` days."""
    return from_rows(spark, ((first + timedelta(d), c, float(r)) for d in range(days) for c, r in rates.items()))


def url_for(template: str, day: date) -> str:
    """The address of a day's rates: with ``{date}`` filled; as it is where it names a ``date=``; else with one appended."""
    text = day.isoformat()
    if "{date}" in template:
        return template.replace("{date}", text)
    if "date=" in template:
        return template
    return f"{template}{'&' if '?' in template else '?'}date={text}"


def parse(day: date, body: str) -> list[tuple[date, str, float]]:
    """Rows of one service answer, a list of quotes and their rates, with dollars and Bitcoin added.

    Quotes without a name here are left out, of a quote that comes twice the last counts, and a rate that is
    missing is 0, which converts nothing. Any other answer raises ValueError with the day.
    """
    try:
        quotes = json.loads(body)
        found = {CURRENCY_NAMES[x["quote"]]: float(x.get("rate") or 0) for x in quotes if x.get("quote") in CURRENCY_NAMES}
        if not isinstance(quotes, list):
            raise TypeError("not a list")
    except (AttributeError, TypeError, ValueError) as error:
        raise ValueError(f"bad answer for {day}: {error}") from error
    found["US Dollar"] = 1.0
    if day.isoformat() in BITCOIN:
        found["Bitcoin"] = BITCOIN[day.isoformat()]
    return [(day, name, rate) for name, rate in found.items()]


def parsed(answers: DataFrame) -> DataFrame:
    """The dimension table of (rate_date, body) answers, by the same rules; a body that is no list of quotes fails with its day."""
    kind = "array<struct<quote: string, rate: double>>"
    quotes = F.from_json("body", kind)
    told = F.when(F.col("body").isNull() | quotes.isNull(), F.raise_error(F.concat(F.lit("bad answer for "), F.col("rate_date").cast("string")))).otherwise(quotes)
    names = F.create_map(*[F.lit(x) for pair in CURRENCY_NAMES.items() for x in pair])
    named = answers.select("rate_date", F.posexplode(told).alias("at", "quote")).select("rate_date", "at", names[F.col("quote.quote")].alias("currency"), F.coalesce("quote.rate", F.lit(0.0)).alias("rate"))
    last = named.where("currency IS NOT NULL").groupBy("rate_date", "currency").agg(F.max_by("rate", "at").alias("rate"))
    days = answers.select("rate_date").distinct()
    bitcoin = F.create_map(*[x for day, rate in BITCOIN.items() for x in (F.lit(day), F.lit(rate))])[F.col("rate_date").cast("string")]
    fixed = days.select("rate_date", F.explode(F.array(F.struct(F.lit("US Dollar").alias("currency"), F.lit(1.0).alias("rate")), F.struct(F.lit("Bitcoin").alias("currency"), bitcoin.alias("rate")))).alias("x"))
    return last.unionByName(fixed.select("rate_date", "x.currency", "x.rate").where("rate IS NOT NULL"))


@dataclass
class _Day(InputPartition):
    day: date


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.days = sorted({date.fromisoformat(d.strip()) for d in options["days"].split(",") if d.strip()})
        self.retries, self.timeout, self.wait = int(options.get("retries", "3")), float(options.get("timeout", "10")), float(options.get("wait", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Day(d) for d in self.days]

    def read(self, partition: _Day | None) -> Iterator[tuple[date, str, float]]:
        if partition is not None:  # Spark reads a table without partitions so
            yield from parse(partition.day, self._answer(partition.day))

    def _answer(self, day: date) -> str:
        address = url_for(self.url, day)
        for attempt in range(self.retries + 1):
            try:
                with urlopen(address, timeout=self.timeout) as answer:
                    return answer.read().decode()
            except OSError as error:  # no connection, a time-out or a status of failure
                refused = isinstance(error, HTTPError) and error.code < 500 and error.code != 429
                if refused or attempt == self.retries:
                    raise ValueError(f"no answer for {day} from {address}: {error}") from error
                time.sleep(self.wait * 2**attempt)
        raise AssertionError


class RatesSource(DataSource):
    """Exchange rates of a web service as a table, a partition for each day.

    Options: ``url``, a template as ``url_for`` takes it; ``days``, dates between commas; ``retries`` (3) after a failure of the
    connection or the service, the first after ``wait`` (1) seconds, each next after twice as long; ``timeout`` (10) seconds.
    Executors ask; the driver doesn't. An answer that can't be had or read fails with its day.
    """

    @classmethod
    def name(cls) -> str:
        return "tallyflow_rates"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetch(spark: SparkSession, template: str, days: Iterable[date], **options: str) -> DataFrame:
    """The rates of ``days`` from a service, each day asked for once; the table is written, so that later uses ask for nothing."""
    spark.dataSource.register(RatesSource)
    reader = spark.read.format(RatesSource.name()).option("url", template).option("days", ",".join(sorted({d.isoformat() for d in days})))
    return written(reader.options(**options).load(), "rates")
