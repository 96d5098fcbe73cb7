"""Question 3 over a stream: payments wait in state until the average of their format is final."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyflow.operators import filters
from tallyflow.params import Params
from tallyflow.streaming.incremental import CLOSED

_ROW = "account string, amount double, amount_text string"
_ANSWER = ["account", "amount", "amount_text"]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Waiting(StatefulProcessor):
    """One format's part: its sum and count when they are final, and the payments that wait for them."""

    def __init__(self, divisor: float, ends: int) -> None:
        self.divisor, self.ends = divisor, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.average = handle.getValueState("average", "total double, n long")
        self.closed = handle.getValueState("closed", "closed boolean")
        self.waiting = handle.getListState("waiting", _ROW)

    def _below(self, rows: pd.DataFrame) -> pd.DataFrame:
        total, n = self.average.get()
        return rows[rows["amount"] < total / n / self.divisor][_ANSWER]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            final = part[part["n"].notna()]
            payments = part[part["n"].isna()]
            if len(final):
                self.average.update((float(final["total"].iloc[0]), int(final["n"].iloc[0])))
                yield from self._released()
            if self.average.exists():
                yield self._below(payments)
            elif len(payments) and not self.closed.exists():
                if not self.waiting.exists():
                    self.handle.registerTimer(self.ends)
                self.waiting.appendList(list(payments[_ANSWER].itertuples(index=False, name=None)))

    def _released(self) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for row in self.waiting.get() if self.waiting.exists() else ():
            held.append(tuple(row))
            if len(held) == 10_000:
                yield self._below(pd.DataFrame(held, columns=_ANSWER))
                held = []
        if held:
            yield self._below(pd.DataFrame(held, columns=_ANSWER))
        self.waiting.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """The earlier period is over. A format that has no average by now never gets one: nothing of it is below."""
        if not self.average.exists():
            self.closed.update((True,))
            self.waiting.clear()
        return iter(())


def _all(*conditions: Column) -> Column:
    """That all hold, in one expression that isn't taken apart.

    The optimiser moves conditions without the time below the watermark, which would hide from it the payment that closes the stream.
    """
    return reduce(Column.__mul__, [c.cast("int") for c in conditions]) == 1


def q3_stream(txn: DataFrame, p: Params, lateness: timedelta | None = None, parts: int = 64) -> DataFrame:
    """Append mode: each payment far below the earlier average of its format, as soon as that average is final.

    The averages' period is one window. With a ``lateness`` it ends when the stream has brought a payment that
    much later, and payments of it that come still later are left out. Without one, payments may come in any
    order, and it ends when the stream is closed (``incremental.close``).

    Payments of the later period wait under their format and one of ``parts`` salts, so a format that a third
    of all payments have is many keys; the average, one row a format, goes to each of them. Formats without an
    average, and null amounts, give nothing. State of this kind needs a store with column families, to which the session's
    ``spark.sql.streaming.stateStore.providerClass`` is set; streams that run keep theirs.
    """
    txn.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    early, late = p.average_period, p.candidate_period
    after = max(early.end, late.end) + timedelta(microseconds=1)
    ts, span = F.col("ts"), after - min(early.start, late.start)
    seen = ts if lateness is not None else F.when((ts > F.lit(after)) & (ts < F.lit(CLOSED.replace(tzinfo=UTC))), F.lit(after)).otherwise(ts)
    timed = txn.withColumn("seen", seen).withWatermark("seen", f"{(lateness or span) // timedelta(milliseconds=1) + 1} milliseconds")
    paid, has_amount = F.col("payment_currency") == p.currency, F.col("amount").isNotNull()
    length = (early.end - early.start) // timedelta(microseconds=1) + 1
    offset = int(early.start.timestamp()) * 1_000_000 + early.start.microsecond
    window = F.window("seen", f"{length} microseconds", startTime=f"{offset % length} microseconds")
    averages = timed.where(_all(paid, has_amount, filters.inside(early, "seen"))).groupBy(window, "payment_format").agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))
    empty = {"account": F.lit(None).cast("string"), "amount": F.lit(None).cast("double"), "amount_text": F.lit(None).cast("string")}
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    final = averages.select("payment_format", salts, "total", "n", *[c.alias(k) for k, c in empty.items()])
    salt = F.pmod(F.xxhash64("ts", "account", "to_account", "amount_text"), F.lit(parts)).cast("int").alias("salt")
    payments = timed.where(_all(paid, has_amount, filters.inside(late, "seen"), ~filters.inside(early, "seen")))
    payments = payments.select("payment_format", salt, F.lit(None).cast("double").alias("total"), F.lit(None).cast("long").alias("n"), *_ANSWER)
    ends = int(early.end.timestamp() * 1000) + 1
    return final.unionByName(payments).groupBy("payment_format", "salt").transformWithStateInPandas(_Waiting(p.average_divisor, ends), _ROW, "Append", "EventTime")
