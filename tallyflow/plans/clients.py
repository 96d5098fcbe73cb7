"""Submissions of several clients beside each other, and their cancelling."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tallyflow.params import Params
from tallyflow.plans.submission import submit
from tallyflow.sources.shared import scope


class Cancelled(Exception):
    """The client's work was stopped on demand."""


class Clients:
    """Runs each client's work in a thread of its own, under a tag and in a pool of its own.

    With ``spark.scheduler.mode`` FAIR, which must be set when the application starts, the pools share the
    executors, so that a small submission doesn't wait for a large one. A client has one piece of work at a time.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._lock = spark, threading.Lock()
        self._running: dict[str, tuple[str, Future, threading.Event]] = {}

    def run(self, client: str, work: Callable[[], Any]) -> Future:
        """Starts ``work``; intermediate tables that it writes go with it, however it ends."""
        tag, result, stopped = f"client-{uuid.uuid4().hex}", Future(), threading.Event()
        with self._lock:
            if client in self._running:
                raise ValueError(f"client {client!r} has work that is running")
            self._running[client] = (tag, result, stopped)

        def body() -> None:
            found, error = None, None
            try:
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", tag)
                self.spark.sparkContext.addJobTag(tag)
                with scope(self.spark, tag):
                    found = work()
            except BaseException as e:  # noqa: BLE001  the caller gets it
                error = e
            with self._lock:
                del self._running[client]
            if stopped.is_set():
                result.set_exception(Cancelled(client))
            elif error is not None:
                result.set_exception(error)
            else:
                result.set_result(found)

        InheritableThread(target=body, daemon=True).start()
        return result

    def submit(self, client: str, transactions: str, accounts: str, rates: DataFrame, p: Params, folder: str, declared: int | None = None) -> Future:
        """``submission.submit`` of the client's files, with results in ``folder/<client>``."""
        return self.run(client, lambda: submit(self.spark, transactions, accounts, rates, p, f"{folder}/{client}", declared))

    def cancel(self, client: str, wait: float = 0.2) -> bool:
        """Whether there was work to stop. Returns when it has ended and its intermediate tables are gone.

        Jobs are interrupted until the thread is at its end, as it may have been between two of them.
        """
        with self._lock:
            tag, result, stopped = self._running.get(client, (None, None, None))
            if result is None:
                return False
            stopped.set()
        while not result.done():
            self.spark.sparkContext.cancelJobsWithTag(tag)
            try:
                result.exception(timeout=wait)
            except TimeoutError:
                continue
        return True
