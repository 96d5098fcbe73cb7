"""Counts of two-hop paths, kept up to date while payments come in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import filters, graph
from tallyflow.params import Params
from tallyflow.sources.commits import CommittedTable
from tallyflow.sources.shared import release
from tallyflow.streaming.incremental import stream_id

_EDGE = "from_bank int, account string, to_bank int, to_account string"
_PAIR = "bank int, account string, to_bank int, to_account string, n long"
PAIR = ["bank", "account", "to_bank", "to_account"]


class PathCounts:
    """Distinct edges so far and, for each pair of accounts, the number of two-hop paths between them.

    A batch's new edges make new paths with the edges before them, on either side, and among themselves; only
    those are counted, and their counts are added. Every ``merge_every`` batches the sums are written as one
    table, so that a reader adds up few. A batch that comes again changes nothing, wherever the run
    before was killed: edges and counts are committed by batch, and counts are made of committed edges.
    """

    def __init__(self, spark: SparkSession, folder: str, merge_every: int = 16, hub: int = 10_000) -> None:
        self.edges = CommittedTable(spark, f"{folder}/edges", _EDGE)
        self.added = CommittedTable(spark, f"{folder}/added", _PAIR)
        self.merged = CommittedTable(spark, f"{folder}/merged", _PAIR)
        self.merge_every, self.hub = merge_every, hub

    def add(self, txn: DataFrame, batch: int, owner: str = "") -> None:
        """Takes in a batch's transactions. Batches come in the order of their numbers."""
        old = self.edges.read(b for b in self.edges.commits() if b < batch).drop("batch")
        self.edges.write(graph.edges(txn).join(old, graph.EDGE, "left_anti"), batch, owner)
        if batch not in self.added.commits():
            new = self.edges.read([batch]).drop("batch")
            hubs = graph.hubs(old.unionByName(new), self.hub)
            parts = [graph.path_counts(a, b, hubs) for a, b in ((new, old), (old, new), (new, new))]
            self.added.write(reduce(DataFrame.unionByName, parts).groupBy(*PAIR).agg(F.sum("n").alias("n")), batch, owner)
            if hubs is not None:
                release(hubs)
        if (batch + 1) % self.merge_every == 0:
            self.merged.write(self.read(batch), batch, owner)

    def read(self, to: int | None = None) -> DataFrame:
        """(bank, account, to_bank, to_account, n) of all batches, or of those to number ``to``."""
        inside = lambda b: to is None or b <= to
        whole = max(filter(inside, self.merged.commits()), default=-1)
        added = self.added.read(b for b in self.added.commits() if b > whole and inside(b))
        return self.merged.read([whole]).unionByName(added).groupBy(*PAIR).agg(F.sum("n").alias("n"))

    def origins(self, least: int) -> DataFrame:
        """The answer to question 4 so far."""
        return self.read().where(F.col("n") >= least).select("bank", "account").distinct()


def q4_stream(txn: DataFrame, p: Params, counts: PathCounts, checkpoint: str) -> None:
    """Takes in what a stream of transactions has brought, and ends; a later call goes on from there."""
    wanted = filters.in_period(filters.by_currency(txn, p.currency), p.graph_period)
    query = wanted.writeStream.foreachBatch(lambda rows, batch: counts.add(rows, batch, stream_id(rows))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
