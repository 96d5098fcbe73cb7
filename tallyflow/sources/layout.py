"""Transactions and edges kept in buckets, so that grouping and joining by the same keys needs no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyflow.operators import aggregates, graph
from tallyflow.operators.aggregates import Keys


def bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int, folder: str | None = None, shuffled: bool = True) -> DataFrame:
    """``rows`` as a catalogue's table in ``buckets`` files by ``keys``, sorted by them.

    A bucket is read by one task. Keys should be many and none of them hot: accounts are, banks may not be. ``shuffled`` brings a
    bucket's rows together before they are written, in one file; without it every task writes a file to each
    bucket that it has rows of, which spares the exchange where rows come in order already.
    """
    dealt = rows.repartition(buckets, *keys) if shuffled else rows
    writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
    (writer if folder is None else writer.option("path", folder)).saveAsTable(table)
    return rows.sparkSession.table(table)


def edge_tables(edge: DataFrame, name: str, buckets: int, by: Keys = ()) -> tuple[DataFrame, DataFrame]:
    """The edges twice: ``<name>_in`` by their targets and ``<name>_out`` by their sources, for two-hop joins."""
    return bucketed(edge, f"{name}_in", [*by, *graph.TARGET], buckets), bucketed(edge, f"{name}_out", [*by, *graph.SOURCE], buckets)


def path_counts(name_in: DataFrame, name_out: DataFrame, by: Keys = ()) -> DataFrame:
    """``graph.path_counts`` over ``edge_tables``: both sides of the join are in place, only counts are exchanged.

    A hub's edges are in one bucket; where there are hubs, ``graph.path_counts`` deals them out.
    """
    return graph.path_counts(name_in, name_out, by=by)


def largest_per_bank(txn: DataFrame, by: Keys = ()) -> DataFrame:
    """``aggregates.largest_per_bank`` over a table in buckets by bank: no exchange."""
    return aggregates.largest_per_bank(txn, by)
