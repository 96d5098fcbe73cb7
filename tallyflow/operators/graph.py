"""Two-hop paths over the graph of accounts; a vertex is the pair (bank, account).

``by`` are columns that a vertex has in front, such as a client's: each of their values has a graph of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.aggregates import Keys
from tallyflow.sources.shared import hinted, written

EDGE = ["from_bank", "account", "to_bank", "to_account"]
SOURCE, TARGET = EDGE[:2], EDGE[2:]


def edges(txn: DataFrame, by: Keys = ()) -> DataFrame:
    return txn.select(*by, *EDGE).distinct()


def degrees(edge: DataFrame, key: list[str], least: int) -> DataFrame:
    """Vertices with at least ``least`` distinct neighbours."""
    return edge.groupBy(*key).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") >= least)


def pruned(edge: DataFrame, key: list[str], least: int) -> DataFrame:
    """Edges whose ``key`` vertex has degree ``least``: no pair of fewer paths is lost by it."""
    return edge.join(degrees(edge, key, least).drop("degree"), key, "left_semi")


def intermediaries(edge: DataFrame) -> DataFrame:
    """(mid_bank, mid, bank, account, role): each edge as seen from its two ends.

    An edge's target may stand between its source, of role ``origin``, and others; its source between others
    and its target, of role ``destination``.
    """
    ends = lambda mid, other, role: edge.select(F.col(mid[0]).alias("mid_bank"), F.col(mid[1]).alias("mid"), F.col(other[0]).alias("bank"), F.col(other[1]).alias("account"), F.lit(role).alias("role"))
    return ends(TARGET, SOURCE, "origin").unionByName(ends(SOURCE, TARGET, "destination"))


def hubs(edge: DataFrame, hub: int, by: Keys = ()) -> DataFrame | None:
    """(mid_bank, mid, parts) of the vertices with over ``hub`` edges into them; none if there are none."""
    into = edge.groupBy(*by, F.col("to_bank").alias("mid_bank"), F.col("to_account").alias("mid")).agg(F.ceil(F.count(F.lit(1)) / hub).alias("parts"))
    found = into.where("parts > 1")
    return None if found.isEmpty() else hinted(written(found, "hubs"))


def path_counts(first: DataFrame, second: DataFrame, hub_parts: DataFrame | None = None, by: Keys = ()) -> DataFrame:
    """(origin, destination, n): n distinct intermediaries, as edges are distinct. Loops count like any path.

    The edges into one of the ``hub_parts`` are dealt into its parts by their origins, and those out of it are
    repeated for each part, so that no task has to make all paths through it.
    """
    left = first.select(*by, F.col("from_bank").alias("bank"), "account", F.col("to_bank").alias("mid_bank"), F.col("to_account").alias("mid"))
    right = second.select(*by, F.col("from_bank").alias("mid_bank"), F.col("account").alias("mid"), "to_bank", "to_account")
    mid = [*by, "mid_bank", "mid"]
    if hub_parts is not None:
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        left = left.join(hub_parts, mid, "left").withColumn("part", F.pmod(F.xxhash64("bank", "account"), parts)).drop("parts")
        right = right.join(hub_parts, mid, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        mid.append("part")
    return left.join(right, mid).groupBy(*by, "bank", "account", "to_bank", "to_account").agg(F.count(F.lit(1)).alias("n"))


def scatter_gather(edge: DataFrame, least: int, prune: bool = True, hub: int = 10_000, by: Keys = ()) -> DataFrame:
    """Origins with ``least`` intermediaries to one destination. ``edge`` is read several times: written edges are made once."""
    first = pruned(edge, [*by, *SOURCE], least) if prune else edge
    second = pruned(edge, [*by, *TARGET], least) if prune else edge
    return path_counts(first, second, hubs(edge, hub, by), by).where(F.col("n") >= least).select(*by, "bank", "account").distinct()
