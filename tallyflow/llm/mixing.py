"""Mixing sources to target weights by capped water-filling, and seeded sampling of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.llm.common import word_count
from tallyflow.sources.shared import hinted, written

_DRAWS = 1 << 32
_BUCKET = 1 << 18  # draws of a bucket


def _running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` and, for each of ``sums``, its sum over the rows that come before in ``order``, a total order.

    The table is dealt into ranges; a range adds what the ranges before it sum to, so no task holds the table.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = per_range.select("_range", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    told = ranges.join(F.broadcast(offsets), "_range")
    return told.select(*df.columns, *[(F.col(f"_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()])


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number below _DRAWS for each id; rows without an id draw by their text, so that many of them don't share one."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to their targets; one row a source, and no row for no sources.

    Every source gets a level times its weight, clamped at ``max_epochs`` times its size; the level is where
    the excess of the clamped ones has gone to the others. In order of cap over weight the sources before
    some place are clamped and the rest share what remains, so the level is the first that its own source
    doesn't exceed; of equal ratios the largest level, that of none of them clamped. Only sums and the level, single numbers, reach the driver.
    """
    by_source = F.col("source").asc_nulls_last()
    ranked = _running(sizes, [by_source], {"place": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = ranked.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    weighted = written(weighted.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")), "weights")
    words, weight = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    placed = _running(weighted, ["ratio", by_source], {"caps_before": F.col("cap"), "weight_before": F.col("weight")})
    level = (F.lit(float(share) * words) - F.col("caps_before")) / (F.lit(float(weight)) - F.col("weight_before"))
    fit = placed.select("ratio", level.alias("level")).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", -F.col("level")))).first()[0]
    wanted = F.col("cap") if fit is None else F.least(F.lit(fit) * F.col("weight"), F.col("cap"))
    return weighted.select("source", "source_size", wanted.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col``, size, source_size, target, taken, repeats, part_words.

    Of a source with a target of so many epochs every document is taken whole for each full epoch, ``repeats``
    times. What the target has beyond those is a seeded sample: the source's documents in the order of a draw
    on their ids (on their texts where the id is null), whole ones until the next doesn't fit, of which the first words that fit are taken;
    ``part_words`` is what a document gives to that sample. A source is so within one word of its target.

    Draws are dealt into buckets: sums of the buckets tell where a source's sample ends, and only the rows of
    that bucket are sorted, so a source of any size is no single task's.

    Null text has size 0 and is taken 0 times; null is a source of its own, last in order; equal draws go by
    id (null last), then size; of rows that repeat an id and a size one may be taken and another not; other
    columns are not read. ``max_epochs`` must be at least ``share`` for targets to be reached; beyond that
    every source stays at its cap. Words of very long texts are counted whole. An empty table gives an empty one.
    """
    drawn = draw(F.col(id_col), F.col(text_col), seed).alias("draw")
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), drawn), "sizes")
    buckets = written(sized.groupBy("source", F.expr(f"draw div {_BUCKET}").alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = written(goal.withColumn("rest", F.floor(F.col("target") - F.col("repeats") * F.col("source_size"))).withColumnRenamed("source", "of_source"), "targets")
    # Sums of the buckets before, over all sources in order: a source's own begin with its first bucket.
    buckets = written(_running(buckets, [F.col("source").asc_nulls_last(), "bucket"], {"words_before": F.col("words")}), "buckets")
    starts = buckets.groupBy(F.col("source").alias("start_source")).agg(F.min("words_before").alias("start"))
    goal = written(goal.join(starts, goal["of_source"].eqNullSafe(starts["start_source"])).drop("start_source"), "targets")
    of_source = lambda df: df.join(hinted(goal), df["source"].eqNullSafe(goal["of_source"]))
    filled = of_source(buckets).withColumn("before", F.col("words_before") - F.col("start"))
    ends = filled.where("before <= rest AND rest < before + words").select(F.col("of_source").alias("end_source"), F.col("bucket").alias("end_bucket"), "before")
    goal = written(goal.join(ends, goal["of_source"].eqNullSafe(ends["end_source"]), "left").drop("end_source"), "targets")
    placed = of_source(sized).withColumn("bucket", F.expr(f"draw div {_BUCKET}"))
    # Without an end the sample is the whole source, which only rounding can make of it.
    clear = placed.where("end_bucket IS NULL OR bucket <> end_bucket").withColumn("part_words", F.expr("if(end_bucket IS NULL AND rest > 0 OR bucket < end_bucket, size, 0L)"))
    order = W.partitionBy("source").orderBy("draw", F.col("id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    divided = placed.where("bucket = end_bucket").withColumn("part_words", F.least(F.col("size"), F.greatest(left, F.lit(0))))
    return clear.unionByName(divided).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("part_words")).cast("long").alias("taken"), F.col("repeats").cast("long").alias("repeats"),
        F.col("part_words").cast("long").alias("part_words"))
