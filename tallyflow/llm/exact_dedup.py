"""Exact duplicates by a content sort.

Normalised texts are range-partitioned at sampled splitters, sorted (Spark's external sort spills), and
each text is compared in full with its neighbour. The key of the range is a prefix of the normalised
bytes, then their digest, then the id: equal texts are adjacent, splitters stay short whatever the texts'
length, and a group of copies of any size is cut into pieces over several tasks. Pieces at the two
borders of a task are put together afterwards; there are at most two a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import SPACES
from tallyflow.sources.shared import hinted, written

_PREFIX = 64


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sort order to rows with their run's first id and length; runs stay within the task."""
    part = TaskContext.get().partitionId()
    ids = digest = last = None  # of the run that may go on in the next batch
    first_run = True

    def emit(ids: pa.Array, digests: pa.Array, starts: np.ndarray, ends: np.ndarray, first: bool, final: bool) -> pa.RecordBatch:
        counts = ends - starts
        run = np.repeat(np.arange(len(starts)), counts)
        edge = np.zeros(len(starts), bool)
        edge[0] |= first
        edge[-1] |= final
        head = np.zeros(len(run), bool)
        head[starts] = True
        at = pa.array(starts[run])
        return pa.RecordBatch.from_arrays(
            [ids, digests.take(at), ids.take(at), pa.array(counts[run]), pa.array(head), pa.array(edge[run]), pa.array(np.full(len(run), part, np.int64))],
            ["id", "text_sha256", "first_id", "piece_size", "head", "edge", "part"],
        )

    for b in batches:
        if not b.num_rows:
            continue
        new_ids, texts, digests = b.column(0), b.column(1), b.column(2)
        differs = pc.invert(pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1))).to_numpy(zero_copy_only=False)
        joined = last is not None and texts[0].as_py() == last
        last = texts[len(texts) - 1].as_py()
        breaks = np.flatnonzero(differs) + 1
        starts = np.concatenate([[] if joined else [0], breaks]).astype(np.int64)
        if ids is not None:
            offset = len(ids)
            new_ids, digests = pa.concat_arrays([ids, new_ids]), pa.concat_arrays([digest, digests])
            starts = np.concatenate([[0], starts + offset]).astype(np.int64)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield emit(new_ids.slice(0, cut), digests.slice(0, cut), starts[:-1], starts[1:], first_run, False)
            first_run = False
            new_ids, digests = new_ids.slice(cut), digests.slice(cut)
        ids, digest = new_ids, digests
    if ids is not None:
        yield emit(ids, digest, np.array([0]), np.array([len(ids)]), first_run, True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII white space by one space. Null text
    counts as empty, and empty texts are one group. Of equal texts the row with the smallest id stays; null
    ids come last, and of rows that repeat an id any one stays (``kept`` is true for exactly one row a
    group). Very long texts are compared whole. Other columns are not read. An empty table gives an empty one.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(id_col).alias("id"), norm.alias("norm")).select(
        "id", "norm", F.sha2("norm", 256).alias("text_sha256"), F.substring("norm", 1, _PREFIX).alias("prefix"), F.monotonically_increasing_id().alias("row"))
    order = ["prefix", "text_sha256", F.col("id").asc_nulls_last(), "row"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["id"]
    pieces = written(placed.select("id", "norm", "text_sha256").mapInArrow(
        _pieces, f"id {kind}, text_sha256 string, first_id {kind}, piece_size long, head boolean, edge boolean, part long"), "pieces")
    # Only runs at a task's borders can go on elsewhere: at most two rows a task.
    whole = (pieces.where("edge AND head").groupBy("text_sha256")
             .agg(F.min("part").alias("first_part"), F.min_by("first_id", "part").alias("whole_id"), F.sum("piece_size").alias("whole_size")))
    return pieces.join(hinted(written(whole, "borders")), "text_sha256", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("edge"), F.col("whole_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.when(F.col("edge"), F.col("whole_size")).otherwise(F.col("piece_size")).alias("group_size"),
        (F.col("head") & (~F.col("edge") | (F.col("part") == F.col("first_part")))).alias("kept"),
        "text_sha256")
