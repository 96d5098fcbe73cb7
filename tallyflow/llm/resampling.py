"""Importance resampling towards a target distribution, over hashed word n-grams.

A task numbers the words of a slice of texts and sorts the slice's suffixes by their first words. Neighbours
in that suffix array that share n words are a run: one n-gram and all its places. A run is hashed once and its
bucket is scattered to its places, from where each text takes its features' buckets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyflow.llm.common import WORD_BYTES
from tallyflow.llm.mixing import _running
from tallyflow.llm.slices import Batches, Coder, by_bytes
from tallyflow.sources.shared import written

_SLICE = 8 << 20  # bytes of text whose suffixes are sorted together
_STEP = 16  # scores that a histogram's bar takes together


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes' first ``depth`` words, words shared with the place before).

    ``words`` are numbers from 0; ``ends`` tells for each place where its text ends. Suffixes end there, and
    shorter ones come first. The order is made by doubling: ranks by m words, and those m places on, rank by 2m.
    """
    n, places = len(words), np.arange(len(words))
    rank, m = words.astype(np.int64), 1
    while m < depth:
        step = min(m, depth - m)
        after = np.where(places + step < ends, np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n], -1) + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].ravel()  # both are below n + 2, which a text's 2 GB bound
        m += step
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    if n:
        before, here = order[:-1], order[1:]
        equal = np.ones(n - 1, bool)
        for j in range(depth):
            inside = (before + j < ends[before]) & (here + j < ends[here])
            equal &= inside & (words[np.minimum(before + j, n - 1)] == words[np.minimum(here + j, n - 1)])
            shared[1:] += equal
    return order, shared


def features(texts: list[bytes | None], sizes: tuple[int, int], buckets: int) -> tuple[list[int], list[np.ndarray]]:
    """(words, buckets of all features) of each text: runs of ``sizes`` words, shorter ones first, each in the text's order."""
    coder = Coder()
    codes = [np.fromiter(map(coder.__getitem__, (t or b"").translate(WORD_BYTES).split()), np.int64) for t in texts]
    counts = np.fromiter(map(len, codes), np.int64, len(codes))
    words, text_ends = np.concatenate([np.zeros(0, np.int64), *codes]), np.cumsum(counts)
    ends = np.repeat(text_ends, counts)
    names = list(coder)
    order, shared = suffix_array(words, ends, sizes[1])
    by_size = []
    for n in range(sizes[0], sizes[1] + 1):
        whole = order + n <= ends[order]  # suffixes that are long enough
        of, same = order[whole], shared[whole]
        heads = np.flatnonzero(same < n)  # between suffixes with n common words none is shorter
        grams = zip(*(map(names.__getitem__, words[of[heads] + j].tolist()) for j in range(n)), strict=True)
        hashes = np.fromiter(map(zlib.crc32, map(b" ".join, grams)), np.int64, len(heads)) % buckets
        scattered = np.zeros(len(words), np.int64)
        scattered[of] = np.repeat(hashes, np.diff(np.append(heads, len(of))))
        by_size.append((n, scattered))
    out = []
    for end, count in zip(text_ends.tolist(), counts.tolist(), strict=True):
        out.append(np.concatenate([s[end - count : max(end - count, end - n + 1)] for n, s in by_size]))
    return counts.tolist(), out


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _featured(df: DataFrame, text_col: str, keep: list[str], sizes: tuple[int, int], buckets: int) -> DataFrame:
    """(_k0.., row, n_words, n_features, buckets) of every row; ``buckets`` holds the features' buckets as small integers."""
    renamed = df.select(F.col(f"`{text_col}`").cast("binary").alias("_v"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = T.StructType([f for f in renamed.schema.fields if f.name != "_v"] + T.StructType.fromDDL("row long, n_words long, n_features long, buckets binary").fields)
    arrow, kind = to_arrow_schema(schema), _kind(buckets)

    def run(batches: Batches) -> Batches:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in by_bytes(batch, 0, _SLICE):
                counts, found = features(part.column(0).to_pylist(), sizes, buckets)
                made = [range(row, row + len(found)), counts, [len(f) for f in found], [f.astype(kind).tobytes() for f in found]]
                row += len(found)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns[1:], arrow, strict=False)] + [pa.array(v, f.type) for v, f in zip(made, list(arrow)[len(keep) :], strict=True)], schema=arrow)

    return renamed.mapInArrow(run, schema)


def _bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket comes. A task sends a row for each of its buckets; as many rows as buckets reach the driver."""
    kind = _kind(buckets)

    def run(batches: Batches) -> Batches:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How much likelier, in thousandths of a natural logarithm, each bucket is in the target; counts are smoothed by one."""
    buckets, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weighted(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with ``weight``, the floored mean of its features' gains, instead of ``buckets``."""
    schema = T.StructType([f for f in featured.schema.fields if f.name != "buckets"] + [T.StructField("weight", T.LongType())])
    kind, at = _kind(len(gain)), featured.columns.index("buckets")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in (np.frombuffer(v.as_py(), kind) for v in batch.column(at))]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(weights, pa.int64())], names=schema.names)

    return featured.mapInArrow(run, schema)


def _noise(seed: int, id_col: str) -> Column:
    """Seeded Gumbel noise in thousandths, by a row's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
             id_col: str = "doc_id", keep: list[str] | None = None, text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``keep`` columns (``id_col`` by default) of every row, and n_words, n_features, weight, score, rank.

    A text's features are its runs of ``sizes`` words, from the first to the second number of them, hashed
    into ``buckets``. ``weight`` is the floored mean of the features' gains, ``score`` adds seeded noise, so
    that the highest scores are a sample without replacement in proportion to the target's likelihood. Of the
    rows with ``least_words`` words ``percent`` per cent are drawn; their ranks count from 1, those of others are null.

    Null and empty texts have no words, no features, weight 0, and are not drawn. A null id has the noise of an
    empty one. Equal scores go by id, null last, then by the number of features; of rows equal in all of that
    any comes first. With an empty target the gains only tell the corpus's own frequent buckets. Columns called like
    a result are replaced. An empty table gives an empty one.

    Texts are read once: their buckets, two bytes a feature, go to the shared folder. One row a bucket and bar
    of the histogram of scores reach the driver. Only rows of bars that the draw reaches are sorted, in ranges.
    """
    results = ["n_words", "n_features", "weight", "score", "rank"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in results]
    featured = written(_featured(docs, text_col, [id_col, *keep], sizes, buckets), "features")
    wanted = _bucket_counts(_featured(target, target_text_col, [], sizes, buckets), buckets)
    scored = _weighted(featured, gains(_bucket_counts(featured, buckets), wanted)).withColumn("score", F.col("weight") + _noise(seed, "_k0"))
    scored = written(scored, "scores")
    able = F.col("n_words") >= least_words
    bars = sorted(((r.bar, r.n) for r in scored.where(able).groupBy(F.floor(F.col("score") / _STEP).alias("bar")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, lowest, seen = sum(n for _, n in bars) * percent // 100, None, 0
    for bar, n in bars:
        if seen >= draw:
            break
        seen, lowest = seen + n, bar
    reached = able & (F.floor(F.col("score") / _STEP) >= lowest) if lowest is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("_k0").asc_nulls_last(), F.col("n_features"), F.col("row")]
    ranked = _running(scored.where(reached), order, {"before": F.lit(1)})
    rank = F.when(F.col("before") < draw, F.col("before") + 1).cast("long").alias("rank")
    columns = [*[F.col(f"_k{i + 1}").alias(c) for i, c in enumerate(keep)], "n_words", "n_features", "weight", "score"]
    parts = [ranked.select(*columns, rank), scored.where(~reached).select(*columns, F.lit(None).cast("long").alias("rank"))]
    return reduce(DataFrame.unionByName, parts)
