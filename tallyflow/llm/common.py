"""What several operators need: word patterns, and Python functions over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SPACES = r"[\x20\x09-\x0D]+"
NON_SPACES = r"[^\x20\x09-\x0D]+"
_BITS = 1 << 24
_SLICE = 512

#: Byte table of ``bytes.translate``: A-Z become a-z, every other ASCII byte that is no word character a space.
#: UTF-8 bytes of other characters are above 0x7F and stay, so words split at spaces are the words of the text.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACES)), F.lit(0)).cast("long")


def marked(rows: DataFrame, hash_col: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``marked``: whether the bit of their hash is on in a map made of ``wanted``'s.

    The map is a table of at most _BITS / 64 words, which bounds its broadcast; bits that are on for other
    hashes only let some more rows through.
    """
    bit = F.pmod(hash_col, F.lit(_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    placed = rows.withColumn("bit", bit).withColumn("word", F.expr("bit div 64"))
    return placed.join(F.broadcast(words), "word", "left").withColumn("marked", F.coalesce(F.expr("shiftrightunsigned(bits, cast(bit % 64 as int)) & 1L"), F.lit(0)) == 1).drop("bit", "word", "bits")


def with_results(df: DataFrame, inputs: list[Column], keep: list[str], make: Callable[[], Callable[[list[list]], list[list]]], schema: str) -> DataFrame:
    """``keep`` columns of each row and the columns of ``schema`` that a Python function makes of ``inputs``.

    ``make`` runs once a task and returns the function, which takes the inputs' values, column by column, for
    a few hundred rows and returns the results' values likewise. Kept columns of a result's name give way to
    it. Rows are neither shuffled nor reordered, so that kept texts pass through.
    """
    names = T.StructType.fromDDL(schema).names
    keep = [c for c in keep if c not in names]
    kinds = df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields if keep else []
    renamed = df.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], *[c.alias(f"_i{i}") for i, c in enumerate(inputs)])
    inner = T.StructType([T.StructField(f"_k{i}", f.dataType) for i, f in enumerate(kinds)] + [T.StructField(f"_r{i}", f.dataType) for i, f in enumerate(T.StructType.fromDDL(schema).fields)])
    arrow = to_arrow_schema(inner)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                made = work([c.to_pylist() for c in part.columns[n:]])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns[:n], arrow, strict=False)] + [pa.array(v, f.type) for v, f in zip(made, list(arrow)[n:], strict=True)], schema=arrow)

    return renamed.mapInArrow(run, inner).toDF(*keep, *names)
