"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset a local session (tests) takes a temporary folder; a cluster has no such folder, and fails."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tallyflow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_SCOPE: ContextVar[str] = ContextVar("scope", default="")


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables that this thread writes inside are in a folder of their own, which is deleted at the end, whatever happened."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = _SCOPE.set(path)
    try:
        yield path
    finally:
        _SCOPE.reset(before)
        files, place = file_system(spark, path)
        files.delete(place, True)


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{_SCOPE.get() or shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The store of ``path`` as Spark sees it, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which exists; it is deleted when the application ends, as lazy results may read it until then."""
    files, place = file_system(spark, path)
    files.deleteOnExit(place)
    return path


def written(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(removed_at_exit(spark, path))


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, for callers that have read them for the last time.

    What is derived from such a table and not yet written fails afterwards. Other tables are refused.
    """
    for table in tables:
        spark = table.sparkSession
        folder = shared_folder(spark)
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if not path.rpartition(":")[2].lstrip("/").startswith(f"{folder.rpartition(':')[2].lstrip('/')}/"):
                raise ValueError(f"not a table of the shared folder: {path}")
            files, place = file_system(spark, path)
            files.delete(place, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """What a value takes, about: eight bytes, or those of its texts, elements and fields."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = reduce(Column.__add__, [_bytes(value[f.name], f.dataType) for f in kind], F.lit(0).cast("long"))
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long")) + 8


def is_small(df: DataFrame, rows: int, most_bytes: int = 64 << 20) -> bool:
    """Whether a written table has at most ``rows`` rows of ``most_bytes`` together, which bounds what a broadcast of it takes.

    Only the rows' sizes are brought together, of ``rows`` + 1 rows at most.
    """
    size = _bytes(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    n, total = df.select(size.alias("size")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= rows and total <= most_bytes


def hinted(df: DataFrame, rows: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """A side of a join: broadcast when its measured rows and bytes allow, else left to the planner."""
    return F.broadcast(df) if is_small(df, rows, most_bytes) else df
