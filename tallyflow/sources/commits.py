"""Tables that grow batch by batch, each batch exactly once, in a folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.sources.shared import file_system


class CommittedTable:
    """Rows under batch ids. A batch counts from the moment its commit exists, and only once.

    A batch is written to a folder of its own attempt and then named in an empty file of ``commits``, whose
    creation is one step. What was written without a commit is never read; of two commits of a batch the
    smaller name counts for every reader. So a run that is killed anywhere and started again gives each row once.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str | T.StructType) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def commits(self) -> dict[int, tuple[str, str]]:
        """(attempt, owner) of each committed batch."""
        files, place = file_system(self.spark, f"{self.folder}/commits")
        names = sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []
        found: dict[int, tuple[str, str]] = {}
        for name in names:
            batch, attempt, owner = name.split(".", 2)
            found.setdefault(int(batch), (attempt, owner))
        return found

    def write(self, rows: DataFrame, batch: int, owner: str = "") -> bool:
        """Whether the batch was written now; one that is committed is left as it is, without reading ``rows``.

        ``owner`` names the stream that counts the batches. A table belongs to one: another stream's batch of
        the same number would be taken for done.
        """
        done = self.commits()
        others = {o for _, o in done.values()} - {owner}
        if others:
            raise ValueError(f"{self.folder} has batches of another stream: {sorted(others)}")
        if batch in done:
            return False
        attempt = uuid.uuid4().hex
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema]).write.parquet(self._data(batch, attempt))
        self._commit(batch, attempt, owner)
        return True

    def _commit(self, batch: int, attempt: str, owner: str) -> None:
        files, place = file_system(self.spark, f"{self.folder}/commits/{batch:020d}.{attempt}.{owner}")
        files.createNewFile(place)

    def _data(self, batch: int, attempt: str) -> str:
        return f"{self.folder}/data/batch={batch}/attempt={attempt}"

    def read(self, batches: Iterable[int] | None = None) -> DataFrame:
        """The rows of ``batches`` (all that are committed by default), with ``batch``."""
        done = self.commits()
        wanted = sorted(done) if batches is None else [b for b in batches if b in done]
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        paths = [self._data(b, done[b][0]) for b in wanted]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths).select(*schema.names)

    def last(self) -> DataFrame:
        """The rows of the last batch, of streams that give their whole result with each."""
        return self.read(sorted(self.commits())[-1:]).drop("batch")

    def newest(self, keys: list[str]) -> DataFrame:
        """For each key the row of its last batch, of streams that give the rows that changed."""
        row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in self.schema.names]), "batch").alias("row")
        return self.read().groupBy(*keys).agg(row).select("row.*")

    def sweep(self, before: int = 0) -> None:
        """Deletes what attempts without a commit have left, and batches below ``before`` for good; not while a batch is being written."""
        kept = {(f"batch={b}", f"attempt={a}") for b, (a, _) in self.commits().items() if b >= before}
        files, place = file_system(self.spark, f"{self.folder}/data")
        for batch in files.listStatus(place) if files.exists(place) else []:
            for attempt in files.listStatus(batch.getPath()):
                if (batch.getPath().getName(), attempt.getPath().getName()) not in kept:
                    files.delete(attempt.getPath(), True)
