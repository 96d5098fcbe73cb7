"""The corpus pipeline: documents to the words that a training mix takes of them.

Each stage works on the whole table that the one before it kept. ``run`` writes that table to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.decontaminate import contamination
from tallyflow.llm.jaccard_join import one_of_each
from tallyflow.llm.line_dedup import line_dedup
from tallyflow.llm.mixing import mix
from tallyflow.llm.quality import classify, train
from tallyflow.sources.shared import written


def _beside(docs: DataFrame, results: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` of what ``stage`` returns; its ``results`` don't touch columns of their names."""
    own: dict[str, str] = {}
    for c in docs.columns:
        if c in results:
            name = f"own {c}"
            while name in docs.columns or name in own.values():
                name = f"own {name}"
            own[c] = name
    return stage(docs.withColumnsRenamed(own)).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality classifier rejects go.

    Every row is judged by its text alone: null and empty texts get a score like any other, rows that repeat
    an id or a text are judged each, null ids stay or go by their text. Columns called score or predicted stay
    as they are. An empty table gives an empty one; without labels every row has the score 0.5 and stays.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _beside(docs, {"score", "predicted"}, lambda d: classify(d, model).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: lines that stand in an earlier document, or nearly so, go; n_chars follows the text.

    No row goes. Null texts stay null, with a null n_chars; a text of which every line goes stays empty. Null ids
    come last, rows that repeat an id are told apart by their texts, and rows that repeat both are treated alike.
    Columns called n_lines or n_dropped stay as they are. An empty table gives an empty one.
    """
    rest = _beside(docs, {"n_lines", "n_dropped"}, line_dedup)
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each group of near copies stays, that of the smallest id.

    Null ids come last; of rows that repeat an id and a text any one stays. Rows without words, null texts among
    them, are linked with nothing, and all stay. All columns are kept. An empty table gives an empty one.
    """
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents with a passage of the benchmark go.

    Every row is judged by its text: null and empty texts have no words and stay, rows that repeat an id or a
    text are judged alike. Columns called like a result of ``contamination`` stay as they are. An empty table
    gives an empty one; with an empty benchmark every row stays.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, {"n_words", "n_hit", "n_items", "item_ids", "contaminated"}, lambda d: contamination(d, benchmark).where("NOT contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: how many words of each document the mix takes.

    A row for each row, with the columns of ``mix``: null texts have size 0 and are taken 0 times, a null source
    is a source of its own, equal draws go by id, null ids last. Other columns are left out. An empty table
    gives an empty one.
    """
    return mix(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mix sources", mix_sources),
]
#: SQL can't express the classifier; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that stays: doc_id, size, source_size, target, taken, repeats, part_words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
