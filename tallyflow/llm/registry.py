"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import oracles
from tallyflow.llm.decontaminate import contamination
from tallyflow.llm.exact_dedup import exact_dedup
from tallyflow.llm.html_extract import extract
from tallyflow.llm.jaccard_join import jaccard_components
from tallyflow.llm.licenses import license_scan
from tallyflow.llm.line_dedup import line_dedup
from tallyflow.llm.mixing import mix
from tallyflow.llm.phrases import collocations
from tallyflow.llm.pieces import encode
from tallyflow.llm.pii import find_pii
from tallyflow.llm.quality import quality
from tallyflow.llm.resampling import resample
from tallyflow.llm.warc import round_trip

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("spans")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Query] = {
    "op1_extract_text": op1_extract_text,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc_zip": op3_warc_zip,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_find_pii": op9_find_pii,
    "op10_quality": op10_quality,
    "op11_phrases": op11_phrases,
    "op12_resample": op12_resample,
    "op13_sentencepiece": op13_sentencepiece,
    # What SQL can express of operators that find more.
    "license_base": lambda s, d: op7_license_scan(s, d).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
    "pii_counts": lambda s, d: op9_find_pii(s, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": oracles.MIX,
    "op3_warc_zip": oracles.WARC,
    "op4_exact_dedup": oracles.EXACT_DEDUP,
    "op5_line_dedup": oracles.LINE_DEDUP,
    "op6_decontaminate": oracles.DECONTAMINATE,
    "op8_jaccard_join": oracles.JACCARD,
    "op11_phrases": oracles.PHRASES,
    "op12_resample": oracles.RESAMPLE,
    "license_base": oracles.LICENSE_BASE,
    "pii_counts": oracles.PII_COUNTS,
}
