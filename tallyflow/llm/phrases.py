"""Phrase collocations by hierarchical pair naming.

Texts become slices of word numbers once. Level by level every place where two frequent grams of k - 1 words
stand one behind the other, sharing k - 2 words, is a gram of k words; it is named by the pair of their ids. Counts
of pairs are joined over all slices, frequent pairs get an id, and each slice takes the ids of its own
pairs back. A gram's two ids point to its parents: its first and its last k - 1 words. All cuts of a phrase
and all phrases inside another follow from these pointers, without a look at words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.llm.slices import Batches, Coder, by_bytes
from tallyflow.sources.shared import release, written

_SLICE = 16 << 20  # bytes of texts in a slice
_BREAK = b"\xff"  # no text has this byte
#: Byte table: A-Z become a-z, tabs spaces, and what ends a piece a byte of its own.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_SALTS = 64

_SLICES = "slice long, lang string, codes binary, words array<binary>, counts array<long>"
_NAMED = "slice long, codes binary, names array<long>"
_PAIRS = "slice long, left long, right long, n long"


def _codes(text: bytes, code: Coder) -> np.ndarray:
    """The text's words as numbers from 1; 0 where a piece ends."""
    tokens = text.translate(_BYTES).replace(_BREAK, b" \xff ").split(b" ")
    return np.fromiter(map(code.__getitem__, filter(None, tokens)), np.int32)


def _slices(batches: Batches) -> Batches:
    """(lang, text) to slices: one language's texts each, their word numbers, the words and how often each comes."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in by_bytes(batch, 1, _SLICE):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                code, found = Coder({_BREAK: 0}), []
                for t in texts:
                    found += [_codes(t, code), np.zeros(1, np.int32)]
                yield _slice(number, lang, np.concatenate(found) - np.int32(1), list(code)[1:])
                number += 1


def _slice(number: int, lang: str, codes: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    counts = np.bincount(codes[codes >= 0], minlength=len(words))
    values = [[number], [lang], [codes.tobytes()], [words], [counts.tolist()]]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["slice", "lang", "codes", "words", "counts"])


def _pairs(batches: Batches) -> Batches:
    """(slice, codes, names) to a row for each distinct pair of neighbouring grams, with its count."""
    for batch in batches:
        for number, raw, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            codes, ids = np.frombuffer(raw.as_py(), np.int32).astype(np.int64), names.values.to_numpy()
            keys, n = np.unique(_keys(codes, len(ids)), return_counts=True)
            keys, n = keys[keys >= 0], n[keys >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int64)), pa.array(ids[keys // len(ids)] if len(keys) else keys), pa.array(ids[keys % len(ids)] if len(keys) else keys), pa.array(n)],
                                             names=["slice", "left", "right", "n"])


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each place and the next; -1 if one of them has no gram."""
    left, right = codes[:-1], codes[1:]
    return np.where((left >= 0) & (right >= 0), left * size + right, -1)


def _renamed(codes: np.ndarray, keys: np.ndarray, ids: np.ndarray, number: int) -> pa.Table:
    """``codes`` with the place in ``ids``, in their order, for each of ``keys`` and -1 for the rest."""
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
    by_id = np.argsort(ids)
    place = np.empty(len(ids), np.int32)
    place[by_id] = np.arange(len(ids), dtype=np.int32)
    new = np.where((codes >= 0) & (keys[at] == codes), place[at], -1).astype(np.int32) if len(keys) else np.full(len(codes), -1, np.int32)
    return pa.table({"slice": pa.array([number], pa.int64()), "codes": pa.array([new.tobytes()], pa.binary()), "names": pa.array([ids[by_id].tolist()], pa.list_(pa.int64()))})


def _words_named(slices: pa.Table, found: pa.Table) -> pa.Table:
    """A slice and (slice, code, id) of its frequent words: the slice with places in a list of ids."""
    if not slices.num_rows or not found.num_rows:
        return _empty()
    codes = np.frombuffer(slices["codes"][0].as_py(), np.int32)
    return _renamed(codes, found["code"].to_numpy(), found["id"].to_numpy(), slices["slice"][0].as_py())


def _pairs_named(slices: pa.Table, found: pa.Table) -> pa.Table:
    """A slice of (k - 1)-grams and (slice, left, right, id) of its frequent pairs: the slice of k-grams."""
    if not slices.num_rows or not found.num_rows:
        return _empty()
    codes, names = np.frombuffer(slices["codes"][0].as_py(), np.int32).astype(np.int64), slices["names"].combine_chunks().values.to_numpy()
    keys = np.searchsorted(names, found["left"].to_numpy()) * len(names) + np.searchsorted(names, found["right"].to_numpy())
    return _renamed(_keys(codes, len(names)), keys, found["id"].to_numpy(), slices["slice"][0].as_py())


def _empty() -> pa.Table:
    return pa.table({"slice": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "names": pa.array([], pa.list_(pa.int64()))})


def _frequent(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of keys whose ``n`` are ``least`` together, with ``total``. A slice has at most one row of a key."""
    return counted.withColumn("total", F.sum("n").over(W.partitionBy(*keys))).where(F.col("total") >= least).drop("n")


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, id): an id for each key."""
    return written(rows.groupBy(*keys).agg(F.first("total").alias("n")).withColumn("id", F.monotonically_increasing_id()), "names")


def _cuts(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs as grams, by their parents: phrase, last word, and how often each first and last part comes, shorter ones first.

    ``cuts`` has (l, r) for the cut after one word, two words and so on.
    """
    def parent(side: str) -> DataFrame:
        return grams.select(F.col("id").alias(side), F.struct("lang", "phrase", "last", "starts", "ends").alias(f"{side}_gram"))

    both = pairs.join(parent("left"), "left").join(parent("right"), "right")
    return both.select(
        "id", "left", "right", "n", F.col("left_gram.lang").alias("lang"), F.concat_ws(" ", "left_gram.phrase", "right_gram.last").alias("phrase"), F.col("right_gram.last").alias("last"),
        F.array_append("left_gram.starts", F.col("n")).alias("starts"), F.array_append("right_gram.ends", F.col("n")).alias("ends"),
        F.arrays_zip(F.col("left_gram.starts").alias("l"), F.reverse("right_gram.ends").alias("r")).alias("cuts"))


#: Exact: the product has 38 digits, enough for counts below 1e15, and the quotient of decimals is whole.
_LOWEST = """array_min(transform(cuts, (c, k) -> struct(
  (cast(1000000 as decimal(7, 0)) * (cast(n as decimal(19, 0)) * cast(n as decimal(19, 0)))) div (cast(c.l as decimal(19, 0)) * cast(c.r as decimal(19, 0))) as score, k, c.l as l, c.r as r)))"""


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, top: int = 2000, inside: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``top`` phrases of 2 to ``most_words`` words.

    ``a`` is how often a phrase comes inside pieces, at least ``least``; ``n`` counts the language's words. The
    cut of the lowest score counts, of equal ones the first, and gives ``l`` and ``r``. A phrase goes if a longer one
    around it comes in ``inside`` per cent of its places. Equal scores go by ``a``, then by the phrase's bytes.

    Null and empty texts have no words, and a null language is called ``und``. Repeated rows count each. Of a very
    long text only a slice is as large. Other columns are not read. An empty table, or one without phrases, gives no rows.

    Slices exchange a row for each distinct word and pair of a slice, not for each place. Their tables are
    in the shared folder and are deleted as soon as the next level is written.
    """
    def kept(df: DataFrame) -> DataFrame:
        return written(df, "slices", compression="zstd")

    slices = kept(docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(_slices, _SLICES))
    counted = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "word")).select("slice", "lang", "code", F.col("word.words").alias("word"), F.col("word.counts").alias("n"))
    sizes = written(slices.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")), "sizes")
    frequent = written(_frequent(counted, ["lang", "word"], least), "frequent")
    words = _named(frequent, ["lang", "word"])
    ids = frequent.join(words.select("lang", "word", "id"), ["lang", "word"]).select("slice", "code", "id")
    named = kept(slices.select("slice", "codes").groupBy("slice").cogroup(ids.groupBy("slice")).applyInArrow(_words_named, _NAMED))
    release(slices, frequent)
    text = F.col("word").cast("string")
    grams = words.select("id", "lang", text.alias("phrase"), text.alias("last"), F.array("n").alias("starts"), F.array("n").alias("ends"))
    levels = []
    for k in range(2, most_words + 1):
        frequent = written(_frequent(named.mapInArrow(_pairs, _PAIRS), ["left", "right"], least), "frequent")
        pairs = _named(frequent, ["left", "right"])
        grams = written(_cuts(pairs, grams), "grams")
        levels.append(grams)
        if k < most_words:
            ids = frequent.join(pairs.select("left", "right", "id"), ["left", "right"]).select("slice", "left", "right", "id")
            named, old = kept(named.groupBy("slice").cogroup(ids.groupBy("slice")).applyInArrow(_pairs_named, _NAMED)), named
            release(old)
        release(frequent)
    release(named)
    free = []
    for level, longer in zip(levels, [*levels[1:], None], strict=True):
        if longer is not None:  # the most frequent phrase around a gram has one word more
            around = longer.select(F.explode(F.array("left", "right")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("around"))
            level = level.join(around, "id", "left").where(f"around IS NULL OR 100 * around < {inside} * n").drop("around")  # noqa: PLW2901
        free.append(level.select("lang", "phrase", F.col("n").alias("a"), F.expr(_LOWEST).alias("cut")))
    found = free[0]
    for level in free[1:]:
        found = found.unionByName(level)
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # A language is ranked in parts first, so that its last task has some thousand rows of each part.
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return found.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), F.col("score").cast("long").alias("score"))
