"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of consecutive item words. Patterns of one length share tables: the shift of a
block of two words is its smallest distance from a pattern's end, so positions that no pattern can end at
are skipped; a block of shift 0 selects, by suffix and then prefix hash, the few patterns that are compared
with the text directly. Items shorter than a window are patterns of their own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import WORD_BYTES, marked, with_results
from tallyflow.llm.shingles import _mixed
from tallyflow.sources.shared import hinted, is_small, new_path, removed_at_exit, written

Words = tuple[bytes, ...]
Batches = Iterator[pa.RecordBatch]
_FOUND = 100_000  # texts with hits that are broadcast
_MAP_BITS, _PROBES = 1 << 28, 4


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def windows(text: bytes | None, size: int) -> set[Words]:
    """Each run of ``size`` words; the whole text when it has fewer; none without words."""
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class WuManber:
    """Patterns of one number of words; ``ends`` gives (end, pattern number) of every occurrence."""

    def __init__(self, patterns: Iterable[tuple[Words, int]], size: int) -> None:
        self.size, self.block = size, min(2, size)
        self.shift: dict[bytes, dict[bytes, int]] = {}
        self.buckets: dict[Words, dict[Words, list[tuple[Words, int]]]] = {}
        for p, number in patterns:
            for end in range(self.block, size + 1):
                before, last = p[end - self.block], p[end - 1]
                by = self.shift.setdefault(last, {})
                by[before] = min(by.get(before, size), size - end)
            self.buckets.setdefault(p[-self.block :], {}).setdefault(p[: self.block], []).append((p, number))

    def ends(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        size, block, shift, n = self.size, self.block, self.shift, len(words)
        unseen_pair = size - block + 1
        i = size - 1
        while i < n:
            by = shift.get(words[i])
            if by is None:  # ends no block; it can only be a pattern's first word
                i += unseen_pair
                continue
            step = by.get(words[i - block + 1], unseen_pair)
            if step:
                i += step
                continue
            end = i + 1
            for p, number in self.buckets.get(tuple(words[end - block : end]), {}).get(tuple(words[end - size : end - size + block]), ()):
                if all(words[end - size + k] == p[k] for k in range(size)):
                    yield end, number
            i += 1


class Matcher:
    """All tables of one block of test strings, (number, words) each."""

    def __init__(self, tests: list[tuple[int, bytes]]) -> None:
        by_size: dict[int, list[tuple[Words, int]]] = {}
        for number, text in tests:
            p = tuple(text.split())
            by_size.setdefault(len(p), []).append((p, number))
        self.tables = [WuManber(ps, m) for m, ps in sorted(by_size.items())]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(merged half-open word ranges inside occurrences, numbers of the test strings that occur)."""
        spans, found = [], set()
        for t in self.tables:
            for end, number in t.ends(words):
                spans.append((end - t.size, end))
                found.add(number)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(size: int) -> Callable[[Batches], Batches]:
    """(item, text) to rows (item, test), a row for each window."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tests = [b" ".join(p) for p in windows(text, size)]
                if tests:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(tests), pa.string()), pa.array(tests, pa.binary())], names=["item", "test"])

    return run


def _search(block: Broadcast) -> Callable[[Batches], Batches]:
    """(key, other, text) to (key, other, starts, ends, numbers) of the texts with an occurrence."""
    schema = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        matcher = Matcher(block.value)
        for batch in batches:
            rows = []
            for key, other, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                spans, numbers = matcher.scan(words_of(text.as_py()))
                if spans:
                    rows.append((key, other, [a for a, _ in spans], [b for _, b in spans], sorted(numbers)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _block_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` word hashes, made of its first and its last block of two words."""
    n = max(0, len(words) - size + 1)
    block = min(2, size)
    key = np.full(n, size, np.uint64)
    for at in [*range(block), *range(size - block, size)]:
        key = _mixed(key * np.uint64(3) + words[at : at + n])
    return key


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """_PROBES bits of a map for each key; ``bits`` is a power of 2."""
    step = (keys >> np.uint64(32)) | np.uint64(1)
    return np.stack([(keys + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(_PROBES)])


def _hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Hashes(dict):
    """64 bits for each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mapped_bits(tests: DataFrame, count: int) -> tuple[np.ndarray, list[int]]:
    """(a bit map of all test strings' block keys, their numbers of words). The map has at most _MAP_BITS bits, and one in
    64 of it belongs to a test string as long as there are few enough.
    """
    bits = min(_MAP_BITS, max(1 << 12, 1 << (64 * count - 1).bit_length()))

    def run(batches: Batches) -> Batches:
        known = _Hashes()
        for batch in batches:
            rows = [(len(w), *_probes(_block_keys(_hashes(w, known), len(w)), bits).ravel().tolist()) for w in (t.as_py().split() for t in batch.column(0))]
            for size, *on in rows:
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(on)), pa.array([b >> 6 for b in on]), pa.array(np.left_shift(np.uint64(1), np.array([b & 63 for b in on], np.uint64)).view(np.int64))], names=["size", "word", "on"])

    made = tests.select("test").mapInArrow(run, "size long, word long, on long")
    told = made.groupBy("word").agg(F.bit_or("on").alias("on"), F.collect_set("size").alias("sizes")).select("word", "on", "sizes").toArrow()
    found = np.zeros(bits >> 6, np.int64)
    found[told["word"].to_numpy()] = told["on"].to_numpy()
    return found.view(np.uint64), sorted(set(told["sizes"].combine_chunks().flatten().to_pylist()))


def _candidates(found: np.ndarray, sizes: list[int]) -> Callable[[Batches], Batches]:
    """(key, other, text) to those texts with a run of words whose block keys are in the map: all with an occurrence, and few others."""
    bits = len(found) << 6

    def may_hold(words: np.ndarray) -> bool:
        for size in sizes:
            on = _probes(_block_keys(words, size), bits)
            if ((found[on >> np.uint64(6)] >> (on & np.uint64(63))) & np.uint64(1)).all(axis=0).any():
                return True
        return False

    def run(batches: Batches) -> Batches:
        known = _Hashes()
        for batch in batches:
            yield batch.filter(pa.array([may_hold(_hashes(words_of(t.as_py()), known)) for t in batch.column(2)], pa.bool_()))

    return run


def _word_counts(columns: list[list]) -> list[list]:
    return [[len(words_of(t)) for t in columns[0]]]


def _occurrences(texts: DataFrame, tests: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """(key, other, starts, ends, numbers) of ``texts`` (key, other, text), of which there is one pass.

    A block has about ``most`` test strings of about ``most_bytes`` together. One block at a time is on the
    driver, in the broadcast and in the workers. Of several blocks a map of bits of all their suffix and prefix
    blocks keeps, in one pass, the texts that may hold an occurrence, and each block is searched in those.
    """
    spark = texts.sparkSession
    count, size = tests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("test")), F.lit(0))).first()
    blocks = max(1, -(-count // most), -(-size // most_bytes))
    if blocks > 1:
        texts = written(texts.mapInArrow(_candidates(*_mapped_bits(tests, count)), texts.schema), "candidates")
    path = new_path(spark, "hits")
    kind = "key long, other long, starts array<long>, ends array<long>, numbers array<long>"
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("test"), F.lit(blocks)) == b).select("number", "test").collect()
        block = spark.sparkContext.broadcast([(r.number, bytes(r.test)) for r in part])
        texts.mapInArrow(_search(block), kind).write.mode("append").parquet(path)
        block.destroy()
    return spark.read.schema(kind).parquet(removed_at_exit(spark, path))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, block_windows: int = 100_000, block_bytes: int = 32 << 20,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) of every row, and n_words, n_hit, n_items, item_ids, contaminated.

    A word is hit when inside any occurrence of a window of any item. Null and empty texts have no words and
    are clean; rows without words hit nothing; rows without an item id hit words but are no item; rows of one
    item id count as one item. Very long texts are searched whole, one at a time. Columns of ``docs`` called like a result are
    replaced. Empty tables of
    documents give empty ones; with an empty benchmark all are clean.

    The test strings are searched in blocks of ``block_windows``. What a block finds is written, and put together
    by text, so a benchmark of any size needs the memory of a block, and two passes over the texts: one that
    looks for occurrences, or for texts that may have some, and one that counts words.
    Texts are told apart by 128 bits of two hashes; repeated texts are put together as one.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    cut = written(items.mapInArrow(_cut(window), "item string, test binary").distinct(), "windows")
    tests = written(cut.select("test").distinct().withColumn("number", F.monotonically_increasing_id()), "tests")
    owners = written(cut.where("item IS NOT NULL").join(tests, "test").select("number", "item"), "owners")
    text = F.col(text_col)
    key, other = F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("other")
    hits = _occurrences(docs.where(text.isNotNull()).select(key, other, text.cast("binary").alias("text")), tests, block_windows, block_bytes).dropDuplicates(["key", "other", "starts", "numbers"])
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                          lambda s, x: F.struct(F.greatest(s["end"], x["ends"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(s["end"], x["starts"]))).alias("n")))
    hit = hits.groupBy("key", "other").agg(covered["n"].alias("hit"))  # a row for each block
    named = hits.select("key", "other", F.explode("numbers").alias("number")).join(hinted(owners), "number").groupBy("key", "other").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = written(hit.join(named, ["key", "other"], "left"), "found")
    results = ["n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), key, other, text.cast("binary").alias("text"))
    rows = with_results(whole, [F.col("text")], ["doc", "key", "other"], lambda: _word_counts, "n_words long")
    if is_small(found, _FOUND):
        told = rows.join(F.broadcast(found), ["key", "other"], "left")
    else:  # only rows whose bit is on are shuffled
        flagged = marked(rows, "key", found)
        absent = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("hit", "items")]
        told = (flagged.where("marked").drop("marked").join(found, ["key", "other"], "left").select("doc", "n_words", "hit", "items")
                .unionByName(flagged.where("NOT marked").select("doc", "n_words", *absent)))
    n_hit, item_ids = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return told.select(*[F.col("doc")[c].alias(c) for c in kept], "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))
