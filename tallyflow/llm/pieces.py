"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a marked word: white-space markers and the characters up to the next marker. Where no piece of a
vocabulary has a marker behind another character, no merge crosses the border of a chunk, so a chunk is
segmented alike wherever it stands. A task segments each distinct chunk once and joins ids, and decoded
characters, back by position.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from sentencepiece import sentencepiece_model_pb2

from tallyflow.llm.slices import Batches, Coder, by_bytes

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_AT_ONCE = 2 << 20  # bytes of text whose ids are joined at once
_TABLE = 64 << 20  # bytes of chunks and ids that a table may grow to


@functools.cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def has_borders(path: str) -> bool:
    """Whether chunks can be segmented one by one.

    The text must reach the segmenter as it is but for a marker in front and for each space, and no piece may
    have a marker behind another character.
    """
    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    rules = model.normalizer_spec
    plain = (rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
             and not model.trainer_spec.treat_whitespace_as_suffix)
    return plain and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)


class ChunkTable:
    """Distinct chunks and their ids and decoded characters; each is segmented when it first comes."""

    def __init__(self, path: str, most: int = _TABLE) -> None:
        self.library, self.most = processor(path), most
        self.borders = has_borders(path)
        self.clear()

    def clear(self) -> None:
        self.codes, self.size = Coder(), 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.decoded: list[str] = []

    def chunks(self, text: str) -> list[str]:
        if not self.borders:
            return [text]
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def _add(self, chunks: list[str]) -> None:
        """Segments chunks that are new, in the order of their codes."""
        if self.borders:  # the library puts a chunk's first marker there itself, but none before nothing
            found = [self.library.encode(c[1:]) if c != MARK else [self.library.piece_to_id(MARK)] for c in chunks]
            self.decoded += [" " + self.library.decode(i) for i in found]
        else:
            found = [self.library.encode(c) for c in chunks]
            self.decoded += [self.library.decode(i) for i in found]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        used = self.starts[-1]
        self.starts = np.concatenate([self.starts, used + np.cumsum(counts)])
        if self.starts[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(2 * self.starts[-1] - used, np.int32)])
        self.ids[used : self.starts[-1]] = np.fromiter((i for ids in found for i in ids), np.int32, self.starts[-1] - used)
        self.size += sum(map(len, chunks)) * 8 + len(chunks) * 200 + int(counts.sum()) * 4

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids of all texts one after another, the number of each text, decoded texts)."""
        if self.size > self.most:
            self.clear()
        known, code, codes, sizes = len(self.codes), self.codes.__getitem__, [], []
        for t in texts:
            mine = np.fromiter(map(code, self.chunks(t or "")), np.int64)
            codes.append(mine)
            sizes.append(len(mine))
        if len(self.codes) > known:
            self._add(list(self.codes)[known:])
        lengths = np.diff(self.starts)
        decoded = ["".join(map(self.decoded.__getitem__, c.tolist()))[1 if self.borders else 0 :] for c in codes]
        at = np.concatenate([np.zeros(0, np.int64), *codes])
        n = lengths[at]
        places = np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]
        return self.ids[places], np.diff(ends), decoded


def _mapped(df: DataFrame, value: str, keep: list[str] | None, schema: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``keep`` columns (all by default) and those of ``schema``, made of the ``value`` column some megabytes at a time."""
    names = T.StructType.fromDDL(schema).names
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    renamed = df.select(F.col(f"`{value}`").alias("_v"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    fields = [f for f in renamed.schema.fields if f.name != "_v"] + [T.StructField(f"_r{i}", f.dataType) for i, f in enumerate(T.StructType.fromDDL(schema).fields)]
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Batches) -> Batches:
        work = make()
        for batch in batches:
            for part in by_bytes(batch, 0, _AT_ONCE) if pa.types.is_string(batch.column(0).type) else (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                columns = [*part.columns[1:], *work(part.column(0))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return renamed.mapInArrow(run, T.StructType(fields)).toDF(*keep, *names)


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) of every row, and n_tokens, ids and decoded, the text that the ids give again.

    Ids are those of the library's ``encode`` without begin and end ids, ``decoded`` is its ``decode`` of them.
    ``model`` is the path of a model file that every executor can read. Null and empty texts have no ids and
    decode to an empty text; repeated rows are encoded each; a very long text goes alone through the table.
    Columns called like a result are replaced. An empty table gives an empty one.

    Nothing is shuffled: a task's table of chunks serves all its texts, and starts anew when it has grown to
    64 MB. A model that changes texts before it segments them, or with pieces across markers, has whole
    texts as its chunks.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        table = ChunkTable(model)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, counts, decoded = table.encode(texts.to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            return [pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(decoded, pa.string())]

        return work

    return _mapped(docs, text_col, keep, "n_tokens long, ids array<int>, decoded string", make)


def decode(rows: DataFrame, model: str, keep: list[str] | None = None, ids_col: str = "ids") -> DataFrame:
    """``keep`` columns (all by default) of every row, and ``decoded``, the library's text of any ids.

    Null and empty arrays give an empty text; null ids in an array are left out; an id outside the vocabulary
    fails the task, as in the library.
    """

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        library = processor(model)
        return lambda ids: [pa.array([library.decode([i for i in x or [] if i is not None]) if x else "" for x in ids.to_pylist()], pa.string())]

    return _mapped(rows, ids_col, keep, "decoded string", make)
