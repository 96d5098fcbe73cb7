"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into quantile bins. Cyclic boosting visits the features in turn and adds to
each one's lookup table a small step of a shallow tree on its bins; then the same over the pairs of features
whose coarse bins explain most of what is left. A score is a sum of table entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import with_results

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "exclamations", "stops", "pipes", "repeats", "distinct", "line_words", "line_repeats", "longest_word", "other_bytes", "plain_words")
_CLASSES = np.zeros(256, np.int64)  # of bytes: 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 !, 6 stop, 7 pipe, 8 space, 9 above ASCII
for _of, _k in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (b"#$%&*@^_~<>{}[]\\/=+`", 4), (b"!", 5), (b".,;:?", 6), (b"|", 7), (b" \t\n\r\x0b\x0c", 8), (range(128, 256), 9)):
    _CLASSES[list(_of)] = _k
_ALNUM = frozenset(range(48, 58)) | frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """The whole text in numbers; null as empty."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASSES, weights=counts, minlength=10)
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    letters, dense = max(1.0, kinds[1] + kinds[2]), max(1.0, len(text) - kinds[8])
    full = [x for x in lines if x]
    return [
        math.log1p(len(text)), math.log1p(len(words)), dense / n, kinds[1] / letters, kinds[3] / dense, kinds[4] / dense, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        sum(map(eq, words, islice(words, 1, None))) / n, len(set(words)) / n**0.9, n / len(lines), 1 - len(set(full)) / max(1, len(full)),
        math.log1p(max(map(len, words), default=0)), kinds[9] / size, sum(w[-1] in _ALNUM for w in words) / n,
    ]


@dataclass
class Model:
    """Lookup tables over bins; ``tables[f][bin]`` and ``pairs[(f, g)][bin, bin]`` in log odds."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[_binned(x[:, f], self.edges[f])]
        for (f, g), table in self.pairs.items():
            total += table[_binned(x[:, f], self.coarse[f]), _binned(x[:, g], self.coarse[g])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    return g.sum() / (h.sum() + ridge)


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """(gain, cut) of the best split of bins into those before and from ``cut``; cut 0 when there is none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((hl > 1e-3) & (hr > 1e-3), gain, 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree of ``depth`` levels on one feature's sums of gradients."""
    _, cut = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), _leaf(g, h, ridge))
    return np.concatenate([_tree(g[:cut], h[:cut], ridge, depth - 1), _tree(g[cut:], h[cut:], ridge, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of the best tree that cuts one feature of a pair, then the other on either side."""
    best, values = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            sides = [(a[:cut].sum(0), b[:cut].sum(0)), (a[cut:].sum(0), b[cut:].sum(0))]
            gain = sum(_best_cut(x, y, ridge)[0] + x.sum() ** 2 / (y.sum() + ridge) for x, y in sides) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best:
                best = gain
                rows = [_tree(x, y, ridge, 1) for x, y in sides]
                out = np.vstack([np.tile(rows[0], (cut, 1)), np.tile(rows[1], (len(a) - cut, 1))])
                values = out.T if flip else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 25, n_pairs: int = 6, rate: float = 0.1, ridge: float = 1.0) -> Model:
    """Boosts main effects, then the strongest pairs. Deterministic. Without both labels only the rate is learned."""
    edges, coarse = [_edges(c, bins) if len(c) else np.zeros(0) for c in x.T], [_edges(c, coarse_bins) if len(c) else np.zeros(0) for c in x.T]
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, coarse, math.log(rate_of_ones / (1 - rate_of_ones)), [np.zeros(len(e) + 1) for e in edges])
    if not 0 < y.sum() < len(y):
        return model
    at, rough = [_binned(c, e) for c, e in zip(x.T, edges, strict=True)], [_binned(c, e) for c, e in zip(x.T, coarse, strict=True)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), ridge)
            table += step
            margin += step[at[f]]

    def grids(f: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[f]) + 1, len(coarse[k]) + 1
        cell = rough[f] * shape[1] + rough[k]
        g, h = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*grids(f, k)[1:], ridge)[0], f, k) for f, k in combinations(range(len(edges)), 2)), reverse=True)
    chosen = [(f, k) for gain, f, k in gains[:n_pairs] if gain > 0]
    model.pairs = {(f, k): np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1)) for f, k in chosen}
    for _ in range(pair_rounds):
        for (f, k), table in model.pairs.items():
            cell, g, h = grids(f, k)
            step = rate * _pair_tree(g, h, ridge)[1]
            table += step
            margin += step.ravel()[cell]
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits the model on at most ``sample_rows`` labelled rows, those of the smallest hashes of their ids.

    Rows with remainder 0 are held out. Labels without id or value are left out, and of several labels of an
    id the smallest counts. Only the sample's texts are made into features, and only those reach the driver.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    sample = (usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")

    def make() -> Callable[[list[list]], list[list]]:
        return lambda columns: [[features(t) for t in columns[0]]]

    # Repeated rows of an id could pass the bound; one of each is taken.
    got = with_results(rows, [F.col("text").cast("binary")], ["id", "label"], make, "x array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("id").collect()
    x, y = np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r.label for r in got], float)
    return fit(x, y)


def classify(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) of every row, score (0 to 1) and predicted (score >= ``threshold``).

    Scores depend on the whole text alone; null counts as empty, and empty texts get a score like any other.
    Repeated rows get the same result each; an empty table gives an empty one. Columns called score or
    predicted are replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[list]], list[list]]:
        known = told.value

        def work(columns: list[list]) -> list[list]:
            score = known.score(np.array([features(t) for t in columns[0]]).reshape(-1, len(FEATURES)))
            return [score.tolist(), (score >= threshold).astype(int).tolist()]

        return work

    return with_results(docs, [F.col(text_col).cast("binary")], docs.columns if keep is None else keep, make, "score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted.

    Rows without id are held out; rows that repeat an id, or a text, have a row each. Null and empty texts get a
    score like any other, of the features of an empty text. A very long text is read whole. Without labels every
    score is 0.5. Other columns are neither read nor returned, so none can clash. An empty table gives an empty one.
    """
    scored = classify(docs, train(docs, labels, id_col=id_col), keep=[id_col])
    return scored.select(id_col, F.coalesce(remainder(F.col(id_col)) == 0, F.lit(True)).alias("held_out"), "score", "predicted")
