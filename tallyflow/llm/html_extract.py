"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block is read as a vector of its tag path (hashed tags and names),
a vector of its words (hashed) and a few numbers, of itself and of the part of the page it stands in; a bidirectional LSTM in numpy passes over the sequence, so
that every block is classified with the whole document as context. The weights are learned once on the driver
from made-up labelled pages, and broadcast; their size is fixed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import with_results
from tallyflow.llm.html_blocks import Block, blocks
from tallyflow.llm.html_samples import page as sample_page

PATHS, WORDS, EMBEDDED, HIDDEN, NUMBERS = 2048, 1024, 16, 20, 9
_PARTS = frozenset("article aside body dialog div footer form header main nav section".split())
_AT_ONCE = 4096  # blocks of a batch of pages, to bound the arrays


@lru_cache(maxsize=100_000)
def path_ids(path: tuple[str, ...]) -> np.ndarray:
    """Hashed tokens of a path: each tag and name, and those of the two innermost steps once more as such."""
    tokens = [t for step in path for t in step.split()]
    for place, step in zip(("in", "up"), path[::-1], strict=False):
        tokens += [f"{place}:{t}" for t in step.split()]
    return np.array([zlib.crc32(t.encode()) % PATHS for t in tokens] or [0])


def word_ids(text: str) -> list[int]:
    crc = zlib.crc32
    return [crc(w) % WORDS for w in text.lower().encode().split()]


def numbers(b: Block) -> list[float]:
    n = len(b.text)
    return [min(2.0, np.log1p(n) / 5), b.linked / n, float(b.text[-1] in ".!?"), sum(map(b.text.count, "0123456789")) / n, min(2.0, np.log1p(b.text.count(" ")) / 3)]


def _region(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path down to its innermost part of the page."""
    at = next((i for i in range(len(path) - 1, -1, -1) if path[i].partition(" ")[0] in _PARTS), -1)
    return path[: at + 1]


def regions(page: list[Block]) -> np.ndarray:
    """For each block, of the part of the page that it stands in: whether it goes on, its share of the text and of the blocks, and its share of linked text."""
    names: dict[tuple[str, ...], int] = {}
    of = np.array([names.setdefault(_region(b.path), len(names)) for b in page])
    size, linked = np.array([len(b.text) for b in page], float), np.array([b.linked for b in page], float)
    text = np.bincount(of, size)
    goes_on = np.concatenate([[0.0], of[1:] == of[:-1]])
    return np.stack([goes_on, (text / size.sum())[of], (np.bincount(of) / len(of))[of], (np.bincount(of, linked) / text)[of]], 1)


class Prepared(NamedTuple):
    """A page's blocks as hashed ids, one after another, with the places where each block's begin."""

    paths: np.ndarray
    path_starts: np.ndarray
    words: np.ndarray
    word_starts: np.ndarray
    word_counts: np.ndarray
    numbers: np.ndarray


def prepared(page: list[Block]) -> Prepared:
    paths, words = [path_ids(b.path) for b in page], [word_ids(b.text) for b in page]
    counts = np.array([*map(len, words)])
    return Prepared(np.concatenate(paths), np.cumsum([0, *map(len, paths)])[:-1], np.fromiter(chain.from_iterable(words), np.int64, counts.sum()), np.cumsum([0, *counts])[:-1],
                    counts.astype(np.float32), np.concatenate([np.array([numbers(b) for b in page]), regions(page)], 1).astype(np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Embeddings, one LSTM for each direction, and a logistic output on both states."""

    def __init__(self, seed: int) -> None:
        r = np.random.default_rng(seed)
        wide = 2 * EMBEDDED + NUMBERS
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.w = {"path": draw(PATHS, EMBEDDED, scale=0.3), "word": draw(WORDS, EMBEDDED, scale=0.02), "out": draw(2 * HIDDEN, 1, scale=0.2), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.w |= {f"x{d}": draw(wide, 4 * HIDDEN, scale=wide**-0.5), f"h{d}": draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1.0  # remembers at first

    def inputs(self, page: Prepared) -> np.ndarray:
        """A row for each block."""
        path = np.add.reduceat(self.w["path"][page.paths], page.path_starts, axis=0) / 4
        word = np.add.reduceat(self.w["word"][page.words], page.word_starts, axis=0) * (3 / page.word_counts)[:, None]
        return np.concatenate([path, word, page.numbers], 1)

    def pass_over(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, page, unit) of one direction; where ``mask`` is 0 a state stays what it was."""
        steps, pages = x.shape[:2]
        projected = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = projected[t] + h @ self.w[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            m = mask[t][:, None]
            c_new = f * c + i * g
            tanh_c = np.tanh(c_new)
            if keep:
                trace.append((t, h, c, i, f, o, g, tanh_c))
            c = m * c_new + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            out[t] = h
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self.pass_over(x, mask, "f")[0], self.pass_over(x, mask, "b")[0]], 2)
        return (states @ self.w["out"] + self.w["bias"])[:, :, 0]

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is of the article; pages of like length are passed over together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while at + len(group) < len(order) and len(pages[order[at + len(group)]]) * (len(group) + 1) <= _AT_ONCE:
                group.append(order[at + len(group)])
            at += len(group)
            x = np.zeros((len(pages[group[-1]]), len(group), 2 * EMBEDDED + NUMBERS), np.float32)
            mask = np.zeros(x.shape[:2], np.float32)
            for k, i in enumerate(group):
                x[: len(pages[i]), k], mask[: len(pages[i]), k] = self.inputs(prepared(pages[i])), 1
            marks = self.logits(x, mask) > 0
            for k, i in enumerate(group):
                out[i] = marks[: len(pages[i]), k]
        return out


def _gradients(net: Labeller, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(of the weights, of the inputs, loss) of the mean log loss over the blocks."""
    passes = {d: net.pass_over(x, mask, d, keep=True) for d in "fb"}
    states = np.concatenate([passes["f"][0], passes["b"][0]], 2)
    p = _sigmoid((states @ net.w["out"] + net.w["bias"])[:, :, 0])
    n = mask.sum()
    loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
    slope = (mask * (p - y) / n).astype(np.float32)
    grads = {"out": np.einsum("tpk,tp->k", states, slope)[:, None], "bias": slope.sum(keepdims=True)[0]}
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        d_states = slope[:, :, None] * net.w["out"][part, 0]
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        dh, dc, d_hidden = np.zeros_like(x[0, :, :HIDDEN]), np.zeros_like(x[0, :, :HIDDEN]), np.zeros_like(net.w[f"h{d}"])
        for t, h, c, i, f, o, g, tanh_c in reversed(passes[d][1]):
            m = mask[t][:, None]
            dh = dh + d_states[t]
            dh_new, dc_new = m * dh, m * dc
            dc_new = dc_new + dh_new * o * (1 - tanh_c**2)
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_new * tanh_c * o * (1 - o), dc_new * i * (1 - g**2)], 1)
            dz_all[t] = dz
            d_hidden += h.T @ dz
            dh, dc = dz @ net.w[f"h{d}"].T + (1 - m) * dh, dc_new * f + (1 - m) * dc
        grads |= {f"x{d}": np.einsum("tpi,tpj->ij", x, dz_all, optimize=True), f"h{d}": d_hidden, f"c{d}": dz_all.sum((0, 1))}
        dx += dz_all @ net.w[f"x{d}"].T
    return grads, dx, loss


@lru_cache(maxsize=2)
def trained(n_pages: int = 4000, epochs: int = 6, seed: int = 11, pages_at_once: int = 25, rate: float = 0.01) -> Labeller:
    """Learns from ``n_pages`` made-up pages (a bound that no corpus changes); the same weights every time."""
    rng = np.random.default_rng(seed)
    net = Labeller(seed)
    made = []
    for _ in range(n_pages):
        text, labels = sample_page(rng)
        found = blocks(text)
        if len(found) != len(labels):
            raise AssertionError(f"{len(found)} blocks, {len(labels)} labels: {text}")
        if found:
            made.append((prepared(found), np.array(labels, np.float32)))
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step, total = 0, epochs * -(-len(made) // pages_at_once)
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 10 * pages_at_once):  # pages of like length go together
            order[at : at + 10 * pages_at_once] = sorted(order[at : at + 10 * pages_at_once], key=lambda i: len(made[i][1]))
        for at in rng.permutation(np.arange(0, len(order), pages_at_once)):
            group = [made[i] for i in order[at : at + pages_at_once]]
            longest = max(len(y) for _, y in group)
            x = np.zeros((longest, len(group), 2 * EMBEDDED + NUMBERS), np.float32)
            y, mask = np.zeros(x.shape[:2], np.float32), np.zeros(x.shape[:2], np.float32)
            for k, (found, labels) in enumerate(group):
                x[: len(labels), k], y[: len(labels), k], mask[: len(labels), k] = net.inputs(found), labels, 1
            # Words are left out at random, and fade, so that invented ones don't stand against a clear path.
            heard = (rng.random(x.shape[:2]) < 0.5)[:, :, None]
            x[:, :, EMBEDDED : 2 * EMBEDDED] *= heard
            grads, dx, _ = _gradients(net, x, mask, y)
            dx[:, :, EMBEDDED : 2 * EMBEDDED] *= heard
            grads |= {"path": np.zeros_like(net.w["path"]), "word": np.zeros_like(net.w["word"])}
            for k, (found, labels) in enumerate(group):
                d_path, d_word = dx[: len(labels), k, :EMBEDDED] / 4, dx[: len(labels), k, EMBEDDED : 2 * EMBEDDED] * (3 / found.word_counts)[:, None]
                np.add.at(grads["path"], found.paths, np.repeat(d_path, np.diff([*found.path_starts, len(found.paths)]), axis=0))
                np.add.at(grads["word"], found.words, np.repeat(d_word, found.word_counts.astype(int), axis=0))
            step += 1
            pace = rate * (1 - step / (total + 1))
            for name, g in grads.items():  # Adam
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                net.w[name] -= (pace * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            net.w["word"] *= 0.99
    return net


def extract(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html", n_pages: int = 4000) -> DataFrame:
    """``keep`` columns (all by default) of every row, text and n_chars (code points).

    The text is that of all blocks labelled as the article's, in page order, one a line. Null and empty html,
    and pages without an article, give an empty text and 0. Every row is read by itself: repeated rows give the
    same result each, and an empty table gives an empty one. Whole pages are read, in time that grows with
    their length. Columns called text or n_chars are replaced. The first call of a driver trains the labeller
    (about a minute); later ones reuse it.
    """
    net = pages.sparkSession.sparkContext.broadcast(trained(n_pages))

    def make() -> Callable[[list[list]], list[list]]:
        labeller = net.value

        def work(columns: list[list]) -> list[list]:
            found = [blocks(x) for x in columns[0]]
            texts = ["\n".join(b.text for b, main in zip(page, marks, strict=True) if main) for page, marks in zip(found, labeller.label(found), strict=True)]
            return [texts, [len(t) for t in texts]]

        return work

    return with_results(pages, [F.col(html_col)], pages.columns if keep is None else keep, make, "text string, n_chars long")
