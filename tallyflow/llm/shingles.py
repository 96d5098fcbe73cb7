"""Sets of hashed word shingles, made of many texts at once in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_rng.integers(0, 2**62)) * 4 + 3
_BACK = pow(_STEP, -1, 2**64)
_AT_ONCE = 1 << 20
_powers = {"to": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def _power(which: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for later calls."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 2 * _AT_ONCE), base, np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # A word's hash is a polynomial of its bytes: a difference of running sums, moved back to place 0.
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("to", _STEP, len(data)), out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * _power("back", _BACK, len(data) + 1)[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    first = np.searchsorted(starts, begins)  # each text's first word
    counts = np.diff([*first, len(starts)])
    windows = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        windows += words[j : j + len(windows)] * _PLACE[j]
    windows = _mixed(windows)
    out = []
    for at, n in zip(first, counts, strict=True):
        if n >= WORDS:
            out.append(np.unique(windows[at : at + n - WORDS + 1]))
        elif n:
            out.append(_mixed((words[at : at + n] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words each, lower-cased A-Z, between ASCII spaces.

    A text of fewer words is one shingle, without words none; null counts as empty. Texts go through
    numpy about a megabyte at a time; a longer one by itself.
    """
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append(t or b"")
        size += len(group[-1])
        if size >= _AT_ONCE:
            yield from _sets(group)
            group, size = [], 0
    if group:
        yield from _sets(group)


def digest(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
