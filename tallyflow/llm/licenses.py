"""License scans: exact phrases, and notices found with bounded errors.

A notice with at most k edits contains at least one of its k + 1 pieces unchanged. The pieces of all notices are
searched exactly in one pass; around each place the regex library matches the whole notice with at most k errors,
which verifies the edits and gives the span. Words that tell one licence from another must stand exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import WORD_BYTES, with_results

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Short notices in words, and their labels. Words in capitals must stand exactly.
NOTICES = {
    "all rights reserved": "reserved",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "licensed under the APACHE license": "apache-2.0",
    "APACHE license version 2 0": "apache-2.0",
    "MIT license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "BSD license": "bsd",
    "BSD 2 CLAUSE license": "bsd-2-clause",
    "BSD 3 CLAUSE license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd",
    "ISC license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "the software is provided as is": "no-warranty",
    "this software is provided by the copyright holders and contributors as is": "no-warranty",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "microsoft public license": "ms-pl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "python software foundation license": "psf",
    "academic free license": "afl",
    "artistic license 2 0": "artistic",
    "ZLIB license": "zlib",
    "SIL open font license": "ofl",
    "open database license": "odbl",
    "this is free and unencumbered software": "unlicense",
    "released into the public domain": "public-domain",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "licensed under CC0": "cc0",
    "business source license": "busl",
    "THE UNLICENSE": "unlicense",
    "APACHE 2 0": "apache-2.0",
    "APACHE LICENSED": "apache",
    "MIT LICENSED": "mit",
    "BSD LICENSED": "bsd",
}

# The parts of short names, and the identifiers of tags with their labels.
CC_PARTS = ["BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND"]
GNU = ["GPL", "LGPL", "AGPL"]
TAGS = {
    "MIT": "mit",
    "MIT 0": "mit-0",
    "APACHE 1 1": "apache-1.1",
    "APACHE 2 0": "apache-2.0",
    "BSD 2 CLAUSE": "bsd-2-clause",
    "BSD 3 CLAUSE": "bsd-3-clause",
    "BSD 4 CLAUSE": "bsd-4-clause",
    "0BSD": "0bsd",
    "ISC": "isc",
    "MPL 1 1": "mpl",
    "MPL 2 0": "mpl",
    "EPL 1 0": "epl",
    "EPL 2 0": "epl",
    "BSL 1 0": "bsl",
    "BUSL 1 1": "busl",
    "CC0": "cc0",
    "UNLICENSE": "unlicense",
    "ZLIB": "zlib",
    "OFL 1 1": "ofl",
    "ODBL 1 0": "odbl",
    "EUPL 1 2": "eupl",
    "ARTISTIC 2 0": "artistic",
    "MS PL": "ms-pl",
    "CDDL 1 0": "cddl",
    "GFDL 1 3": "gfdl",
}


def families() -> dict[str, str]:
    """Notices made of the parts: every short name alone, if it is no phrase already, and behind the words that announce it.

    A name that another begins with is found in that one too, at the same place, where the longer one counts.
    """
    cc = {f"CC {parts}": f"cc-{parts.lower().replace(' ', '-')}" for parts in CC_PARTS}
    gnu = {name: name.lower() for name in GNU}
    made = {name: label for name, label in cc.items() if name.lower() not in PHRASES} | gnu | {f"{name}V{version}": name.lower() for name in GNU for version in (1, 2, 3)}
    made |= {f"licensed under {name}": label for name, label in cc.items()} | {name.replace("CC", "creative commons"): label for name, label in cc.items()}
    return made | {f"spdx license identifier {name}": label for name, label in (cc | gnu | TAGS).items()}


class Match(NamedTuple):
    label: str
    first_word: int
    last_word: int
    edits: int
    similarity: float


class Place(NamedTuple):
    start: int
    end: int
    edits: int


class Notice:
    """One notice: its pieces with their places, and the pattern that verifies it."""

    def __init__(self, text: str, label: str, error_rate: float) -> None:
        self.text, self.label = text.lower(), label
        self.edits = int(len(text) * error_rate)
        cuts = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        halves = [len(text) * i // (2 * self.edits + 2) for i in range(2 * self.edits + 3)]
        self.halves = [self.text[a:b].encode() for a, b in zip(halves, halves[1:], strict=False)]
        self.telling = [f" {w.lower()} ".encode() for w in text.split() if w == w.upper()]
        self.slack = 4 * self.edits + 1  # an edit may be a character of 4 bytes
        # Runs of words that must stand exactly, and what is between them, spaces included, with errors.
        parts = re.findall(r"[A-Z0-9]+(?: [A-Z0-9]+)*|[a-z ]+", text)
        made = [regex.escape(p, literal_spaces=True) if p.islower() else rf"(?<![^ ]){regex.escape(p.lower(), literal_spaces=True)}(?![^ ])" for p in parts]
        within = [rf"(?:{m}){{e<={self.edits}}}" if p.islower() else m for m, p in zip(made, parts, strict=True)]
        self.pattern = regex.compile(rf"(?b)(?<![^ ])(?:{''.join(within)})(?![^ ])")

    def places(self, norm: bytes, seeds: list[int]) -> list[Place]:
        """Places in ``norm`` around ``seeds`` (where the notice would begin), not overlapping, leftmost first.

        Of matches that overlap the one with the fewest edits stays, then the first.
        """
        found: set[Place] = set()
        whole = f" {self.text} ".encode()
        for seed in sorted(set(seeds)):
            if seed > 0 and norm.startswith(whole, seed - 1):
                found.add(Place(seed, seed + len(self.text), 0))
                continue
            start, end = max(0, seed - self.slack), min(len(norm), seed + len(self.text) + self.slack)
            # An edit spoils at most one of the half pieces.
            if any(norm.find(w, start, end) < 0 for w in self.telling) or sum(norm.find(h, start, end) >= 0 for h in self.halves) < self.edits + 2:
                continue
            while start > 0 and norm[start] & 0xC0 == 0x80:  # not inside a character
                start -= 1
            while end < len(norm) and norm[end] & 0xC0 == 0x80:
                end += 1
            area = norm[start:end].decode(errors="ignore")
            for m in self._matches(area, 0, len(area)):
                a = start + len(area[: m.start()].encode())
                found.add(Place(a, a + len(m[0].encode()), sum(m.fuzzy_counts)))
        chosen: list[Place] = []
        for p in sorted(found, key=lambda p: (p.edits, p.start, p.end)):
            at = bisect_left(chosen, p)
            if (at == 0 or chosen[at - 1].end <= p.start) and (at == len(chosen) or p.end <= chosen[at].start):
                insort(chosen, p)
        return chosen

    def _matches(self, area: str, start: int, end: int) -> Iterator[regex.Match]:
        """The best match of a short area, those before it and those behind it."""
        while end - start >= len(self.text) - self.edits and (m := self.pattern.search(area, start, end)):
            yield from self._matches(area, start, m.start() - 1)  # without the space between
            if sum(m.fuzzy_counts) <= self.edits:
                yield m
            start = m.end()


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] | None = None, error_rate: float = 0.1) -> None:
        notices = NOTICES | families() if notices is None else notices
        self.phrases = [(re.compile(rb"(?<= )" + re.escape(p.encode()) + rb"(?= )"), len(p.split()), label) for p, label in phrases.items()]
        self.rare = [max(p.split(), key=len).encode() for p in phrases]
        self.notices = [Notice(p, label, error_rate) for p, label in notices.items()]
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for piece, offset in notice.pieces:
                uses.setdefault(piece, []).append((n, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, of in uses.items():
            self.seeds.add_word(piece, (len(piece), of))
        self.seeds.make_automaton()

    def notices_in(self, norm: bytes) -> Iterator[tuple[Notice, Place]]:
        """Every place of every notice in ``norm``, the text's words between single spaces."""
        around: dict[int, list[int]] = {}
        for last, (size, of) in self.seeds.iter(norm.decode("latin-1")):  # a character for each byte
            for n, offset in of:
                around.setdefault(n, []).append(last + 1 - size - offset)
        for n, seeds in around.items():
            for p in self.notices[n].places(norm, seeds):
                yield self.notices[n], p

    def scan(self, text: bytes | None) -> tuple[int, list[Match], list[Match]]:
        """(number of words, exact phrase places, notices found with errors and not inside a longer one)."""
        words = (text or b"").translate(WORD_BYTES).split()
        norm = b" " + b" ".join(words) + b" "
        exact = [(m.start(), n, label) for (pattern, n, label), rare in zip(self.phrases, self.rare, strict=True) if rare in norm for m in pattern.finditer(norm)]
        found = sorted(self.notices_in(norm), key=lambda x: (x[1].start, -x[1].end, x[1].edits, x[0].text))
        if not exact and not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        word_at = lambda p: int(np.searchsorted(spaces, p)) - 1  # noqa: E731  of the word that p is in
        base = [Match(label, w := word_at(at), w + n - 1, 0, 1.0) for at, n, label in exact]
        fuzzy, reach = [], 0
        for notice, p in found:
            if p.end > reach:
                fuzzy.append(Match(notice.label, word_at(p.start), word_at(p.end - 1), p.edits, 1 - p.edits / len(notice.text)))
                reach = p.end
        return len(words), base, fuzzy


def license_scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", error_rate: float = 0.1) -> DataFrame:
    """``keep`` columns (all by default) of every row, and what the scan finds in its whole text.

    n_words; n_base, places of exact phrases; first_word and last_word, their smallest and largest start;
    base_labels and labels (the notices' too), distinct, sorted and comma-joined; score, the best similarity
    of any match (1 - edits / length, exact phrases 1, none 0); spans of all matches in words. A notice inside
    a longer one that was found doesn't count. Null and empty texts have no words, empty labels, null first
    and last words and score 0. Every row is read by itself: repeated rows give the same result each, and an
    empty table gives an empty one. Whole texts are searched, in time that grows with their length and the
    number of matches. Columns called like a result are replaced.
    """

    def make() -> Callable[[list[list]], list[list]]:
        scanner = Scanner(error_rate=error_rate)

        def work(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for text in columns[0]:
                n, base, fuzzy = scanner.scan(text)
                starts = [m.first_word for m in base]
                row = (n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({m.label for m in base})),
                       ",".join(sorted({m.label for m in base + fuzzy})), max((m.similarity for m in base + fuzzy), default=0.0),
                       [m._asdict() for m in sorted(base + fuzzy, key=lambda m: (m.first_word, m.last_word, m.label))])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return with_results(docs, [F.col(text_col).cast("binary")], docs.columns if keep is None else keep, make,
                        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                        "spans array<struct<label: string, first_word: long, last_word: long, edits: long, similarity: double>>")
