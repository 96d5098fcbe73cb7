"""Personal data: exact patterns, disguised identifiers found in a normalised text, and secrets.

Exact identifiers come from the source text. Disguises are undone by small transducers that rewrite a part
of the text (look-alike letters and digits, spelled digits, at and dot words) and keep, for every character
they write, the source characters it stands for. Identifiers of the rewritten part are mapped back by that.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import with_results

# The kinds, in the order in which they are listed, and their patterns. Possessive forms and
# the look-behind only spare attempts that cannot end otherwise.
KINDS = ("email", "ip", "card", "phone")
#: Those and what the method adds besides: assigned secrets and keys.
ALL_KINDS = (*KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CARD_START = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")

# Look-alikes of ASCII characters (Cyrillic and Greek letters, other forms of digits and signs).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
_FULL_WIDTH = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_OTHER_DIGITS = {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_LOOK_ALIKE = HOMOGLYPHS | _FULL_WIDTH | _OTHER_DIGITS
_HIDDEN = frozenset("​‌‍⁠﻿­")
_FOLD = str.maketrans(_LOOK_ALIKE | dict.fromkeys(_HIDDEN, ""))

# Spelled digits.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_DIGIT_WORD = rf"(?<![a-z])(?:{'|'.join(_SPELLED)})(?![a-z])"
_BETWEEN = r"(?:\x20{0,2}[\[({<]\x20?(?:dot|punto|punkt)\x20?[\])}>]\x20{0,2}|[\x20-]{1,2}(?:dot|punto|punkt)[\x20-]{1,2}|[\x20,.()-]*+)"
# Of lower-case text: digits and digit words in a row, dot words between them, perhaps a plus before.
_NUMBER_RUN = re.compile(rf"(?:\+|(?<![a-z])plus[\x20-]+)?(?:[0-9]++|{_DIGIT_WORD})(?:{_BETWEEN}(?:[0-9]++|{_DIGIT_WORD}))++")
_NUMBER_PART = re.compile(rf"[0-9]++|{_DIGIT_WORD}|{_BETWEEN}")
_WORDED = re.compile(rf"[0-9]{_BETWEEN}{_DIGIT_WORD}|{_DIGIT_WORD}{_BETWEEN}(?:[0-9]|{_DIGIT_WORD})|plus[\x20-]+[0-9]|[0-9][\[({{<\x20-]{{1,3}}(?:dot|punto|punkt)[\])}}>\x20-]{{1,3}}[0-9]")
_PLUS = re.compile(r"\+|plus[\x20-]+")
_LETTER = re.compile("[a-z]")
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# An email's parts from where a run of local characters begins; possessive, so each run is read once whatever its length.
_DISGUISED = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])([A-Za-z0-9._%+-]++)(\x20{0,2}[\[({<]\x20?at\x20?[\])}>]\x20{0,2}|\x20(?:at|arroba)\x20|\x20?@\x20?)"
    r"([A-Za-z0-9-]++(?:(?:\x20{0,2}[\[({<]\x20?(?:dot|punto|punkt)\x20?[\])}>]\x20{0,2}|\x20(?:dot|punto|punkt)\x20|\.)[A-Za-z0-9-]++)++)")
_DOT = re.compile(r"(?i)\x20{0,2}[\[({<]\x20?(?:dot|punto|punkt)\x20?[\])}>]\x20{0,2}|\x20(?:dot|punto|punkt)\x20|\.")
_DOT_WORD = re.compile(r"(?i)[\[({<\x20](?:dot|punto|punkt)[\])}>\x20]")
_AT_OR_DOT = re.compile(r"(?i)[\[({<\x20]\x20?(?:at|arroba|dot|punto|punkt)\x20?[\])}>\x20]")
# Names that secrets are assigned to, in lower case, and the formats of well-known keys.
_NAMES = ("token", "secret", "password", "passwd", "pwd", "key")
_ASSIGNED = re.compile(r"(?:token|secret|password|passwd|pwd|(?:api|access|auth|private)[_-]?key)[\"']?\x20{0,3}(?:=>|[=:])\x20{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|(?=[a-z+/_.~=-]*[0-9])([a-z0-9+/_.~=-]{12,}+))")
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "AIza")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{36}|xox[bp]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])")
_LOOK_ALIKE_RUN = re.compile(f"[{re.escape(''.join(_LOOK_ALIKE))}{''.join(_HIDDEN)}]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches of the email pattern, found from their @: its local part is all that fits before."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(Span("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def exact(text: str) -> list[Span]:
    """The identifiers of the exact patterns, by start, then kind as listed; failing matches are dropped."""
    found = _emails(text)
    if _CARD_START.search(text):
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(Span("card", *m.span()))
    if "." in text:
        found += [Span("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part_fits, m[0].split(".")))]
    if "+" in text:
        found += [Span("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s.start, ALL_KINDS.index(s.kind), s.end


class Rewriter:
    """Text written so far, and for each of its characters the source characters it stands for."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.source: list[tuple[int, int]] = []

    def write(self, text: str, start: int, end: int) -> None:
        """``text`` for the source's start:end; one character each where they are equally long."""
        same = len(text) == end - start
        self.text += text
        self.source += [(start + i, start + i + 1) if same else (start, end) for i in range(len(text))]

    def identifiers(self) -> list[Span]:
        return [Span(s.kind, self.source[s.start][0], self.source[s.end - 1][1]) for s in exact("".join(self.text))]


def _look_alikes(text: str, plain: str, places: list[int] | None) -> list[Span]:
    """Identifiers of the folded text ``plain`` that have look-alike or hidden characters in the source."""
    return [s for s in _placed(exact(plain), places) if _LOOK_ALIKE_RUN.search(text, s.start, s.end)]


class Segment(NamedTuple):
    """Part of a number run, all words or all digits, without punctuation: its place, its digits, and how many are words."""

    start: int
    end: int
    digits: str
    words: int
    dot: bool  # after a dot word


def _judged(segments: list[Segment], plus: bool) -> str | None:
    """The kind of a number of these segments: a card, or a phone with a plus or at least two digit words."""
    digits, words = "".join(s.digits for s in segments), sum(s.words for s in segments)
    if not words:
        return None
    if 14 <= len(digits) <= 19 and _luhn(digits):
        return "card"
    return "phone" if 10 <= len(digits) <= 15 and (plus or words > 1) else None


def _divided(segments: list[Segment], plus: bool) -> list[Span]:
    """The numbers made of whole segments that leave the fewest digits over, as few as possible."""
    best: list[tuple[int, int, int, str | None]] = [(0, 0, 0, None)]  # digits left, numbers, the last one's first segment and kind
    for end in range(1, len(segments) + 1):
        left, numbers, _, _ = best[-1]
        choice = (left + len(segments[end - 1].digits), numbers, end - 1, None)
        start, size = end - 1, len(segments[end - 1].digits)
        while size <= 19:
            kind = _judged(segments[start:end], plus and start == 0) if size >= 10 else None
            if kind:
                choice = min(choice, (best[start][0], best[start][1] + 1, start, kind), key=lambda c: c[:2])
            start -= 1
            if start < 0:
                break
            size += len(segments[start].digits)
        best.append(choice)
    found, end = [], len(segments)
    while end:
        _, _, start, kind = best[end]
        if kind:
            found.append(Span(kind, segments[start].start, segments[end - 1].end))
        end = start
    return found


def _spelled(segments: list[Segment], plus: bool) -> list[Span]:
    """Numbers of digit words alone, and those of words and digits, which take such a number whole or not at all."""
    groups: list[list[Segment]] = []
    for s in segments:
        if groups and not s.dot and (s.words > 0) == (groups[-1][-1].words > 0):
            groups[-1].append(s)
        else:
            groups.append([s])
    found: list[Span] = []
    whole: list[Segment] = []
    for group in groups:
        numbers = _divided(group, plus and group is groups[0]) if group[0].words else []
        found += numbers
        starts = [n.start for n in numbers]
        for s in group:
            last, of = whole[-1] if whole else None, bisect_right(starts, s.start) - 1
            if last and of >= 0 and starts[of] <= last.start and s.end <= numbers[of].end:
                whole[-1] = Segment(last.start, s.end, last.digits + s.digits, last.words + s.words, last.dot)
            else:
                whole.append(s)
    return found if len(groups) == 1 else found + _divided(whole, plus)


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_TO_LOWER)


def _numbers(low: str) -> list[Span]:
    """Identifiers in runs of digits, spelled digits and dot words of a lower-case text.

    The run is rewritten for the exact patterns. Besides, punctuation may stand between the words of a phone or
    card number, or between two numbers; such a run is divided where it fits best.
    """
    found = []
    for run in _NUMBER_RUN.finditer(low):
        if not _LETTER.search(low, *run.span()):
            continue
        out, end = Rewriter(), run.start()
        plus = _PLUS.match(low, end)
        if plus:
            out.write("+", *plus.span())
            end = plus.end()
        segments: list[Segment] = []
        parts = [segments]
        between, last_word, first = (end, end), False, True
        for m in _NUMBER_PART.finditer(low, end, run.end()):
            digits, spelled = _SPELLED.get(m[0], m[0]), m[0] in _SPELLED
            if not digits.isdigit():
                between = m.span() if m[0] else between
                continue
            gap = low[slice(*between)]
            dot = _LETTER.search(gap)
            stop = "," in gap or "." in gap
            if dot:
                out.write(".", *between)
            elif stop or not (spelled and last_word):
                out.write(gap, *between)
            if stop and segments and not (spelled and last_word):  # digits aren't joined over punctuation
                segments = []
                parts.append(segments)
            if segments and not stop and not dot and spelled == last_word:
                last = segments.pop()
                segments.append(Segment(last.start, m.end(), last.digits + digits, last.words + spelled, last.dot))
            else:
                segments.append(Segment(run.start() if first else m.start(), m.end(), digits, int(spelled), bool(dot)))
            out.write(digits, *m.span())
            between, last_word, first = (m.end(), m.end()), spelled, False
        known = [s for s in out.identifiers() if _LETTER.search(low, s.start, s.end)]
        found += known
        ips = [s for s in known if s.kind == "ip"]
        ends = [s.end for s in ips]
        for segments in parts:
            for apart, group in groupby(segments, lambda s: (at := bisect_right(ends, s.start)) == len(ips) or s.end <= ips[at].start):
                rest = list(group)
                if apart:
                    found += _spelled(rest, bool(plus) and rest[0].start == run.start())
    return found


def _at_and_dot(text: str) -> list[Span]:
    """Emails with at or dot disguised. A bare " at " counts only together with a dot word."""
    found, at = [], 0
    while m := _DISGUISED.search(text, at):
        at = m.end()
        bare = m[2].strip().lower() in ("at", "arroba")
        if m[2] == "@" and not _DOT_WORD.search(m[3]) or bare and not _DOT_WORD.search(m[3]) or m[2].strip() == "@" and m[2] != "@" and not _DOT_WORD.search(m[3]):
            at = m.start() + 1 + len(m[1])
            continue
        out = Rewriter()
        out.write(m[1], *m.span(1))
        out.write("@", *m.span(2))
        place = m.start(3)
        for d in _DOT.finditer(text, m.start(3), m.end(3)):
            out.write(text[place : d.start()], place, d.start())
            out.write(".", *d.span())
            place = d.end()
        out.write(text[place : m.end(3)], place, m.end(3))
        found += out.identifiers()
    return found


def _secrets(plain: str, low: str) -> list[Span]:
    """Values assigned to a telling name (quoted, or long with a digit), and keys of well-known formats."""
    found = []
    if any(name in low for name in _NAMES):
        found += [Span("secret", *m.span(m.lastindex)) for m in _ASSIGNED.finditer(low)]
    if any(start in plain for start in _KEY_STARTS):
        found += [Span("secret", *m.span()) for m in _KEY.finditer(plain)]
    return found


def _folded(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes undone and hidden characters left out, and the source places of its characters where those moved."""
    plain = text.translate(_FOLD)
    if len(plain) == len(text):
        return plain, None
    return plain, [i for i, c in enumerate(text) if c not in _HIDDEN]


def _placed(spans: list[Span], places: list[int] | None) -> list[Span]:
    """Spans of the folded text as spans of the source."""
    return spans if places is None else [Span(s.kind, places[s.start], places[s.end - 1] + 1) for s in spans]


def disguised(text: str) -> list[Span]:
    """Identifiers behind one disguise or several at once: words are read after look-alikes are undone."""
    found: list[Span] = []
    plain, places = text, None
    if not text.isascii() and _LOOK_ALIKE_RUN.search(text):
        plain, places = _folded(text)
        found = _look_alikes(text, plain, places)
    low = _lower(plain)
    worded = _numbers(low) if _WORDED.search(low) else []
    if _AT_OR_DOT.search(plain):
        worded += _at_and_dot(plain)
    return found + _placed(worded + _secrets(plain, low), places)


def detect(text: str | None) -> tuple[list[Span], list[Span]]:
    """(exact spans, all spans): a disguised identifier counts unless one of its kind covers it; likewise secrets."""
    base = exact(text or "")
    every, reach = [], dict.fromkeys(ALL_KINDS, 0)
    for s, is_base in sorted([(s, True) for s in base] + [(s, False) for s in disguised(text or "")], key=lambda x: (x[0].start, -x[0].end, not x[1])):
        if is_base or s.end > reach[s.kind]:
            every.append(s)
        reach[s.kind] = max(reach[s.kind], s.end)
    return base, sorted(every, key=_order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (all by default) of every row, and the personal data of its whole text.

    n_email, n_ip, n_card, n_phone count exact identifiers; base_sha256 is the digest of their spans; spans
    has those, the disguised ones and secrets as kind:start:end, in code points, end exclusive; n_spans counts
    them. Null counts as empty, and empty texts have no spans. Every row is read by itself: repeated rows give
    the same result each, and an empty table gives an empty one. Whole texts are searched, in time that grows
    with their length. Columns called like a result are replaced.
    """

    def make() -> Callable[[list[list]], list[list]]:
        def work(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for text in columns[0]:
                base, every = detect(text)
                row = [sum(s.kind == k for s in base) for k in KINDS] + [hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return work

    return with_results(docs, [F.col(text_col)], docs.columns if keep is None else keep, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
