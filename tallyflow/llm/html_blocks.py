"""HTML into blocks: runs of text between block-level tags, each with the path of tags it stands in."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from typing import NamedTuple

# Elements by how they are read.
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Scripts, styles, what a script copies, form input and the name of the page; a drawing's title is text.
SKIPPED_TAGS = frozenset("script style template textarea title".split())
RAW_TAGS = frozenset("xmp plaintext".split())
SPACING_TAGS = frozenset("br img wbr input".split())
# A start tag of the key ends the nearest open one of the values, unless a boundary stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"optgroup", "option"}}
BOUNDARIES = frozenset("ul ol menu dl table select html body article section div main aside nav header footer form".split())

#: Of deeper nesting a path has this many outermost and innermost steps; texts are whole all the same.
_STEPS = 32
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ENDS = {t: re.compile(rf"(?i)</{t}\b[^>]*+>") for t in SKIPPED_TAGS | RAW_TAGS}


_BOTH = ("a boundary", "a block")


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int  # code points inside links


def _marks(attributes: str) -> str:
    """The words of class, id and role as one string, in order; empty without them."""
    if "=" not in attributes:
        return ""
    words = []
    for m in _NAMES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        words += _NAME_PART.findall(_CAMEL.sub(" ", value).lower())
    return " ".join(words)


class _Reader:
    """Open tags, and for each name and kind of tag the places where it is open: no end tag is searched for."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, str]] = []  # tags with their marks
        self.places: dict[str, list[int]] = defaultdict(list)
        self.pieces: list[str] = []
        self.linked = 0
        self.block_path: tuple[str, ...] | None = None

    def last(self, *names: str) -> int:
        """The innermost place where one of the names (or kinds) is open, -1 if none is."""
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def text(self, raw: str, decode: bool = True) -> None:
        if not raw:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        if self.block_path is None and not text.isspace():
            outer = self.open if len(self.open) <= 2 * _STEPS else self.open[:_STEPS] + self.open[-_STEPS:]
            self.block_path = tuple(f"{t} {m}" if m else t for t, m in outer if t in BLOCK_TAGS or m)
        self.pieces.append(text)
        if self.places["a"]:
            self.linked += len(text)

    def cut(self) -> None:
        """Ends the block that is being read."""
        if self.block_path is not None:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(self.block_path, text, self.linked))
        self.pieces, self.linked, self.block_path = [], 0, None

    def pop_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            for name in (tag, *_kinds(tag)):
                self.places[name].pop()
        del self.open[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in SPACING_TAGS:
            self.pieces.append(" ")
        if tag in BLOCK_TAGS:
            self.cut()
            self.imply_ends(tag)
        if tag in VOID_TAGS:
            return
        for name in (tag, *_kinds(tag)):
            self.places[name].append(len(self.open))
        self.open.append((tag, _marks(attributes)))

    def imply_ends(self, tag: str) -> None:
        """Ends what the start of a block-level ``tag`` ends: an open paragraph, an earlier item or cell."""
        wanted = CLOSES.get(tag, ())
        at = self.last("p", *wanted)
        if at >= 0 and at > self.last("a boundary", *(() if wanted else ("td", "th", "li"))):
            self.pop_to(at)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        at = self.last(tag)
        if at >= 0 and (tag in BLOCK_TAGS or at > self.last("a block")):  # an inline end tag doesn't reach over a block
            self.pop_to(at)


def _kinds(tag: str) -> tuple[str, ...]:
    """Names, of no tag, under which a tag's place is kept besides."""
    return _BOTH if tag in BOUNDARIES and tag in BLOCK_TAGS else ("a boundary",) if tag in BOUNDARIES else ("a block",) if tag in BLOCK_TAGS else ()


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order: character references decoded, white space made single spaces, none empty.

    Comments, scripts, styles, templates, the input of forms and the title of the page are left out; formulas,
    drawings and what stands in for an object, a frame or a script are text like any other. Markup that is cut
    off or badly quoted never fails. Null gives no blocks. The time grows with the page's length.
    """
    page = page or ""
    r, at, n = _Reader(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.text(page[at:])
            break
        r.text(page[at:lt])
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            ending, after = ("-->", 4) if page.startswith("<!--", lt) else (">", 1)
            end = page.find(ending, lt + after)
            at = n if end < 0 else end + len(ending)
            continue
        m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if m is None:
            if follows.isalpha() or follows == "/" and page[lt + 2 : lt + 3].isalpha():
                break  # a tag that never ends
            r.text("<")
            at = lt + 1
            continue
        tag, at = m[2].lower(), m.end()
        if m[1]:
            r.end(tag)
        elif tag in SKIPPED_TAGS and not (tag == "title" and r.places["svg"]):
            if not m[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else n
        elif tag in RAW_TAGS:
            end = None if tag == "plaintext" else _ENDS[tag].search(page, at)
            r.cut()
            r.text(page[at : end.start() if end else n], decode=False)
            r.cut()
            at = end.end() if end else n
        else:
            r.start(tag, m[3])
    r.cut()
    return r.blocks
