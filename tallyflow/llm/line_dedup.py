"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines within ``edits`` edits of each other: if one is cut into edits + 1 segments, at least one of them
stands unchanged in the other, near the same place. So every line gives index keys (its length, a segment's
number and text) and probe keys (for each length it may meet, the substrings at the places where that
length's segments can stand). Lines that share a key are verified by a banded bit-parallel edit distance.

A segment may stand in very many lines, such as an opening that all lines of a log have. Lines of such a key are
cut finer instead: of p segments all but ``edits`` stand unchanged, so a key of p - edits segments in their places
will do, and it goes beyond what the lines have in common. What the finest cut leaves in large groups is compared
in blocks, over many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations, product
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import marked
from tallyflow.sources.shared import hinted, written

_HOT = 1000  # rows of a key beyond which its lines are cut finer
_CHOICES = 100  # kinds of index keys of a line, at most, in a cut after the first finer one
_BLOCK = 2000  # rows of a block of what is still in large groups
_SAMPLED, _SAMPLE_HOT = 64, 32  # one in so many lines shows which keys are hot from the start, by so many rows


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _common(a: Column, b: Column, most: Column, part: Callable[[Column, Column], Column]) -> Column:
    """Length of the longest equal ``part`` (left or right end) of two texts, up to ``most``, by bisection."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(most + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return _let(middle, lambda m: F.when(part(a, m) == part(b, m), F.struct(m.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (m - 1).alias("high"))))

    start = F.struct(F.lit(0).alias("low"), most.cast("int").alias("high"))
    return F.aggregate(rounds, start, lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s), lambda s: s["low"])


def _banded(a: Column, b: Column, m: Column, n: Column, k: int) -> Column:
    """Edit distance of two arrays of characters whose lengths differ by at most ``k``; right up to ``k``.

    Bit i of a word stands for row j - k + i of column j: the band of width 2k + 1 slides down the diagonal.
    The words hold where the distance grows or falls from a row to the next; a column takes one addition
    and a few logical operations. The distance is followed along the band's last diagonal until that
    reaches the last row, then along that row.
    """
    ones = (1 << (2 * k + 1)) - 1

    def step(s: Column, j: Column) -> Column:
        same = sum((F.when(F.coalesce(F.get(a, j - k + i - 1) == F.get(b, j - 1), F.lit(False)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(2 * k + 1)), F.lit(0).cast("long"))
        vp, vn = s["vp"], s["vn"]
        free = _let(same, lambda x: (((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn)).bitwiseAND(F.lit(ones).cast("long")))

        def after(d: Column) -> Column:
            up = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)).bitwiseAND(F.lit(ones).cast("long")))

            def moved(h: Column) -> Column:
                down, aside = d.bitwiseAND(vp), F.shiftright(d, 1)
                row = m - j + k  # the last row's bit
                bit = lambda word, at: word.bitwiseAND(F.lit(1 << at).cast("long")) != 0
                along = sum((F.when(row == i, F.when(bit(h, i), 1).when(bit(down, i), -1).otherwise(0)).otherwise(0) for i in range(2 * k)), F.lit(0))
                return F.struct(down.bitwiseOR(F.bitwise_not(aside.bitwiseOR(h)).bitwiseAND(F.lit(ones).cast("long"))).alias("vp"), aside.bitwiseAND(h).alias("vn"),
                                (s["score"] + F.when(row >= 2 * k, F.when(bit(d, 2 * k), 0).otherwise(1)).otherwise(along)).alias("score"))

            return _let(up, moved)

        return _let(free, after)

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(k)).cast("int").alias("score"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["score"])


def edit_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two texts in code points where it is at most ``k``, else some larger number.

    What both begin and end with in common is set aside first; only the rest goes through the band.
    """
    la, lb = F.length(a), F.length(b)

    def rest(p: Column) -> Column:
        def inner(s: Column) -> Column:
            m, n = (la - p - s).cast("int"), (lb - p - s).cast("int")
            chars = lambda x, size: F.split(F.substring(x, p + 1, size), "")
            return F.when((m == 0) | (n == 0), F.greatest(m, n)).otherwise(_let(F.struct(chars(a, m).alias("a"), chars(b, n).alias("b")), lambda w: _banded(w["a"], w["b"], m, n, k)))

        return _let(_common(a, b, F.least(la, lb) - p, F.right), inner)

    return F.when(F.abs(la - lb) > k, F.lit(k + 1)).otherwise(_let(_common(a, b, F.least(la, lb), F.left), rest))


def _keys(edits: int) -> tuple[list[Column], list[Column]]:
    """(index keys, probe keys) of columns ``line`` and ``n``, its length; of equal lengths the unmoved places are index keys already."""

    def key(shorter: int, i: int, moved: int) -> Column:
        start, end = (F.expr(f"cast((n - {shorter}) * {at} div {edits + 1} as int)") for at in (i, i + 1))
        made = F.xxhash64(F.col("n") - shorter, F.lit(i), F.substring("line", start + (moved + 1), end - start))
        return F.when((start + moved >= 0) & (end + moved <= F.col("n")), made)

    index = [key(0, i, 0) for i in range(edits + 1)]
    # A place is needed only if the edits before it can have moved the segment there and those after it can undo the rest.
    probe = [key(shorter, i, moved) for shorter in range(edits + 1) for i in range(edits + 1) for moved in range(-edits, edits + 1)
             if abs(moved) <= i and abs(moved - shorter) <= edits - i and (shorter or moved)]
    return index, probe


def _fine_specs(edits: int, pieces: int) -> list[tuple[int, int, bool, list[tuple[int, int, int]]]]:
    """(length that the line has more, number of the choice, whether it is an index key, runs of kept segments as first, end and shift)."""
    specs = []
    for number, out in enumerate(combinations(range(pieces), edits)):
        ends = [(a + 1, b) for a, b in zip((-1, *out), (*out, pieces), strict=True)]
        seen = set()
        for moves in product(range(-edits, edits + 1), repeat=edits):  # what each segment left out adds to the length
            more = sum(moves)
            if more < 0 or sum(map(abs, moves)) > edits:
                continue
            runs = tuple((a, b, sum(moves[:i])) for i, (a, b) in enumerate(ends) if a < b)
            if (more, runs) not in seen:
                seen.add((more, runs))
                specs.append((more, number, not any(moves) or not (more or any(shift for _, _, shift in runs)), list(runs)))
    return specs


def _fine_keys(lines: DataFrame, edits: int, pieces: int) -> DataFrame:
    """(h, key, indexed) of ``lines`` (h, line): keys of all but ``edits`` of ``pieces`` segments."""
    made = [{"more": more, "number": number, "indexed": indexed, "runs": [{"a": a, "b": b, "shift": shift} for a, b, shift in runs]} for more, number, indexed, runs in _fine_specs(edits, pieces)]
    specs = F.from_json(F.lit(json.dumps(made)), "array<struct<more: int, number: int, indexed: boolean, runs: array<struct<a: int, b: int, shift: int>>>>")
    told = lines.select("h", "line", F.length("line").alias("n"), F.explode(specs).alias("s")).withColumn("m", F.expr("n - s.more"))
    start, end = f"(m * r.a) div {pieces} + r.shift", f"(m * r.b) div {pieces} + r.shift"
    fits = told.where(F.expr(f"m > 0 AND forall(s.runs, r -> {start} >= 0 AND {end} <= n)"))
    key = F.expr(f"aggregate(s.runs, xxhash64(m, s.number), (k, r) -> xxhash64(k, substring(line, cast({start} as int) + 1, cast({end} - ({start}) as int))))")
    return fits.select("h", key.alias("key"), "s.indexed").groupBy("h", "key").agg(F.max("indexed").alias("indexed"))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, line_no, line, h, g) of every line of at least ``min_chars``, spaces at its ends taken off; h and g are hashes."""
    told = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"))
    long = told.select("id", "row", "line_no", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")).where(F.length("line") >= min_chars)
    return long.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def _mark(line: Column) -> Column:
    """64 parities of the counts of hashed character pairs. An edit takes at most two pairs away and adds two."""

    def parities(chars: Column) -> Column:
        bits = F.transform(chars, lambda x, i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x, F.get(chars, i + 1)), F.lit(64))))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))

    return _let(F.split(line, ""), parities)


def _first_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(h, k) of ``lines`` (h, line): keys of one of edits + 1 segments; the last bit tells index keys from probe keys."""
    index, probe = _keys(edits)
    keys = [k.bitwiseOR(F.lit(1).cast("long")) for k in index] + [k.bitwiseAND(F.lit(-2).cast("long")) for k in probe]
    return lines.select("h", "line", F.length("line").cast("long").alias("n")).select("h", F.explode(F.array(*keys)).alias("k")).where("k IS NOT NULL")


def _grouped(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, key, indexed) to the rows whose key is of several lines, with their number: those of few, and those of more than ``_HOT``.

    The counts combine before the shuffle, and the rows of hot keys stay where they are.
    """
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.max("indexed").alias("any_index")).where("times > 1 AND any_index").drop("any_index")
    counts = written(counts, "counts")
    hot = hinted(counts.where(F.col("times") > _HOT))
    rest = keyed.join(hot.select("key"), "key", "left_anti").join(counts.where(F.col("times") <= _HOT), "key")
    return rest.select("h", "key", "indexed"), keyed.join(hot, "key")


def _linked(full: DataFrame, edits: int, also: list[str]) -> DataFrame:
    """(h, g) of the lines that have a near earlier one among those of their key (and of equal ``also``)."""
    later = full.select("key", *also, F.col("h").alias("x"), "g", F.col("line").alias("a"), F.col("first").alias("a_first"), F.col("mark").alias("a_mark"), F.col("indexed").alias("a_indexed"))
    earlier = full.select("key", *also, F.col("line").alias("b"), F.col("first").alias("b_first"), F.col("mark").alias("b_mark"), F.col("indexed").alias("b_indexed"))
    if also:  # a row meets every block as a later line, and stands in its own as an earlier one
        later = later.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        earlier = earlier.withColumn("other", F.col("own")).withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    same = later["key"] == earlier["key"]
    for c in ("own", "other") if also else ():
        same &= later[c] == earlier[c]
    linked = (same & (F.col("b_first") < F.col("a_first")) & (F.col("a_indexed") | F.col("b_indexed"))
              & (F.bit_count(F.col("a_mark").bitwiseXOR(F.col("b_mark"))) <= 4 * edits) & (edit_distance(F.col("a"), F.col("b"), edits) <= edits))
    return later.join(earlier, linked, "left_semi").select(F.col("x").alias("h"), "g").distinct()


def near_earlier(lines: DataFrame, firsts: DataFrame, sample: DataFrame, edits: int) -> DataFrame:
    """(h, g) of the distinct lines that have a line within ``edits`` edits whose first place comes before theirs.

    ``firsts`` has the first place and the number of occurrences (h, g, first, times) of every line, ``sample``
    some of the lines (h, line). One earlier line is enough, so the join is a semi join: a group of many lines
    near each other gives a row each, not their pairs, and the search for a line ends with the first that is
    found. The sample only tells which keys take the other way from the start; no key is left out.
    """
    told = marked(lines.select("h", "g", "line"), "h", firsts.where("times > 1").select("h"))
    once = told.where("NOT marked").select("h", "line").unionByName(told.where("marked").dropDuplicates(["h", "g"]).select("h", "line"))
    keyed = _first_keys(once, edits)
    often = written(_first_keys(sample.dropDuplicates(["h"]), edits).groupBy(F.expr("k & -2L").alias("key")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= _SAMPLE_HOT).select("key"), "often")
    hot_lines: list[DataFrame] = []
    if not often.isEmpty():
        known = hinted(often)
        hot_lines.append(keyed.join(known, F.expr("k & -2L") == known["key"], "left_semi").select("h").distinct())
        keyed = keyed.join(known, F.expr("k & -2L") == known["key"], "left_anti")
    # Most keys are of one line. The window keeps the rows of the others without making pairs.
    told = keyed.repartition(F.expr("k & -2L")).selectExpr("h", "k & -2L AS key", "(k & 1L) = 1 AS indexed").selectExpr(
        "h", "key", "indexed", "min(h) OVER (PARTITION BY key) AS least", "max(h) OVER (PARTITION BY key) AS most", "max(indexed) OVER (PARTITION BY key) AS any_index", "count(1) OVER (PARTITION BY key) AS times")
    active = written(told.where("least <> most AND any_index").groupBy("h", "key").agg(F.max("indexed").alias("indexed"), F.max("times").alias("times")), "keys")
    groups = [active.where(F.col("times") <= _HOT).select("h", "key", "indexed")]
    if not active.where(F.col("times") > _HOT).isEmpty():
        hot_lines.append(active.where(F.col("times") > _HOT).select("h"))
    large = None
    for pieces in (2 * (edits + 1), 4 * (edits + 1)):
        if not hot_lines or large is not None and comb(pieces, edits) > _CHOICES:
            break
        hot = written(hot_lines[0].unionByName(hot_lines[1]).distinct() if len(hot_lines) > 1 else hot_lines[0].distinct(), "hot-lines")
        finer = marked(lines.select("h", "line"), "h", hot).where("marked").select("h", "line").dropDuplicates(["h"]).join(hot, "h", "left_semi")
        few, large = _grouped(written(_fine_keys(finer, edits, pieces), "fine-keys"))
        groups.append(written(few, "keys"))
        large = written(large, "large")
        hot_lines = [] if large.isEmpty() else [large.select("h")]
    active = groups[0]
    for more in groups[1:]:
        active = active.unionByName(more)
    members = active.select("h") if large is None else active.select("h").unionByName(large.select("h"))
    texts = marked(lines.select("h", "g", "line"), "h", members).where("marked").select("h", "g", "line").dropDuplicates(["h", "g"])
    texts = written(texts.join(firsts.select("h", "g", "first"), ["h", "g"]).withColumn("mark", _mark(F.col("line"))), "lines")
    near = _linked(active.join(texts, "h"), edits, [])
    if large is None or large.isEmpty():
        return near
    blocks = F.ceil(F.col("times") / _BLOCK)
    return near.unionByName(_linked(large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks"))).join(texts, "h"), edits, ["blocks", "own"])).distinct()


def line_dedup(docs: DataFrame, edits: int = 2, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of every row, the text without repeated lines, and n_lines and n_dropped.

    Lines end at newlines; spaces at their ends don't count; lines of fewer than ``min_chars`` code points
    stay. A line goes when an equal line, or one within ``edits`` edits, comes before it: in a smaller id
    (null ids last), or earlier in the same text. The first of equal lines so stays unless a near line comes
    before. Rows that repeat an id are told apart by their texts; rows that repeat both are one. Null text
    stays null with no lines. Columns called n_lines or n_dropped are replaced. Lines are told apart by 128
    bits of two hashes, texts of one id by 64; near lines are verified by their characters. Very long
    texts are cut at their lines only; a very long line is compared whole. An empty table gives an empty one.
    """
    if edits < 1 or min_chars <= edits:
        raise ValueError("at least one edit, and lines longer than the edits")
    lines = _lines(docs, id_col, text_col, min_chars)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "line_no")
    occurring = written(lines.select("h", "g", place.alias("place"), F.when(F.pmod("h", F.lit(_SAMPLED)) == 0, F.col("line")).alias("line")), "occurring")
    firsts = written(occurring.groupBy("h", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")), "firsts")
    near = near_earlier(lines, firsts, occurring.where("line IS NOT NULL").select("h", "line"), edits).withColumn("near", F.lit(True))
    touched = written(firsts.join(near, ["h", "g"], "left").where("times > 1 OR near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")), "touched")
    gone = occurring.drop("line").join(touched, ["h", "g"]).where(F.col("near") | (F.col("place") > F.col("first")))
    dropped = gone.select("place.id", "place.row", "place.line_no").groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line_no").alias("_dropped"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = F.struct(*[F.col(f"`{c}`") for c in rest if c != text_col])
    texts = docs.select(others.alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    joined = texts.join(written(dropped, "dropped"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    all_lines = F.split("text", "\n")
    kept = _let(all_lines, lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_dropped")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in rest], F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"))
