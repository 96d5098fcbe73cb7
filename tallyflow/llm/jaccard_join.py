"""N-gram Jaccard join by count-vector R-trees.

The shingles of a set are dealt by hash into groups, and the counts of the groups are a point. For two sets
the sum of the coordinates' minima bounds their overlap from above, and for a box of points so does the sum of
minima with the box's upper corner: a search descends an R-tree of such boxes, and what survives is verified
exactly.

So that the trees fit into tasks, sets meet in cells. A pair of the wanted similarity shares some of the first
shingles, about a third of each set's, in any common order; the order here has those that many sets share last.
The sets of like size that share such a shingle go to one cell; a set with too few of them goes nowhere. Many cells
of like set size together make a chunk of bounded size, with one tree over all its sets; a large cell makes several
chunks. A cell's pivot searches the tree, then what isn't linked to the pivot does; pairs already connected are not
verified, as only the components matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.llm.components import components
from tallyflow.llm.shingles import digest, shingle_sets
from tallyflow.sources.shared import hinted, written

_COUNTED = 1 << 21  # shingles that are counted together
_HEAVY, _HEAVY_MOST = 64, 200_000
_HOT = 50_000  # sets of a token that are not brought together
_MANY = 1000  # members of a cell that are not brought together
_CHUNK = 400_000  # shingles of a chunk
_TRIES = 100  # searches of members of a large cell before it is asked whether they find something
_PAIRED = 1000  # sets left of a large cell that meet all of it
_COPY = 200  # comparisons that cost what a set's place in a smaller cell does, about
_DEPTH = 4  # times that large cells are made smaller
_STRETCH = 1 << 20
_BITS = 1 << 24
_ROWS = 256
_LEAF = 16

Batches = Iterator[pa.RecordBatch]


def _linked(overlap: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of at least 0.75: 100 * overlap >= 75 * union."""
    return 7 * overlap >= 3 * (a + b)


class RTree:
    """Points in boxes of ``_LEAF``, those in boxes again; a box has its upper corner and smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        # Packed by size, then in tiles by the first coordinates: sizes bound the most.
        slabs = np.argsort(sizes, kind="stable")
        wide = max(_LEAF, int(len(slabs) ** 0.5) // _LEAF * _LEAF)
        self.order = np.concatenate([s[np.lexsort(points[s].T[:3])] for s in (slabs[i : i + wide] for i in range(0, len(slabs), wide))])
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > _LEAF:
            corner, least = self.levels[-1]
            at = np.arange(0, len(corner), _LEAF)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(least, at)))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points whose bound doesn't rule a link out."""
        wanted = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            wanted = wanted[_linked(np.minimum(corner[wanted], point).sum(1, dtype=np.int64), size, least[wanted])]
            if depth:
                wanted = (wanted[:, None] * _LEAF + np.arange(_LEAF)).ravel()
                wanted = wanted[wanted < len(self.levels[depth - 1][0])]
        return self.order[wanted]


def points_of(sets: list[np.ndarray]) -> np.ndarray:
    """Count vectors; about four shingles a group, where the bound is sharp."""
    most = max(map(len, sets))
    groups = 1 << int(np.clip(np.ceil(np.log2(most / 4 + 1)), 4, 10))
    owner = np.repeat(np.arange(len(sets)), [*map(len, sets)])
    cell = owner * groups + (np.concatenate(sets) >> np.uint64(64 - int(groups).bit_length() + 1)).astype(np.int64)
    return np.bincount(cell, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others)])[:-1], dtype=np.int64)


class _Sets:
    """Union-find over a cell's sets."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, k: int) -> bool:
        i, k = self.find(i), self.find(k)
        self.up[max(i, k)] = min(i, k)
        return i != k


def chunk_links(sets: list[np.ndarray], cells: list[list[int]], probes: list[int], others: int, large: frozenset[int] = frozenset()) -> tuple[list[tuple[int, int]], _Sets]:
    """(links that connect what wasn't connected, union-find) of the sets of a chunk.

    The first ``others`` sets are in the tree. Of each cell the first set, its pivot, searches it, then every
    member that isn't connected with the pivot; ``probes`` search it in any case. No set searches twice. In one of the ``large``
    cells, whose sets meet again elsewhere, members stop searching when hardly any finds something.
    """
    found: list[tuple[int, int]] = []
    known = _Sets(len(sets))
    sizes = np.array([*map(len, sets)])
    points = points_of(sets)
    tree = RTree(points[:others], sizes[:others])
    done: set[int] = set()

    def search(i: int) -> None:
        if i in done:
            return
        done.add(i)
        mine = known.find(i)
        among = np.array([k for k in tree.search(points[i], sizes[i]).tolist() if known.find(k) != mine], np.int64)
        if len(among):
            good = _linked(overlaps(sets[i], [sets[k] for k in among]), sizes[i], sizes[among])
            for k in among[good].tolist():
                if known.join(i, k):
                    found.append((i, k))

    for number, (pivot, *members) in enumerate(cells):
        search(pivot)
        tried, hits = 0, 0
        for i in members:
            if known.find(i) != known.find(pivot):
                if number in large and tried >= _TRIES and 10 * hits < tried:
                    break
                before = len(found)
                search(i)
                tried, hits = tried + 1, hits + (len(found) > before)
    for i in probes:
        search(i)
    return found, known


def _texts(batches: Batches, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, list(shingle_sets(part.column(column).to_pylist()))


def _describe(batches: Batches) -> Batches:
    """Rows (id, size, node) of all texts, and (token, times) of shingles in several sets of a stretch."""
    seen: set[int] = set()
    stretch: list[np.ndarray] = []
    size = 0
    names = ["id", "size", "node", "token", "times"]

    def counted() -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(stretch), return_counts=True)
        tokens, times = tokens[times > 1].view(np.int64), times[times > 1]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), kind), none, none, pa.array(tokens), pa.array(times)], names=names)

    kind = pa.int64()
    for part, sets in _texts(batches, 1):
        kind = part.column(0).type
        nodes = [digest(s) if len(s) else None for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([*map(len, sets)], pa.int64()), pa.array(nodes, pa.int64()), none, none], names=names)
        for node, s in zip(nodes, sets, strict=True):
            if node is not None and node not in seen:
                seen.add(node)
                stretch.append(s)
                size += len(s)
        if size >= _COUNTED:
            yield counted()
            seen, stretch, size = set(), [], 0
    if stretch:
        yield counted()


def _prefixes(heavy: Broadcast, hot: Broadcast, only_hot: bool) -> Callable[[Batches], Batches]:
    """Rows (token, mark, node): the first shingles of each set in the common order, heavy ones last.

    Either those of the ``hot`` tokens or the others; the mark is the set's class or size, and its rank.

    Of n shingles the first n - 3n/4 + k, so that linked sets share at least the smaller k of theirs. Sets
    mostly of heavy shingles rank first: the text that a group of copies comes from names its cell.
    """

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        known = heavy.value
        for _, sets in _texts(batches, 0):
            tokens, nodes, marks, lengths = [], [], [], []
            for s in sets:
                node = digest(s) if len(s) else None
                if node is None or node in seen:
                    continue
                if len(seen) < _HEAVY_MOST:  # sets that come again from one task are only repeated rows
                    seen.add(node)
                is_heavy = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                first = np.concatenate([s[~is_heavy], s[is_heavy]])[: len(s) - _needed(len(s)) + _shared_least(len(s))]
                if only_hot or len(hot.value):
                    first = first[np.isin(first, hot.value) == only_hot]
                tokens.append(first)
                lengths.append(len(first))
                nodes.append(node)
                marks.append((int(np.searchsorted(_CLASSES, len(s), "right")) if only_hot else len(s)) << 8 | 100 - int(100 * is_heavy.mean()))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(marks, np.int64), lengths)), pa.array(np.repeat(np.array(nodes, np.int64), lengths))], names=["token", "mark", "node"])

    return run


def _classes() -> list[int]:
    """The smallest sizes of classes of sets; sets that may link are of one class or of neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(4 * out[-1] // 3 + 1)
    return out


_CLASSES = _classes()


def _needed(n: int) -> int:
    """The smallest set that a set of ``n`` can link with, and the least that they have in common: 3n/4, rounded up."""
    return (3 * n + 3) // 4


def _shared_least(n: int) -> int:
    return 1 + n // 16


def _cells(batches: Batches) -> Batches:
    """Rows sorted by token, size, rank and node, to rows (node, cell, shared).

    The sets that have a token in their prefixes fall apart where the next larger one is too large to link
    with the one before; two or more that stay together go to the cell named by the first in rank, and
    ``shared`` counts their tokens. A stretch longer than ``_STRETCH`` is named by its first part.
    """
    kept = [np.zeros(0, np.int64)] * 3
    name = None  # of a stretch of which a part is out already

    def rows(columns: list[np.ndarray], starts: np.ndarray) -> Batches:
        nonlocal name
        _, mark, node = columns
        sizes = np.diff([*starts, len(node)])
        part = np.repeat(np.arange(len(starts)), sizes)
        cells = node[np.lexsort((node, mark & 255, part))[starts]]
        together = sizes > 1
        if name is not None:
            cells[0], together[0], name = name, True, None
        use = together[part]
        if use.any():
            pairs, shared = np.unique(np.stack([node[use], cells[part[use]]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(shared)], names=["node", "cell", "shared"])

    for batch in batches:
        if not batch.num_rows:
            continue
        token, mark, node = (np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, batch.columns, strict=True))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])  # copies' rows are next to each other
        token, mark, node = token[new], mark[new], node[new]
        size = mark >> 8
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (3 * size[1:] > 4 * size[:-1])]))
        cut = int(starts[-1])
        if cut:
            yield from rows([token[:cut], mark[:cut], node[:cut]], starts[:-1])
        kept = [token[cut:], mark[cut:], node[cut:]]
        if len(kept[0]) > _STRETCH:
            part = [c[:-1] for c in kept]
            cell = name if name is not None else part[2][np.lexsort((part[2], part[1] & 255))[0]]
            name = cell
            yield from rows(part, np.array([0]))
            kept, name = [c[-1:] for c in kept], cell
    if len(kept[0]):
        yield from rows(kept, np.array([0]))


def _wanted_sets(bits: Broadcast) -> Callable[[Batches], Batches]:
    """Rows (node, shingles) of the sets whose bit is on."""

    def run(batches: Batches) -> Batches:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        seen: set[int] = set()
        for _, sets in _texts(batches, 0):
            rows = {}
            for s in sets:
                node = digest(s) if len(s) else None
                if node is not None and wanted[node % _BITS] and node not in seen:
                    rows[node] = s.tobytes()
                    if len(seen) < _HEAVY_MOST:
                        seen.add(node)
            if rows:
                yield pa.RecordBatch.from_pydict({"node": list(rows), "shingles": list(rows.values())}, pa.schema([("node", pa.int64()), ("shingles", pa.binary())]))

    return run


def _grouped(batches: Batches) -> Iterator[list[tuple]]:
    """The rest of rows sorted by their first three columns, as groups of those; one group at a time is in memory."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield rows


def _join_chunks(batches: Batches) -> Batches:
    """Groups of (cell, role, chunks, node, shingles) to rows (a, b, cell, alone).

    Roles: 0 the pivot of a cell, 1 a member, 2 a probe from another chunk. Links have a and b; in a cell of
    several chunks a member that isn't connected with the pivot gives a row with itself as a, and ``alone``.
    """
    for rows in _grouped(batches):
        roles = {r[1] for r in rows}
        probing = 2 in roles
        if roles in ({1}, {2}):  # another chunk's rest has nothing to meet here
            continue
        rows.sort(key=lambda r: (r[1] == 2, r[0], r[1], r[3]))  # probes behind all others; a cell's pivot first
        place: dict[int, int] = {}
        sets, cells, of_cell, others = [], [], {}, 0
        for cell, role, chunks, node, shingles in rows:
            if node not in place:
                place[node] = len(sets)
                sets.append(np.frombuffer(shingles, np.uint64))
                others += role < 2
            if role < 2 and not probing:
                if cell not in of_cell:
                    of_cell[cell] = chunks
                    cells.append([])
                cells[-1].append(place[node])
        large = frozenset(i for i, chunks in enumerate(of_cell.values()) if chunks > 1)
        found, known = chunk_links(sets, cells, [place[r[3]] for r in rows if r[1] == 2], others, large)
        nodes = list(place)
        alone = [(i, cell) for members, (cell, chunks) in zip(cells, of_cell.items(), strict=True) if chunks > 1 for i in members[1:] if known.find(i) != known.find(members[0])]
        a, b = [nodes[i] for i, _ in found] + [nodes[i] for i, _ in alone], [nodes[k] for _, k in found] + [None] * len(alone)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(found) + [c for _, c in alone], pa.int64()), pa.array([False] * len(found) + [True] * len(alone))], names=["a", "b", "cell", "alone"])


def _steps() -> np.ndarray:
    """The smallest sizes of ranges of sets, each a tenth larger than the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, 11 * out[-1] // 10))
    return np.array(out)


_STEPS = _steps()


def _range_of(size: int) -> int:
    return int(np.searchsorted(_STEPS, size, "right")) - 1


def _outside(heavy: Broadcast, all_open: bool) -> Callable[[Batches], Batches]:
    """Chunks of large cells to rows (cell, node, size, own, other, open, token) for each member but the pivot.

    For each range ``other`` of sizes that the member may link with: the first of its shingles that aren't the
    pivot's, so many that a linked set of that size has one of them; heavy ones are last. Where linked sets may have nothing
    in common outside the pivot the pair of ranges is ``open``, and all are given, for partners that need some.
    """

    def run(batches: Batches) -> Batches:
        known = heavy.value
        for rows in _grouped(batches):
            pivots = {cell: np.frombuffer(shingles, np.uint64) for cell, role, _, _, shingles in rows if role == 0}
            for cell, role, _, node, shingles in rows:
                if role == 0:
                    continue
                mine, pivot = np.frombuffer(shingles, np.uint64), pivots[cell]
                n = len(mine)
                inside = pivot[np.minimum(np.searchsorted(pivot, mine), len(pivot) - 1)] == mine
                rest, common = mine[~inside], int(inside.sum())
                is_heavy = known[np.minimum(np.searchsorted(known, rest), len(known) - 1)] == rest if len(known) else np.zeros(len(rest), bool)
                rest = np.concatenate([rest[~is_heavy], rest[is_heavy]]).view(np.int64)
                own, others, opens, tokens = _range_of(n), [], [], []
                for other in range(_range_of(_needed(n)), _range_of(4 * n // 3) + 1):
                    least, most = int(_STEPS[other]), int(_STEPS[other + 1]) - 1
                    outside = -(-3 * (n + max(least, _needed(n))) // 7) - min(common, most)
                    is_open = all_open or outside < 1
                    first = rest[: max(0, len(rest) - max(1, outside) + 1)] if not all_open else rest[:0]
                    others += [other] * (len(first) + is_open)
                    opens += [False] * len(first) + [True] * is_open
                    tokens += first.tolist() + [None] * is_open
                if others:
                    k = len(others)
                    yield pa.RecordBatch.from_arrays([pa.array([cell] * k), pa.array([node] * k), pa.array([n] * k), pa.array([own] * k, pa.int32()), pa.array(others, pa.int32()), pa.array(opens), pa.array(tokens, pa.int64())],
                                                     names=["cell", "node", "size", "own", "other", "open", "token"])

    return run


_LINKS = "a long, b long, cell long, alone boolean"


def _sets_of(text: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the ``nodes`` and some more, made again from the texts.

    The texts are not shuffled: a bit map of fixed size tells the tasks which sets are wanted.
    """
    spark = text.sparkSession
    bit = F.pmod("node", F.lit(_BITS))
    maps = nodes.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("page")).agg(F.bitmap_construct_agg(F.expr("bit % 32768")).alias("bits")).collect()
    bits = bytearray(_BITS // 8)
    for m in maps:  # at most _BITS / 32768 rows
        bits[m.page * 4096 : m.page * 4096 + 4096] = m.bits
    return text.mapInArrow(_wanted_sets(spark.sparkContext.broadcast(bytes(bits))), "node long, shingles binary").dropDuplicates(["node"])


_PLACE = ["of", "chunk", "part", "cell", "role", "chunks", "node"]


def _with_sets(sets: DataFrame, places: DataFrame) -> DataFrame:
    """The chunks of ``places`` (the columns of _PLACE), one behind another in a task, with their ``sets``."""
    key = _PLACE[:3]
    return places.select(_PLACE).join(sets, "node").select(*_PLACE, "shingles").repartition(*key).sortWithinPartitions(*key)


def _slice_of(node: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts)


def _hot_cells(text: DataFrame, heavy: Broadcast, hot: Broadcast) -> DataFrame:
    """(node, cell, shared) by the ``hot`` tokens, which may be in a third of all sets, without bringing a token's sets together.

    Sets are held with their class of size and the next. The first set in rank of a token and class, a minimum
    that combines before the shuffle, names the cell.
    """
    rows = written(text.mapInArrow(_prefixes(heavy, hot, True), "token long, mark long, node long"), "hot")
    kind = F.expr("mark div 256")
    held = rows.select("token", "node", F.expr("mark % 256").alias("rank"), F.explode(F.array(kind, kind + 1)).alias("class"))
    names = held.groupBy("token", "class").agg(F.min(F.struct("rank", "node")).alias("first"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    named = held.join(hinted(written(names.select("token", "class", F.col("first.node").alias("cell")), "names")), ["token", "class"])
    return named.groupBy("node", "cell").agg(F.count_distinct("token", "class").alias("shared"))


def jaccard_links(text: DataFrame, sets: DataFrame, heavy: list[tuple[int, int]]) -> DataFrame:
    """(a, b) links that connect all linked sets of ``text`` (one binary column); ``sets`` has (node, size).

    ``heavy`` has the tokens of many sets and how often they were counted; it orders, and routes the hot ones.
    """
    spark = text.sparkSession
    known = spark.sparkContext.broadcast(np.sort(np.array([t for t, _ in heavy], np.int64).view(np.uint64)))
    hot = spark.sparkContext.broadcast(np.array([t for t, n in heavy if n >= _HOT], np.int64).view(np.uint64))
    tokens = text.mapInArrow(_prefixes(known, hot, False), "token long, mark long, node long")
    runs = tokens.repartition("token").sortWithinPartitions("token", "mark", "node")
    pairs = runs.mapInArrow(_cells, "node long, cell long, shared long")
    if len(hot.value):
        pairs = pairs.unionByName(_hot_cells(text, known, hot))
    pairs = written(pairs.groupBy("node", "cell").agg(F.sum("shared").alias("shared")), "pairs")
    # A set that shares fewer tokens than any set it could link with must have in common links with none. Two
    # linked sets have that many in common; if either leaves the cells where it shares least, up to less than
    # half of that number, a cell is left where they meet.
    least = F.expr("1 + ((3 * size + 3) div 4) div 16")
    of_node = W.partitionBy("node")
    ranked = pairs.join(sets, "node").select("*", F.sum("shared").over(of_node).alias("all_shared"), F.sum("shared").over(of_node.orderBy("shared", "cell").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("up_to"))
    pairs = written(ranked.where((F.col("all_shared") >= least) & (F.col("up_to") > (least - 1) / 2)).select("node", "cell", "shared", "size"), "pairs")
    return _links_in_cells(text, None, pairs, known, 0)


def _links_in_cells(text: DataFrame, sets: DataFrame | None, pairs: DataFrame, heavy: Broadcast, depth: int) -> DataFrame:
    """(a, b) links that connect all linked sets that are in a cell of ``pairs`` (node, cell, shared, size) together.

    ``sets`` has those of all nodes of ``pairs``; without it they are made from the texts.
    """
    cells = pairs.groupBy("cell").agg(F.sum("size").alias("shingles"), F.max_by("node", F.struct("shared", "node")).alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    cells = cells.withColumn("chunks", F.ceil(F.col("shingles") / _CHUNK)).withColumn("class", F.when(F.col("chunks") == 1, F.floor(F.log2(F.col("shingles") / F.col("members")))))
    cells = written(cells, "cells")
    # Cells of one chunk share chunks with others of their class; there are at most some 60 classes.
    shared = cells.where("class IS NOT NULL").groupBy(F.col("class").alias("of_class")).agg(F.ceil(F.sum("shingles") / _CHUNK).alias("together"))
    cells = written(cells.join(F.broadcast(shared), F.col("class") == F.col("of_class"), "left").withColumn(
        "of", F.when(F.col("class").isNull(), F.col("cell")).otherwise(F.xxhash64("class", F.pmod(F.xxhash64("cell"), F.col("together"))))).select("cell", "of", "pivot", "chunks", "members"), "cells")
    # The rows of cells of many members don't go to one task each: there are few such cells.
    many, few = cells.where(F.col("members") > _MANY), cells.where(F.col("members") <= _MANY)
    of_many = hinted(many)
    rows = pairs.join(of_many, "cell").unionByName(pairs.join(of_many.select("cell"), "cell", "left_anti").join(few, "cell"))
    members = rows.where("node <> pivot").select("of", _slice_of(F.col("node"), F.col("chunks")).alias("chunk"), F.lit(0).alias("part"), "cell", F.lit(1).alias("role"), "chunks", "node", "size")
    pivots = cells.select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("part"), "cell", F.lit(0).alias("role"), "chunks", F.col("pivot").alias("node"), F.lit(0).cast("long").alias("size"))
    places = written(members.unionByName(pivots), "places")
    first = written(_with_sets(_sets_of(text, places) if sets is None else sets, places).mapInArrow(_join_chunks, _LINKS), "links")
    links = first.where("NOT alone").select("a", "b")
    alone = first.where("alone").select("cell", F.col("a").alias("node"))
    if alone.isEmpty():
        return links
    return links.unionByName(_rest(text, sets, places, written(alone, "alone"), heavy, depth))


def _rest(text: DataFrame, sets: DataFrame | None, places: DataFrame, alone: DataFrame, heavy: Broadcast, depth: int) -> DataFrame:
    """Links of the sets of large cells that aren't connected with their cell's pivot: ``alone`` (cell, node).

    Where few are left of a cell they meet all of it, chunk by chunk. Where many are left, they and the others first
    are dealt into smaller cells: what two sets have in common is inside the pivot or outside. Inside it is at most what
    either has in common with the pivot, so linked sets need so many common shingles outside, for which a prefix of those
    is enough: sets that share a template, and hardly more, don't meet again. Sets that do meet in smaller cells. Pairs of
    sizes at which sets may link within the pivot alone are compared chunk by chunk. Copies of one text that
    were edited at random share shingles outside the pivot with very many others each; a cell of such is compared chunk by
    chunk as a whole, which both copies and compares less than the smaller cells would.
    """
    # Only cells with such a set have anything left; they are large and few.
    apart = hinted(written(alone.groupBy("cell").agg(F.count(F.lit(1)).alias("apart")), "cells"))
    told = alone.withColumn("alone", F.lit(True))
    is_alone = F.coalesce("alone", F.lit(False)).alias("alone")
    large = written(places.where("chunks > 1").join(apart, "cell").join(told, ["cell", "node"], "left").select(*_PLACE, "size", "apart", is_alone), "large")
    if sets is None:
        sets = written(_sets_of(text, large), "large-sets")
    members = large.where("role = 1").select("cell", "node", "size", "alone", "apart")
    whole = [members.where(F.col("apart") <= _PAIRED)]
    many = large.where(F.col("apart") > _PAIRED)
    links, met = [], []
    if not many.isEmpty():
        outside = _with_sets(sets, many).mapInArrow(_outside(heavy, depth >= _DEPTH), "cell long, node long, size long, own int, other int, open boolean, token long")
        outside = written(outside.join(told, ["cell", "node"], "left").withColumn("alone", is_alone), "outside")
        key = ["cell", "low", "high", "token"]
        held = outside.where("token IS NOT NULL").select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "token", "node", "size", "alone")
        groups = held.groupBy(*key).agg(F.min("node").alias("first"), F.max("alone").alias("any"), F.count(F.lit(1)).alias("sets")).where("any AND sets > 1").select(*key, "first")
        smaller = held.join(groups, key).groupBy(F.col("cell").alias("large"), "node", F.xxhash64("cell", "low", "high", "first").alias("cell")).agg(F.count(F.lit(1)).alias("shared"), F.first("size").alias("size"))
        smaller = written(smaller, "pairs")
        inside = outside.where("open").select("cell", "node", "size", "own", "other", "alone").distinct()
        meets = inside.where("alone").select("cell", F.col("own").alias("other"), F.col("other").alias("own")).distinct()
        targets = inside.join(meets, ["cell", "own", "other"]).select(F.xxhash64("cell", "own", "other").alias("of"), "cell", "node", "size", F.lit(1).alias("role"))
        probes = inside.where("alone").select(F.xxhash64("cell", "other", "own").alias("of"), "cell", "node", "size", F.lit(2).alias("role"))
        ranges = written(targets.unionByName(probes), "targets")
        # What either way has to copy, in shingles, and to compare, of each cell.
        dealt = smaller.groupBy(F.col("large").alias("cell")).agg(F.sum("size").alias("shingles"), (_COPY * F.count(F.lit(1))).alias("work"))
        opened = _meetings(ranges).groupBy("cell").agg(F.sum("shingles").alias("shingles"), F.sum("work").alias("work"))
        costs = dealt.unionByName(opened).groupBy("cell").agg(F.sum("shingles").alias("other_shingles"), F.sum("work").alias("other_work"))
        dear = _meetings(_all_of(members.where(F.col("apart") > _PAIRED))).join(costs, "cell").where("shingles <= other_shingles AND work <= other_work").select("cell")
        dear = hinted(written(dear, "cells"))
        whole.append(members.join(dear, "cell", "left_semi"))
        met.append(ranges.join(dear, "cell", "left_anti"))
        smaller = written(smaller.join(dear, smaller["large"] == dear["cell"], "left_anti").drop("large"), "pairs")
        if not smaller.isEmpty():
            links.append(_links_in_cells(text, sets, smaller, heavy, depth + 1))
    meeting = written(reduce(DataFrame.unionByName, [*met, *map(_all_of, whole)]), "targets")
    if not meeting.isEmpty():
        parts = hinted(written(_meetings(meeting).select("of", "chunks", "parts"), "parts"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        dealt = meeting.join(parts, "of")
        targets = dealt.where("role = 1").withColumn("chunk", _slice_of(F.col("node"), F.col("chunks"))).select("*", every("parts").alias("part")).select(_PLACE)
        probes = dealt.where("role = 2").withColumn("part", _slice_of(F.col("node"), F.col("parts"))).select("*", every("chunks").alias("chunk")).select(_PLACE)
        more = written(targets.unionByName(probes), "places")
        links.append(written(_with_sets(sets, more).mapInArrow(_join_chunks, _LINKS), "links").select("a", "b"))
    none = text.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.unionByName, links, none)


def _all_of(members: DataFrame) -> DataFrame:
    """Rows (of, cell, node, size, role): all ``members`` of a cell are targets, those that are alone are probes too."""
    of = F.xxhash64("cell").alias("of")
    targets = members.select(of, "cell", "node", "size", F.lit(1).alias("role"))
    return targets.unionByName(members.where("alone").select(of, "cell", "node", "size", F.lit(2).alias("role")))


def _meetings(rows: DataFrame) -> DataFrame:
    """(of, cell, chunks, parts, shingles, work): into how many chunks of targets and parts of probes each ``of`` falls, and what
    it costs that each part meets each chunk: shingles copied, sets compared."""
    n = {role: F.sum((F.col("role") == role).cast("long")) for role in (1, 2)}
    size = {role: F.sum(F.when(F.col("role") == role, F.col("size")).otherwise(0)) for role in (1, 2)}
    told = rows.groupBy("of", "cell").agg(n[1].alias("targets"), n[2].alias("probes"), size[1].alias("held"), size[2].alias("asked")).where("targets > 0 AND probes > 0")
    told = told.withColumn("chunks", F.ceil(F.col("held") / _CHUNK)).withColumn("parts", F.ceil(F.col("asked") / _CHUNK))
    return told.select("of", "cell", "chunks", "parts", F.expr("held * parts + asked * chunks").alias("shingles"), F.expr("targets * probes").alias("work"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Two rows link when their sets of five-word shingles have a Jaccard similarity of at least 0.75; a
    component's id is the smallest id of its rows. Rows with equal sets are of one component and are joined
    as one. Null and texts without words have no shingles, link with nothing, and keep their own id; null
    ids are never the smallest. Sets and shingles are told apart by 64-bit hashes. Every row is joined: no
    group is capped, and the broadcasts (heavy shingles, which only order and route; a bit map) have fixed
    bounds. A very long text is one set, however many shingles it has. Other columns are not read. An empty
    table gives an empty one.
    """
    found = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def _components(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, size, component_id); ids of any type that has an order."""
    kind = docs.schema["id"].dataType.simpleString()
    text = docs.select("text")
    told = written(docs.mapInArrow(_describe, f"id {kind}, size long, node long, token long, times long"), "sets")
    rows = told.where("token IS NULL").select("id", "size", "node")
    heavy = told.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= _HEAVY).orderBy(F.desc("times"), "token").limit(_HEAVY_MOST)
    sets = rows.where("node IS NOT NULL").groupBy("node").agg(F.max("size").alias("size"), F.min("id").alias("first_id"))
    links = jaccard_links(text, sets.select("node", "size"), [(r.token, r.times) for r in heavy.collect()])
    roots = components(links)
    labelled = sets.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    labels = labelled.join(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    labels = written(labels, "labels")
    return rows.join(labels, "node", "left").select("id", "size", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay when one row of each component stays: that of the smallest id.

    Null ids come last. Rows that repeat an id are told apart by their texts, and of rows that repeat both any
    one stays. Rows without words are linked with nothing, and all stay. An empty table gives an empty one.
    """
    row = F.xxhash64(F.col(text_col))
    ident = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), row.alias("row"))
    found = _components(docs.select(ident.alias("id"), F.col(text_col).cast("binary").alias("text")))
    firsts = found.where(F.col("id") == F.col("component_id")).groupBy(F.col("id.id").alias("_id"), F.col("id.row").alias("_row")).agg((F.max("size") > 0).alias("_words"), F.count(F.lit(1)).alias("_times"))
    firsts = written(firsts.select("_id", "_row", (F.col("_words") & (F.col("_times") > 1)).alias("_repeated")), "kept")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), row.alias("row"))
    kept = rows.join(firsts, rows["id"].eqNullSafe(F.col("_id")) & (rows["row"] == F.col("_row")))
    if not firsts.where("_repeated").isEmpty():
        kept = kept.where("NOT _repeated").unionByName(kept.where("_repeated").dropDuplicates(["_id", "_row"]))
    return kept.select("doc.*")
