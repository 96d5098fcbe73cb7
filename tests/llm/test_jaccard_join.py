import random
import re
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tallyflow.llm import jaccard_join, oracles
from tallyflow.llm.components import components
from tallyflow.llm.jaccard_join import RTree, chunk_links, jaccard_components, overlaps, points_of
from tallyflow.llm.registry import op8_jaccard_join
from tallyflow.llm.shingles import shingle_sets
from tallyflow.sources import shared
from tests.oracle import assert_same, small


def test_sql(spark):
    assert_same(op8_jaccard_join(spark, small("sf0.01")), oracles.JACCARD, small("sf0.01"))


def sets_of(texts):
    out = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split("[ \t-\r]+", w) if x]
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 75 * len(sets[i] | sets[k]):
                up[find(i)] = find(k)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def texts(seed, families=12, copies=25):
    """Families of edited copies, edits of edits, and texts that share a passage."""
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    passage, out = say(60), []
    for f in range(families):
        base = say(r.choice([3, 8, 40, 90, 150]))
        for _ in range(copies):
            w = list(base if r.random() < 0.7 else out[-1].split() if out else base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = r.choice(["x", "Y", "é", "z9"])
            out.append(" ".join(w))
    out += [" ".join(say(r.randrange(1, 40)) + passage + say(r.randrange(1, 40))) for _ in range(60)]
    return out


@pytest.mark.parametrize(("chunk", "hot", "many"), [(400_000, 50_000, 1000), (700, 50_000, 3), (700, 5, 1000), (5000, 4, 3)])
def test_against_brute_force(spark, monkeypatch, chunk, hot, many):
    monkeypatch.setattr(jaccard_join, "_CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "_HOT", hot)
    monkeypatch.setattr(jaccard_join, "_MANY", many)
    monkeypatch.setattr(jaccard_join, "_HEAVY", 4)
    rows = list(enumerate(texts(chunk)))
    random.Random(1).shuffle(rows)
    rows += [(None, ""), (9000, None), (9001, "  "), (9002, "a b"), (9003, "A\tb"), (None, "a  b"), (3, rows[0][1]), (3, rows[0][1]), (None, "q r s"), (9004, "a b c"), (9005, "t " * 30000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string").repartition(5)
    got = jaccard_components(df).collect()
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 100
    assert sorted((tuple(r) for r in got), key=str) == want


def templated(seed, n, common):
    """Texts of a template of ``common`` words and 25 words of their own; some are edited copies of others, some are parts of the template."""
    r = random.Random(seed)
    template, out = [f"t{i}" for i in range(common)], []
    for i in range(n):
        own = [f"u{r.randrange(10**6)}" for _ in range(25)]
        if i % 5 == 1:
            own = out[-1].split()[-25:]
            own[r.randrange(25)] = "edited"
        w = template + own
        if i % 7 == 3:
            w = w[: r.randrange(common // 2, len(w))]
        if i % 11 == 4:
            w = w + [f"v{k % 3} {i % 2}" for k in range(r.randrange(30))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("common", "n", "chunk", "depth"), [(78, 120, 1500, 4), (100, 120, 1500, 1), (78, 120, 1500, 0), (78, 450, 22_000, 4), (100, 450, 28_000, 0)])
def test_texts_that_share_a_template(spark, monkeypatch, common, n, chunk, depth):
    """In the larger ones a chunk has more members than search it without finding anything."""
    monkeypatch.setattr(jaccard_join, "_CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "_DEPTH", depth)
    monkeypatch.setattr(jaccard_join, "_HEAVY", 4)
    rows = list(enumerate(templated(common, n, common)))
    random.Random(2).shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(want) - 20
    assert sorted((tuple(r) for r in got), key=str) == want


def edited(seed, n, length=100):
    """Copies of one text with 0 to 8 words left out, so that many have the same shingles besides the text's own, and parts of it."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    out = []
    for i in range(n):
        gone = set(r.sample(range(length), r.randrange(9)))
        w = [x for k, x in enumerate(base) if k not in gone]
        out.append(" ".join(w[: r.randrange(length // 2, length)] if i % 9 == 5 else w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_with_edits_are_copied_to_few_cells(spark, monkeypatch, seed):
    """What is left of a large cell of edited copies shares shingles with very many others."""
    monkeypatch.setattr(jaccard_join, "_CHUNK", 8000)
    monkeypatch.setattr(jaccard_join, "_HEAVY", 4)
    monkeypatch.setattr(jaccard_join, "_PAIRED", 50, raising=False)
    placed = []

    def counting(df, kind, *more):
        out = shared.written(df, kind, *more)
        placed.extend([out.count()] if kind == "places" else [])
        return out

    monkeypatch.setattr(jaccard_join, "written", counting)
    rows = list(enumerate(edited(seed, 500)))
    random.Random(seed).shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < len(want) - 200
    assert sorted((tuple(r) for r in got), key=str) == want
    assert len(placed) > 1 and sum(placed) < 40 * len(rows), placed


@pytest.mark.parametrize(("paired", "copy", "make"), [(0, 0, "templated"), (0, 10**9, "templated"), (0, 200, "templated"), (0, 0, "edited"), (0, 10**9, "edited"), (10, 200, "edited")])
def test_what_large_cells_have_left(spark, monkeypatch, paired, copy, make):
    """Left sets meet all of their cell, or in smaller cells, or each cell as it costs less: the same links."""
    monkeypatch.setattr(jaccard_join, "_CHUNK", 1500)
    monkeypatch.setattr(jaccard_join, "_HEAVY", 4)
    monkeypatch.setattr(jaccard_join, "_PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "_COPY", copy)
    monkeypatch.setattr(jaccard_join, "_DEPTH", 2)
    rows = list(enumerate(templated(7, 120, 78) if make == "templated" else edited(7, 150)))
    random.Random(4).shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_what_is_outside_the_pivot():
    """Every linked pair shares a token of its ranges of sizes, or both are open there."""
    sets = [np.sort(s) for s in shingle_sets([t.encode() for t in templated(5, 150, 90)])]
    batch = pa.RecordBatch.from_pydict({"of": [1] * 150, "chunk": [0] * 150, "part": [0] * 150, "cell": [7] * 150, "role": [0] + [1] * 149, "chunks": [2] * 150, "node": list(range(150)), "shingles": [s.tobytes() for s in sets]})
    heavy = SimpleNamespace(value=np.zeros(0, np.uint64))
    told = [r for b in jaccard_join._outside(heavy, False)(iter([batch])) for r in b.to_pylist()]
    tokens, opens = defaultdict(set), set()
    for r in told:
        tokens[r["node"], r["own"], r["other"]].add(r["token"])
        if r["open"]:
            opens.add((r["node"], r["own"], r["other"]))
    own, linked, met = {r["node"]: r["own"] for r in told}, 0, 0
    for i in range(1, 150):
        for k in range(1, i):
            if 7 * len(np.intersect1d(sets[i], sets[k])) >= 3 * (len(sets[i]) + len(sets[k])):
                a, b = (i, own[i], own[k]), (k, own[k], own[i])
                assert (tokens[a] & tokens[b]) - {None} or {a, b} <= opens
                linked += 1
            elif i in own and k in own:
                met += bool((tokens[i, own[i], own[k]] & tokens[k, own[k], own[i]]) - {None})
    assert linked > 20 and met < linked


def test_classes_of_sets_that_link():
    for n in [*range(1, 3000), 10**6, 10**9 + 7]:
        at, most = (np.searchsorted(jaccard_join._CLASSES, m, "right") for m in (n, 4 * n // 3))
        assert at <= most <= at + 1


def test_chunk_of_many_cells():
    r = np.random.default_rng(3)
    sets, cells = [], []
    for _ in range(40):
        base = np.unique(r.integers(0, 2**64, r.integers(20, 60), dtype=np.uint64))
        first = len(sets)
        for _ in range(r.integers(2, 7)):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) < 0.93], r.integers(0, 2**64, 2, dtype=np.uint64)])))
        cells.append(list(range(first, len(sets))))
    found, known = chunk_links(sets, cells, [], len(sets))
    for members in cells:
        for i in members:
            for k in members:
                if 7 * len(np.intersect1d(sets[i], sets[k])) >= 3 * (len(sets[i]) + len(sets[k])):
                    assert known.find(i) == known.find(k)
    assert found and all(7 * len(np.intersect1d(sets[i], sets[k])) >= 3 * (len(sets[i]) + len(sets[k])) for i, k in found)


def test_bound_never_loses_a_pair():
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(300) < r.uniform(0.5, 1)], r.integers(0, 2**64, r.integers(1, 60), dtype=np.uint64)])) for _ in range(200)]
    sizes, points = np.array([*map(len, sets)]), points_of(sets)
    tree = RTree(points, sizes)
    for i in range(0, 200, 7):
        exact = {k for k in range(200) if 7 * overlaps(sets[i], [sets[k]])[0] >= 3 * (sizes[i] + sizes[k])}
        found = set(tree.search(points[i], sizes[i]).tolist())
        assert exact <= found and len(found) < 200
    assert overlaps(sets[0], sets[:3]).tolist() == [len(np.intersect1d(sets[0], s)) for s in sets[:3]]


def test_shingle_sets_match_words():
    t = texts(9, 4, 10) + [None, "", "a", "A b C d", "a b c d e", "É é É é É é", " \x0b a\x1cb  c d e f g "]
    for one, other in zip(sets_of(t), shingle_sets([x and x.encode() for x in t]), strict=True):
        assert len(one) == len(other)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and got[0] != got[1000] and len(got) == 501


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
