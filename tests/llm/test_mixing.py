from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import oracles
from tallyflow.llm.mixing import draw, mix
from tallyflow.llm.registry import op2_mix_sources
from tests.oracle import assert_same, small


def test_sql(spark):
    assert_same(op2_mix_sources(spark, small("sf0.01")), oracles.MIX, small("sf0.01"))


def brute_targets(size, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, goal, open_ = share * sum(size.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * size[s]}
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            goal[s] = cap * size[s]
            left -= goal[s]
        open_ -= over
    return goal


def test_water_filling_and_edges(spark):
    rows = [(i, "w " * (i % 40), ["b", "a", None, "c"][i % 4 if i % 9 else 1]) for i in range(400)]
    rows += [(None, "x y", "a"), (7, None, "a"), (7, "k\x0bl", "empty"), (8, "", "none")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    goal, by = brute_targets(size), defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.target, r.source_size].append(r.taken)
    for s, n in size.items():
        (key,) = {k for k in by if k[1] == n and k[0] == pytest.approx(goal[s])}
        assert abs(sum(by[key]) - goal[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mix(df.repartition(9)).collect()))


def test_documents_are_taken_whole(spark):
    by = defaultdict(list)
    for r in op2_mix_sources(spark, small("sf0.01")).collect():
        by[r.target, r.source_size].append(r)
    below = 0
    for (target, size), rows in by.items():
        parts = [r.part_words for r in rows if 0 < r.part_words < r.size]
        assert len(parts) <= 1 and abs(sum(r.taken for r in rows) - target) <= 1
        below += target < size
        if target < size:
            assert all(r.repeats == 0 for r in rows) and 0 < sum(r.taken == r.size > 0 for r in rows) < len(rows)
    assert below > 2


def test_rows_without_an_id_draw_apart(spark):
    docs = spark.createDataFrame([(None, f"{'w ' * (i % 30)}{i}", "a" if i % 3 else "b") for i in range(2000)] + [(None, None, "a"), (None, "", "a"), (5, "x", "a"), (5, "y", "a")],
                                 "doc_id long, text string, source string")
    drawn = docs.select("doc_id", "text", draw(F.col("doc_id"), F.col("text"), 7).alias("draw")).collect()
    assert len({r.draw for r in drawn if r.doc_id is None and r.text}) == 2000 and len({r.draw for r in drawn if not r.text}) == 1
    assert len({r.draw for r in drawn if r.doc_id == 5}) == 1 and all(0 <= r.draw < 1 << 32 for r in drawn)
    got = mix(docs).collect()
    assert len(got) == 2004 and sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(9)).collect()))


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"host{i % 700:03d}") for i in range(3000)]
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    goal, got = brute_targets(size), defaultdict(int)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for r in mix(docs).collect():
        got[rows[r.doc_id][2]] += r.taken
        assert r.target == pytest.approx(goal[rows[r.doc_id][2]])
    assert all(abs(got[s] - goal[s]) <= 1.001 for s in size)
    other = {r.doc_id: r.taken for r in mix(docs, seed=8).collect()}
    assert any(other[r.doc_id] != r.taken for r in mix(docs).collect())


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
