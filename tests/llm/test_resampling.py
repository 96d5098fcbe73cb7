import hashlib
import math
import random
import re
import zlib

from tallyflow.llm import oracles, resampling
from tallyflow.llm.registry import op12_resample
from tallyflow.llm.resampling import features, resample
from tests.oracle import assert_same, small


def words(text):
    return re.findall("[^\x00-/:-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text, sizes, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, sizes, buckets, percent, least):
    raw, good = [0] * buckets, [0] * buckets
    for counts, texts in ((raw, [t for _, t in rows]), (good, target)):
        for t in texts:
            for b in grams(t, sizes, buckets):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(good) + buckets)))) for s, t in zip(raw, good)]
    out = []
    for key, text in rows:
        f = grams(text, sizes, buckets)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([key, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = i
    return sorted(map(str, map(tuple, out)))


def texts(rng, n):
    return ["".join(rng.choice(["A", "b", "c9", "é", "中", "\x85"]) + rng.choice([" ", "-", "\n", "\x00"]) for _ in range(rng.randrange(70))) for _ in range(n)]


def test_sql(spark):
    assert_same(op12_resample(spark, small("sf0.01")), oracles.RESAMPLE, small("sf0.01"))


def test_runs_of_a_suffix_array():
    rng = random.Random(1)
    for sizes in ((1, 1), (1, 2), (2, 2), (1, 4), (3, 5)):
        for _ in range(40):
            some = [*texts(rng, rng.randrange(5)), "", "a a a a a a a a"]
            counts, found = features([None, *(t.encode() for t in some)], sizes, 1000)
            assert counts == [0, *(len(words(t)) for t in some)]
            assert [f.tolist() for f in found] == [[], *(grams(t, sizes, 1000) for t in some)]


def test_a_run_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda b: hashed.append(b) or 1)
    features([b"a b a b a b", b"b a b"], (1, 2), 10)
    assert sorted(hashed) == [b"a", b"a b", b"b", b"b a"]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(50)]), t) for t in texts(rng, 150)]
    rows += rows[:20] + [(7, None), (None, ""), (9, "x " * 5000)] + [(1, "same text " * 15)] * 30
    target = [*texts(rng, 9), None, ""]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, score string, row int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(resampling, "_SLICE", 400)
    for sizes, buckets, percent, least in (((1, 1), 10_000, 10, 20), ((1, 2), 100, 50, 1), ((2, 3), 70_000, 100, 0)):
        got = resample(docs, goal, sizes, buckets, percent, least)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
        assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, target, sizes, buckets, percent, least)
    kept = resample(docs, goal, keep=["row", "score", "text"])
    assert kept.columns == ["row", "text", "n_words", "n_features", "weight", "score", "rank"] and kept.count() == len(rows)


def test_nothing_there(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs).collect() == []
    assert resample(docs, none).first().weight == math.floor(1000 * math.log(10002 / (2 * 10000)))
    assert resample(docs, none, percent=100, least_words=2).first().rank == 1
