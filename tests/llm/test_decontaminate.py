import random
import re

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import decontaminate, oracles
from tallyflow.llm.decontaminate import contamination
from tallyflow.llm.registry import op6_decontaminate
from tests.oracle import assert_same, small


def test_sql(spark):
    assert_same(op6_decontaminate(spark, small("sf0.01")), oracles.DECONTAMINATE, small("sf0.01"))


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, size):
    out = []
    for t in texts:
        w, hit, who = words(t), set(), set()
        for item, text in items:
            i = words(text)
            for p in {tuple(i[k : k + size]) for k in range(max(1, len(i) - size + 1))} if i else ():
                for s in range(len(w) - len(p) + 1):
                    if tuple(w[s : s + len(p)]) == p:
                        hit |= set(range(s, s + len(p)))
                        who |= {str(item)} - {"None"}
        out.append((len(w), len(hit), len(who), sorted(who), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1, 100_000])
def test_against_brute_force(spark, block):
    r = random.Random(3)
    vocabulary = ["a", "B", "c", "d'e", "é", "9"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 3, 4, 5, 9]))) for i in range(2, 9)] + [(10, "x y z"), (10, "q"), (None, "a"), (11, None), (12, "!?"), (13, "É Q")]
    texts = [say(r.randrange(40)) for _ in range(60)] + [None, "", "...", "X, y; Z", "q " * 3000, "É q é Q", say(5), say(5)]
    docs = spark.createDataFrame([(i if i % 7 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(docs.withColumn("k", F.monotonically_increasing_id()).coalesce(1), bench, window=4, block_windows=block).orderBy("k").collect()
    assert [(x.n_words, x.n_hit, x.n_items, x.item_ids, x.contaminated) for x in got] == brute(texts, items, 4)


def test_many_found_texts(spark, monkeypatch):
    found = op6_decontaminate(spark, small("sf0.01"))
    monkeypatch.setattr(decontaminate, "_FOUND", 0)
    assert sorted(map(tuple, op6_decontaminate(spark, small("sf0.01")).collect())) == sorted(map(tuple, found.collect()))


def test_one_block_at_a_time(spark, monkeypatch):
    sizes = []

    real = type(spark.sparkContext).broadcast
    alive = []

    def broadcast(self, value):
        made = real(self, value)
        sizes.append(len(value))
        alive.append(1)
        gone = made.destroy
        made.destroy = lambda *a: (alive.pop(), gone(*a))
        assert len(alive) == 1
        return made

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(500)))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(490, 900))), (2, "w1 w3")], "doc_id long, text string")
    assert [(x.doc_id, x.n_hit) for x in contamination(docs, bench, window=4, block_windows=100).orderBy("doc_id").collect()] == [(1, 10), (2, 0)]
    assert len(sizes) == 5 and sum(sizes) == 497 and not alive


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_texts_are_scanned_once_for_all_blocks(spark, monkeypatch, tmp_path, bits):
    """A small map lets more texts through, which changes nothing."""
    monkeypatch.setattr(decontaminate, "_MAP_BITS", bits)
    r, rows = random.Random(8), spark.sparkContext.accumulator(0)
    say = lambda n: " ".join(f"w{r.randrange(40)}" for _ in range(n))
    texts, items = [say(r.randrange(60)) for _ in range(80)] + [None, ""], [(i, say(r.choice([1, 2, 3, 4, 5, 12]))) for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    counted = F.udf(lambda t: rows.add(1) or t, "string").asNondeterministic()
    bench = spark.createDataFrame(items, "item_id long, text string")
    seen = {}
    for block in (100_000, 20, 5):
        before = rows.value
        docs = spark.read.parquet(str(tmp_path / "docs")).withColumn("text", counted("text"))
        got = contamination(docs, bench, window=4, block_windows=block).orderBy("doc_id").collect()
        assert [(x.n_words, x.n_hit, x.n_items, x.item_ids, x.contaminated) for x in got] == brute(texts, items, 4)
        seen[block] = rows.value - before
    assert seen[20] == seen[5] == seen[100_000]


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs, bench).count() == 0
    assert [x.n_hit for x in contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).collect()] == [0]
