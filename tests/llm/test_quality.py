import math
import zlib

import numpy as np

from tallyflow.llm.quality import FEATURES, features, fit, quality, train
from tallyflow.llm.registry import op10_quality
from tests.oracle import small


def test_held_out_accuracy(spark):
    sf = small("sf0.1")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality(spark, sf).collect()
    assert len(rows) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    pairs = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    ones, zeros = [s for y, s, _ in pairs if y], [s for y, s, _ in pairs if not y]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones])
    accuracy = np.mean([y == p for y, _, p in pairs])
    print("auc", auc, "accuracy", accuracy, "of", len(pairs), "recall of 1", np.mean([p for y, _, p in pairs if y]))
    assert auc > 0.9 and accuracy > 0.9


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.createDataFrame([(i, "fine words here " * (1 + i % 5) if i % 3 else "### !!! ###" * (1 + i % 4), "s") for i in range(300)], "doc_id long, text string, score string")
    labels = [(i, int(i % 3 > 0)) for i in range(300)]
    lies = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    same = [sorted(map(tuple, quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (labels, lies)]
    assert same[0] == same[1] and all((r[3] == 1) == (r[0] % 3 > 0) for r in same[0])


def test_interactions():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y, n_pairs=1)
    assert list(model.pairs) == [(0, 1)] and np.mean((model.score(x) > 0.5) == y) > 0.97
    by_hand = model.intercept + sum(t[np.searchsorted(e, x[7, f], side="right")] for f, (t, e) in enumerate(zip(model.tables, model.edges, strict=True)))
    assert abs(by_hand + model.pairs[0, 1][tuple(np.searchsorted(model.coarse[f], x[7, f], side="right") for f in (0, 1))] - model.margin(x)[7]) < 1e-12


def test_whole_table_against_a_plain_sum_of_the_tables(spark):
    """Every score is the intercept and one entry of each table, looked up here one by one."""
    sf = small("sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op10_quality(spark, sf).collect()
    assert len(got) == len(texts) and len(model.pairs) > 0
    for r in got:
        x = features(None if texts[r.doc_id] is None else texts[r.doc_id].encode())
        total = model.intercept
        for f, table in enumerate(model.tables):
            total += table[sum(edge <= x[f] for edge in model.edges[f])]
        for (f, g), table in model.pairs.items():
            total += table[sum(edge <= x[f] for edge in model.coarse[f]), sum(edge <= x[g] for edge in model.coarse[g])]
        score = 1 / (1 + math.exp(-max(-30, min(30, total))))
        assert abs(r.score - score) < 1e-9 and (abs(score - 0.3) < 1e-9 or r.predicted == (score >= 0.3))


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "word " * 200000), (4, "word " * 200000), (5, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (99, 1)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert quality(docs.limit(0), labels.limit(0)).count() == 0
    assert {len(features(t)) for t in (None, b"", b" ", b"x")} == {len(FEATURES)}
