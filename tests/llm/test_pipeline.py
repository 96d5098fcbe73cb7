"""The pipeline against a brute-force version of its stages, and what each stage leaves alone."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyflow.llm import oracles
from tallyflow.llm.decontaminate import windows, words_of
from tallyflow.llm.jaccard_join import one_of_each
from tallyflow.llm.quality import features, train
from tests.llm.test_line_dedup import brute

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").lower().split(" ")
    w = [x for x in " ".join((text or "").replace("\n", " ").replace("\t", " ").split(" ")).split(" ") if x]
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest_of_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_root, b_root = find(a), find(b)
                up[max(a_root, b_root)] = min(a_root, b_root)
    return {i for i in ids if find(i) == i}


def occurs(text, patterns):
    w = words_of((text or "").encode())
    return any(tuple(w[i : i + n]) in patterns for n in {len(p) for p in patterns} for i in range(len(w) - n + 1))


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.select("doc_id", "text", "source").toPandas()
    score = model.score(np.array([features(None if t is None else t.encode()) for t in rows.text]))
    rows = rows[score >= 0.3].sort_values("doc_id").reset_index(drop=True)
    assert 0 < len(rows) < len(score)
    rows["text"] = brute(list(zip(rows.doc_id, rows.text, strict=True)), 2, 20)
    kept = smallest_of_components(list(zip(rows.doc_id, rows.text, strict=True)))
    rows = rows[rows.doc_id.isin(kept)]
    patterns = {p for t in pd.read_parquet(f"{SF}/benchmark.parquet").text for p in windows(t.encode(), 10)}
    rows = rows[[not occurs(t, patterns) for t in rows.text]]
    documents = rows  # noqa: F841  read by the SQL
    want = duckdb.sql(oracles.MIX).df().sort_values("doc_id").reset_index(drop=True)
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert len(want) > 20
    pd.testing.assert_frame_equal(got[["doc_id", "size", "source_size", "taken"]], want[["doc_id", "size", "source_size", "taken"]], check_dtype=False)
    assert np.allclose(got.target, want.target)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("contaminated", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.schema.simpleString() == before.schema.simpleString()
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert docs.where("score <> 'mine' OR contaminated <> 3").isEmpty()


def test_stages_with_nulls_and_repeated_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "A fine line of quite usual words that stands here, and it says nothing new. " * 3
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, None, "en", "b", None), (3, "", "en", None, 0), (None, text + "more of it", "en", "a", 7), (4, "word " * 60000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, schema).withColumn("score", F.lit("mine")).withColumn("own score", F.lit("too"))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).collect()
        ids = [r.doc_id for r in got]
        if name in ("line dedup", "decontamination", "mix sources"):
            assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
        if name != "mix sources":
            assert got == [] or {(r.score, r["own score"]) for r in got} == {("mine", "too")}
        if name == "near copies":
            assert sorted(map(str, ids)) in (["1", "2", "3", "4", "None"], ["1", "2", "3", "4", "None", "None"])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert stage(spark, docs, SF).count() == 0


def test_one_of_each(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near = text + " more"
    rows = [(3, text, 1), (2, near, 2), (2, "quite another text of more than five words", 3), (None, near, 4), (5, None, 5), (5, None, 6), (6, "", 7), (2, near, 8), (None, "words that are only here and there", 9), (None, "words that are only here and there", 9)]
    got = sorted(r.size for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string, size int")).collect())
    assert got in ([2, 3, 5, 6, 7, 9], [3, 5, 6, 7, 8, 9])
