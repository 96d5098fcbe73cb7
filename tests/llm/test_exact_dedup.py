import hashlib
import re

from tallyflow.llm import oracles
from tallyflow.llm.exact_dedup import exact_dedup
from tallyflow.llm.registry import op4_exact_dedup
from tests.oracle import assert_same, small


def brute(rows):
    norm = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        ids = [r[0] for r, m in zip(rows, norm, strict=True) if m == n]
        out.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_sql(spark):
    assert_same(op4_exact_dedup(spark, small("sf0.01")), oracles.EXACT_DEDUP, small("sf0.01"))


def test_edges(spark):
    long = "x y\t" * 30000
    rows = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (7, " "), (None, "a b"), (None, None), (1, long), (2, long.replace("\t", " ")), (3, "a\tb"), (11, "é"), (12, "É")]
    rows += [(100 + i, "hot text") for i in range(3000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, keep_id string").repartition(7)
    got = exact_dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    df = exact_dedup(spark.createDataFrame([], "doc_id long, text string"))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0
