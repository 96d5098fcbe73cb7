import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyflow.llm import line_dedup as line_dedup_module
from tallyflow.llm import oracles
from tallyflow.llm.line_dedup import _fine_specs, edit_distance, line_dedup
from tallyflow.llm.registry import op5_line_dedup
from tests.oracle import assert_same, small


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    small = ["".join(p) for n in range(5) for p in product("ab", repeat=n)]
    pairs = list(product(small, small))
    r = random.Random(k)
    for _ in range(1500):
        a = [r.choice("abcé\U0001f600 ") for _ in range(r.randrange(1, 60))]
        b = list(a)
        for _ in range(r.randrange(0, k + 3)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = r.choice(["", "x", "a", "é"])
        pairs.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").coalesce(4).select("a", "b", edit_distance(F.col("a"), F.col("b"), k).alias("d")).collect()
    for x in got:
        want = levenshtein(x.a, x.b)
        assert x.d == want if want <= k else x.d > k, (x, want)


def brute(rows, edits, least):
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    lines = [(order(i) + (n,), x.strip(" \t\r\x0b\x0c"), i, n) for i, (_, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n"))]
    lines = sorted(x for x in lines if len(x[1]) >= least)
    gone, seen = set(), []
    for _, text, i, n in lines:
        if any(abs(len(s) - len(text)) <= edits and levenshtein(s, text) <= edits for s in seen):
            gone.add((i, n))
        seen.append(text)
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("edits", "hot", "block", "sampled"), [(1, 1000, 2000, 64), (2, 1000, 2000, 64), (2, 3, 2, 10**9), (2, 2, 2, 2)])
def test_against_brute_force(spark, monkeypatch, edits, hot, block, sampled):
    for name, value in (("_HOT", hot), ("_BLOCK", block), ("_SAMPLED", sampled), ("_SAMPLE_HOT", 3 if sampled < 10 else 32)):
        monkeypatch.setattr(line_dedup_module, name, value)
    r = random.Random(edits)
    base = ["".join(r.choice("abcde f") for _ in range(r.randrange(6, 26))).strip() or "x" for _ in range(12)]

    def line():
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = r.choice(["", "z", "é"])
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(r.randrange(1, 6)))) for i in r.sample(range(1000), 70)]
    rows += [(None, rows[0][1]), (2000, None), (2001, ""), (2002, "\n\n"), (2003, "  " + base[0] + "a word more\t\r\nshort\n" + base[0] + "a word more")]
    df = spark.createDataFrame([(i, t, 5, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_lines int, k int").repartition(4)
    got = {x.k: x for x in line_dedup(df, edits, 8).collect()}
    assert [got[k].text for k in range(len(rows))] == brute(rows, edits, 8)
    assert all(got[k].n_lines - got[k].n_dropped == (len(got[k].text.split("\n")) if got[k].text or got[k].n_lines > got[k].n_dropped else 0) for k, (_, t) in enumerate(rows) if t is not None)


@pytest.mark.parametrize(("edits", "pieces"), [(1, 4), (2, 6), (2, 12)])
def test_fine_keys_meet(edits, pieces):
    """Lines within ``edits`` edits share a fine key, made here as in the docstring."""
    specs, r = _fine_specs(edits, pieces), random.Random(pieces)

    def keys(line, indexed):
        out = set()
        for more, number, is_index, runs in specs:
            m = len(line) - more
            places = [(m * a // pieces + shift, m * b // pieces + shift) for a, b, shift in runs]
            if is_index >= indexed and m > 0 and all(a >= 0 and b <= len(line) for a, b in places):
                out.add((m, number, *(line[a:b] for a, b in places)))
        return out

    for _ in range(800):
        x = "".join(r.choice("abc") for _ in range(r.randrange(20, 45)))
        y = list(x)
        for _ in range(r.randrange(1, edits + 1)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = r.choice(["", "x", "a"])
        short, long = sorted((x, "".join(y)), key=len)
        assert keys(short, True) & keys(long, False), (x, y)


def test_common_openings_and_templates(spark):
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    lines = [f"2024-01-01 INFO server started request {say(20)}" for _ in range(2500)]
    lines += [f"{say(10)} the template of very many lines {say(10)} ends" for _ in range(2500)]
    near = [x[:-3] + "##" + x[-2:] for x in r.sample(lines, 50)]
    rows = list(enumerate(lines + near))
    got = {x.doc_id: x.text for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(got[i] == t for i, t in rows[:5000]) and all(got[i] == "" for i, _ in rows[5000:])


def test_sql(spark):
    assert_same(op5_line_dedup(spark, small("sf0.01")), oracles.LINE_DEDUP, small("sf0.01"))


def test_repeated_rows_and_long_texts(spark):
    long = "\n".join(f"line number {i:06d} of many lines" for i in range(0, 3000 * 1111, 1111))
    passage = "this passage is well over twenty characters long"
    rows = [(1, passage), (1, passage), (1, "other\n" + passage), (2, passage + "\nstays"), (3, long), (4, "w" * 100000 + "\n" + passage), (5, "v" + "w" * 99999)]
    got = sorted(((x.doc_id, x.text) for x in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    ones = [t for i, t in got if i == 1]
    assert sorted(ones) in ([passage, passage, "other"], ["", "", "other\n" + passage])
    assert got[3] == (2, "stays") and got[5] == (4, "w" * 100000) and got[6] == (5, "")
    assert len(got[4][1].split("\n")) < 3000


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = line_dedup(docs).collect()
    source = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(source)
    seen = {}
    for i in sorted(source):
        for x in (source[i] or "").split("\n"):
            if len(x.strip(" \t\r\x0b\x0c")) >= 20:
                seen.setdefault(x.strip(" \t\r\x0b\x0c"), i)
    kept = [x.strip(" \t\r\x0b\x0c") for r in got for x in (r.text or "").split("\n")]
    kept = [x for x in kept if len(x) >= 20]
    assert len(kept) == len(set(kept)) and set(kept) <= set(seen)
    missing = set(seen) - set(kept)
    assert len(missing) < 20 and all(any(y != x and levenshtein(x, y) <= 2 for y in seen if abs(len(x) - len(y)) <= 2) for x in missing)


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
