import random
import re
from collections import Counter, defaultdict

from tallyflow.llm import oracles, phrases
from tallyflow.llm.phrases import collocations
from tallyflow.llm.registry import op11_phrases
from tests.oracle import assert_same, small

KIND = "lang string, text string, rank int, salt string"


def brute(rows, most=3, least=10, top=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in found.items():
            around = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if all(100 * b < inside * a for b in around):
                cut = min((1000000 * a * a // (count[g[:j]] * count[g[j:]]), j) for j in range(1, len(g)))
                kept.append((-cut[0], -a, " ".join(g).encode(), count[g[: cut[1]]], count[g[cut[1] :]]))
        out += [(lang, i, g.decode(), -a, x, y, n[lang], -s) for i, (s, a, g, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_sql(spark):
    assert_same(op11_phrases(spark, small("sf0.01")), oracles.PHRASES, small("sf0.01"))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["A", "b", "c", "é", "\x00", "\x85", " ", "中", "|", "\x1c"]
    ends = [" ", "  ", "\t", ". ", "\r", "\x0c", ":", " ,"]
    rows = [(rng.choice(["en", None, "und", ""]), "".join(rng.choice(words) + rng.choice(ends[: rng.choice([3, 8])]) for _ in range(rng.randrange(80)))) for _ in range(60)]
    rows += [("en", None), ("en", ""), ("en", " "), ("en", "..."), ("zz", "x")] + rows[:7] + [("de", "la la la " * 2000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], KIND)
    monkeypatch.setattr(phrases, "_SLICE", 500)
    for most, least, top, inside in ((3, 10, 2000, 50), (2, 1, 40, 50), (5, 3, 30, 80)):
        got = plain(collocations(df.repartition(3), most, least, top, inside))
        assert got == brute(rows, most, least, top, inside) and got


def test_counts_over_64_bits(spark):
    row = spark.createDataFrame([(3 * 10**14, [(4 * 10**14, 10**15), (10**15, 3 * 10**14)])], "n long, cuts array<struct<l: long, r: long>>").selectExpr(f"{phrases._LOWEST} AS cut").first().cut
    assert (row.score, row.l) == (1000000 * 9 * 10**28 // (4 * 10**29), 4 * 10**14)


def test_nothing_there(spark):
    for rows in ([], [("en", None)], [("en", "one two three")]):
        got = collocations(spark.createDataFrame([(*r, 1, "s") for r in rows], KIND))
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.collect() == []
