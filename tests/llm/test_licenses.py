import random
import re
import time

import pytest

from tallyflow.llm.licenses import CC_PARTS, NOTICES, PHRASES, TAGS, Scanner, families, license_scan
from tallyflow.llm.registry import ORACLE_SQL, QUERIES, op7_license_scan
from tests.oracle import assert_same, small


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(s, label) for p, label in PHRASES.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
    starts = [s for s, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(spark):
    docs = spark.read.parquet(f"{small('sf0.01')}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = op7_license_scan(spark, small("sf0.01")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert bool(r.labels) == (r.score > 0)
    assert {"mit", "apache-2.0", "gpl", "reserved", "cc-by,cc-by-nc"} <= {r.labels for r in got}


def test_base_against_sql(spark):
    assert_same(QUERIES["license_base"](spark, small("sf0.01")), ORACLE_SQL["license_base"], small("sf0.01"))


def test_bounded_errors():
    _, base, fuzzy = Scanner().scan("é All  rigts reserved, x. CC-BY cc by cc by".encode())
    assert [(m.label, m.first_word, m.last_word, m.edits) for m in fuzzy] == [("reserved", 1, 3, 1)]
    assert [m.first_word for m in base] == [5, 7, 9]
    for text in ("Licenced under teh Apache License", "mozila public licence", "released  under the MIT licence", "Permision is hereby granted, free of charge, to any person obtaining copy"):
        assert len({m.label for m in Scanner().scan(text.encode())[2]}) == 1, text
    for text in ("all lights observed", "the mist license plate", "general audience", "mozilla is public", "rights", "allrights reservedly"):
        assert not Scanner().scan(text.encode())[2], text


def test_every_notice_of_an_area():
    def fuzzy(text):
        return [(m.label, m.first_word, m.last_word, m.edits) for m in Scanner().scan(text.encode())[2]]

    assert fuzzy("all rigts reserved x all rights reserved") == [("reserved", 0, 2, 1), ("reserved", 4, 6, 0)]
    assert fuzzy("all rigts reserved all rights reserved all rihts reserved") == [("reserved", 0, 2, 1), ("reserved", 3, 5, 0), ("reserved", 6, 8, 1)]
    assert fuzzy("x all right\U00020000s reserved y") == [("reserved", 1, 3, 1)]
    assert fuzzy("all rights reserved\U00020000\U00020000") == []
    assert len(fuzzy("all rigts reserved " * 300)) == 300


CATALOGUE = {
    "The MIT License (MIT)": "mit", "BSD 3-Clause License": "bsd-3-clause", 'Simplified BSD 2-Clause License': "bsd-2-clause", "ISC License": "isc", "Boost Software License - Version 1.0": "bsl",
    "Eclipse Public License 2.0": "epl", "SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    'THE SOFTWARE IS PROVIDED "AS IS"': "no-warranty", "licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa", "licenced under CC BY-ND": "cc-by-nd",
    "Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa", "Creative Commons Attribution-NonCommercial-NoDerivatives": "cc-by-nc-nd", "Mozilla Public License Version 2.0": "mpl",
    "GNU GPL v3": "gpl", "GPLv2": "gpl", "released under the LGPLv2.1": "lgpl", "AGPL-3.0": "agpl", "Apache 2.0 licensed": "apache-2.0", "Business Source License 1.1": "busl", "The Unlicense": "unlicense",
    "CC BY-NC-SA 4.0": "cc-by-nc-sa", "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by-nc-sa", "SPDX-License-Identifier: BUSL-1.1": "busl", "Creative Commons BY-NC-ND": "cc-by-nc-nd", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "GNU Lesser General Public License": "lgpl", "GNU Affero General Public License": "agpl", "Apache License, Version 2.0": "apache-2.0", "This is free and unencumbered software": "unlicense",
}


@pytest.mark.parametrize("text", CATALOGUE)
def test_catalogue(text):
    _, _, fuzzy = Scanner().scan(f"Foo 1 -- {text}, bar.".encode())
    assert {m.label for m in fuzzy} == {CATALOGUE[text]}


def test_no_name_is_taken_for_another():
    wanted = {f"CC-{p.replace(' ', '-')}-4.0": f"cc-{p.lower().replace(' ', '-')}" for p in CC_PARTS} | {f"{g}-{v}": g.lower() for g in ("GPL", "LGPL", "AGPL") for v in ("2.0-only", "3.0-or-later")}
    tags = wanted | {t.replace(" ", "-"): label for t, label in TAGS.items()}
    scanner = Scanner()
    for tag, label in tags.items():
        for text in (f"x SPDX-License-Identifier: {tag} x", f"# SPDX-License-Identifier: {tag}\n# SPDX-FileCopyrightText: 2020"):
            assert {m.label for m in scanner.scan(text.encode())[2]} == {label}, text
    for one, first in tags.items():  # behind each other
        for two, second in tags.items():
            got = [m.label for m in scanner.scan(f"SPDX-License-Identifier: {one} x SPDX-License-Identifier: {two}".encode())[2]]
            assert got == [first, second], (one, two)
    for name, label in wanted.items():
        assert {m.label for m in scanner.scan(f"under {name}, see".encode())[2]} == {label} - {"cc-by"}, name
    made = families()
    for notice, label in (made | NOTICES).items():
        found = {m.label for m in scanner.scan(f"é {notice} é".encode())[2]}
        assert found == {label}, notice
    assert not scanner.scan(b"gplus lgplx apache 20 mit unlicensed CC BX cc by")[2]


def test_telling_words():
    for text in ("the NIT license", "licensed under the cache license", "BSD 4 clause license", "licensed under CC BX", "SPDX-License-Identifier: MTI", "is license", "disc license"):
        assert not Scanner().scan(text.encode())[2], text


def distances(notice, words):
    """Edits of the best span of whole words that begins at each word, telling words exact; by plain dynamic programming."""
    telling, text, k = [w.lower() for w in notice.split() if w.upper() == w], notice.lower(), int(len(notice) * 0.1)
    best = None
    for i in range(len(words)):
        row, said = list(range(len(text) + 1)), ""
        for j in range(i, len(words)):
            for c in (" " if said else "") + words[j]:
                last, row = row, [row[0] + 1]
                for x in range(1, len(text) + 1):
                    row.append(min(last[x] + 1, row[x - 1] + 1, last[x - 1] + (text[x - 1] != c)))
                said += c
            if min(row) > k:
                break
            if row[-1] <= k and telling_stand(telling, words[i : j + 1]):
                best = row[-1] if best is None else min(best, row[-1])
    return best


def telling_stand(telling, words):
    it = iter(words)
    return all(t in it for t in telling)


def test_notices_against_dynamic_programming():
    r = random.Random(4)
    scanner = Scanner()
    found = 0
    for n in range(250):
        words = []
        for _ in range(3):
            words += [r.choice(["the", "license", "public", "cc", "by", "a", "2", "0", "é", "software"]) for _ in range(r.randrange(3))]
            said = list(r.choice(list(NOTICES)).lower())
            for _ in range(r.randrange(5)):
                at = r.randrange(len(said) + 1)
                said[at : at + r.randrange(2)] = r.choice(["", "x", "é", " "])
            words += "".join(said).split()
        got = {}
        for notice, place in scanner.notices_in((" " + " ".join(words) + " ").encode()):
            got[notice.text] = min(got.get(notice.text, 99), place.edits)
        for notice in NOTICES:
            want = distances(notice, words)
            assert got.get(notice.lower()) == want, (notice, words)
            found += want is not None
    assert found > 300


def test_many_matches_in_one_text():
    began = time.perf_counter()
    for text in ("All rights reserved ", "all rigts reserved ", "mit license ", "the software is provided as is "):
        n, _, fuzzy = Scanner().scan((text * 20000).encode())
        assert len(fuzzy) == 20000 and fuzzy[-1].last_word == n - 1
    assert time.perf_counter() - began < 60


def test_edges(spark):
    long = "word " * 200000 + "All rights reserved"
    rows = [(1, None), (2, ""), (None, "cc by"), (4, long), (4, long), (5, "All rights reserved " * 500)]
    got = license_scan(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, score int").coalesce(1)).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in got] == [
        (1, 0, 0, None, None, ""), (2, 0, 0, None, None, ""), (None, 2, 1, 0, 0, "cc-by"), (4, 200003, 1, 200000, 200000, "reserved"),
        (4, 200003, 1, 200000, 200000, "reserved"), (5, 1500, 500, 0, 1497, "reserved")]
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
