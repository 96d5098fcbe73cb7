import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tallyflow.llm import pieces
from tallyflow.llm.pieces import ChunkTable, decode, encode, has_borders
from tallyflow.llm.registry import op13_sentencepiece
from tests.oracle import small

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n):
    rng = random.Random(4)
    parts = [" ", "  ", "▁", "a", "é", "中", "\n", "\t", "\x00", "😀", "12", " the", "<s>", "<0x41>", "​", "　", "\xa0", "ﬁ", "́", "\U0010ffff", "Straße"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)] + ["", None, " ", "▁", "▁▁", " " * 70, "a ", " a", "中" * 3000, "ab" * 3000, "a b " * 3000]


def test_the_query(spark, library):
    docs = spark.read.parquet(f"{small('sf0.01')}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = set()
    for doc_id, text in docs:
        ids = library.encode(text or "")
        wanted.add((doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    assert {tuple(r) for r in op13_sentencepiece(spark, small("sf0.01")).collect()} == wanted


@pytest.mark.parametrize("most", [pieces._TABLE, 3000])
@pytest.mark.parametrize("borders", [True, False])
def test_chunks(library, most, borders):
    assert has_borders(MODEL)
    table, texts = ChunkTable(MODEL, most), odd_texts(3000)
    table.borders = borders
    for at in range(0, len(texts), 100):
        some = texts[at : at + 100]
        ids, counts, decoded = table.encode(some)
        wanted = [library.encode(t or "") for t in some]
        assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == [i for w in wanted for i in w]
        assert decoded == [library.decode(w) for w in wanted]


def test_a_chunk_is_segmented_once(library):
    table, seen = ChunkTable(MODEL), []
    class Counting:
        encode = staticmethod(lambda t: seen.append(t) or library.encode(t))
        decode, piece_to_id = library.decode, library.piece_to_id
    table.library = Counting
    for _ in range(3):
        table.encode(["to be or not to be", "not to  be"])
    assert sorted(seen) == ["be", "not", "or", "to", "▁be"]


def test_operator(spark, library):
    texts = odd_texts(50)
    df = spark.createDataFrame([(i, t, "x", i % 3) for i, t in enumerate([*texts, *texts])], "id long, text string, ids string, n_tokens int").repartition(3)
    got = encode(df, MODEL)
    assert got.columns == ["id", "text", "n_tokens", "ids", "decoded"]
    for r in got.collect():
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
    again = decode(got.drop("decoded"), MODEL, keep=["id", "text"])
    assert {(r.id, r.decoded) for r in again.collect()} == {(r.id, r.decoded) for r in got.collect()}
    assert encode(df.limit(0), MODEL, keep=["id"]).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([None, 450, 3, 259],), ([5, 260],)], "ids array<int>")
    assert [r.decoded for r in decode(odd, MODEL).collect()] == ["", "", library.decode([450, 3, 259]), library.decode([5, 260])]
