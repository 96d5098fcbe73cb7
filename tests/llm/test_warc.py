import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import oracles, warc, zip_reader
from tallyflow.llm.registry import op3_warc_zip
from tests.oracle import assert_same, small


def test_sql(spark):
    assert_same(op3_warc_zip(spark, small("sf0.01")), oracles.WARC, small("sf0.01"))


def test_edges(spark):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (None, "u", "same"), (None, "u", "alone"), (7, "u", None), (2, "u", ""), (4, "u", "é" * 100000), (3, "v", "same"), (8, "u", "A\r\n\r\nB")]
    rows += [(100 + i, "u", "hot") for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int").repartition(5)
    folder = warc.new_path(spark, "warc")
    found = warc.read_archives(warc.write_archives(df, folder), folder).collect()
    by = {(r.id, r.url, r.payload): (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found}
    assert len(found) == len(rows)
    same = warc.payload_digest(b"same")
    assert by[5, "http://a/%0D%0AX:%20y", None] == ("revisit", 3, 4, same)
    assert by[3, None, b"same"] == ("response", None, 4, same) == by[3, "v", b"same"]
    assert by[None, "u", None] == ("revisit", 3, 4, same)
    assert by[None, "u", b"alone"][:2] == ("response", None)
    assert by[7, "u", None][:3] == ("revisit", 2, 0) and by[2, "u", b""][:3] == ("response", None, 0)
    assert by[4, "u", ("é" * 100000).encode()][2] == 200000 and (8, "u", b"A\r\n\r\nB") in by
    assert sum(r.refers_to == 100 for r in found) == 499
    large = {r.record_type for r in warc.read_archives(warc.write_archives(df, folder + "x", 5), folder + "x").collect() if r.payload_bytes < 5}
    assert large == {"response"}


def test_revisits_refer_to_the_response():
    first, payload = warc.parse_record(warc.record(3, "http://a/ b", b"x", None))
    again, nothing = warc.parse_record(warc.record(5, "http://c", b"x", 3, "http://a/ b"))
    assert payload == b"x" and nothing == b""
    assert again["warc-refers-to"] == first["warc-record-id"] and again["warc-record-id"] != first["warc-record-id"]
    assert again["warc-refers-to-target-uri"] == first["warc-target-uri"] == "http://a/%20b" and again["warc-refers-to-date"] == first["warc-date"]


def test_index_in_parts(spark, monkeypatch):
    f = pa.BufferReader(b"xx" + b"\n".join(b"%d {}" % i for i in range(1000)) + b"yy")
    monkeypatch.setattr(warc, "_BLOCK_BYTES", 7)
    size = f.size() - 4
    assert list(warc._index_lines(f, 2, size)) == [b"%d {}" % i for i in range(1000)] and list(warc._index_lines(f, 2, 0)) == []


@pytest.mark.parametrize("part", [1_000, 7])
def test_more_copies_than_a_broadcast_takes(spark, monkeypatch, part):
    rows = [(i if i % 11 else None, f"u{i % 5}" if i % 7 else None, "" if i % 3 == 0 else f"p{i % 40}" if i % 3 == 1 else f"alone {i}") for i in range(300)]
    pages = spark.createDataFrame([*rows, (900, "u", None)], "page_id long, url string, html string").repartition(6)
    whole = lambda folder: sorted(map(str, warc.read_archives(warc.write_archives(pages, folder), folder).drop("payload").collect()))
    want = whole(warc.new_path(spark, "warc"))
    monkeypatch.setattr(warc, "_BROADCAST_BYTES", 0)
    monkeypatch.setattr(warc, "_PART", part)
    assert whole(warc.new_path(spark, "warc")) == want
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    firsts = rows.groupBy("key").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    told = warc._beside_copies(rows.withColumnRenamed("page_id", "id"), firsts)
    assert told.count() == 301 and told.where("payload = cast('' AS binary)").select("first_id").distinct().collect() == [(3,)]


def test_places_of_archives():
    assert warc._store("file:/tmp/x")[1] == "/tmp/x" == warc._store("/tmp/x")[1] and warc._store("dbfs:/tmp/x")[1] == "/dbfs/tmp/x"
    for bad in ("checkpoints/x", "wasb://c@h/x"):
        with pytest.raises(ValueError, match="absolute"):
            warc._store(bad)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("limit", [None, 10])
def test_directories(monkeypatch, limit):
    if limit:  # the writer then uses ZIP64 for every size and place
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(f"m{i}/é", bytes([65 + i]) * (50 * i), zipfile.ZIP_DEFLATED if i == 4 else zipfile.ZIP_STORED)
        z.comment = b"PK remark"
    found = zip_reader.members(raw, len(raw.getvalue()))
    assert list(found) == [f"m{i}/é" for i in range(5)]
    for i in range(4):
        m = found[f"m{i}/é"]
        at = zip_reader.data_offset(raw, m)
        assert raw.getvalue()[at : at + m.stored_bytes] == bytes([65 + i]) * (50 * i)
    with pytest.raises(zip_reader.BadArchive):
        zip_reader.data_offset(raw, found["m4/é"])
    cut = raw.getvalue()[:-40]
    with pytest.raises(zip_reader.BadArchive):
        zip_reader.members(io.BytesIO(cut), len(cut))
