"""WARC records in ZIP archives: written by the tasks, read back by byte range without extraction.

Each task writes one archive to the shared folder: the stored member ``archive/data.warc.gz`` holds one
gzip member a record, the stored member ``indexes/index.cdxj`` their places. Readers parse the central
directory (ZIP64 too), take the index, and fetch blocks of neighbouring records by range, so that a large
archive is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm import zip_reader
from tallyflow.llm.common import marked
from tallyflow.sources.shared import is_small, new_path, removed_at_exit, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_BLOCK_BYTES, _TASK_BYTES = 1 << 20, 128 << 20
_BROADCAST_ROWS, _BROADCAST_BYTES = 100_000, 32 << 20  # payloads with copies, and bytes of their urls
_PART = 1_000  # copies of a payload that meet in a task
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(text: str) -> str:
    """Safe in a header line: control characters, spaces and % are percent-encoded."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c <= " " or c in "%\x7f" else c for c in text)


def _record_id(page_id: int | None, digest: str) -> str:
    """Made from the page's id and payload, so that a revisit knows it; any other where there is no id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record, gzipped by itself. A revisit has the payload's digest and length but not its bytes."""
    digest = payload_digest(payload)
    http = _HTTP % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id if refers_to is None else None, digest)}", f"WARC-Date: {_DATE}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_SAME_PAYLOAD}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_header_text(refers_url)}")
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of one gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def _write_task(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first = next(rows, None)
        if first is None:
            return
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        # Another attempt writes another file; only the paths of tasks that ended well reach the manifest.
        path = f"{top}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        index, at = [], 0
        with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            with archive.open(DATA, "w", force_zip64=True) as data:
                row: tuple | None = first
                while row is not None:
                    packed = record(*row)
                    data.write(packed)
                    index.append(f"{'-' if row[0] is None else row[0]} {json.dumps({'offset': at, 'length': len(packed)})}")
                    at += len(packed)
                    row = next(rows, None)
            with archive.open(INDEX, "w", force_zip64=True) as data:
                data.write("\n".join(index).encode())
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [at]})

    return write


def _beside_copies(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``rows`` with first_id and first_url of those whose key is among ``firsts``, for more of them than a broadcast takes.

    Only rows whose bit of a map of keys is on are shuffled. A payload with many copies is dealt into parts, to
    each of which its first one goes, so that the most frequent page is no single task's.
    """
    copies = firsts.agg(F.sum("copies")).first()[0] or 0
    # At most _BROADCAST_ROWS keys have more rows than a part: they are few enough to be everywhere.
    parts = F.ceil(F.col("copies") / max(_PART, -(-copies // _BROADCAST_ROWS)))
    keyed = firsts.withColumn("hash", F.xxhash64("key"))
    hot = keyed.where(parts > 1).select("hash", parts.alias("parts"))
    flagged = marked(rows.withColumn("hash", F.xxhash64("key")), "hash", keyed)
    alone = flagged.where("NOT marked").select(*rows.columns, F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"))
    hot = F.broadcast(written(hot.groupBy("hash").agg(F.max("parts").alias("parts")), "hot"))
    part = F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    dealt = flagged.where("marked").join(hot, "hash", "left").select(*rows.columns, part)
    each = keyed.join(hot, "hash", "left").select("key", "first_id", "first_url", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)).alias("part"))
    return dealt.join(each, ["key", "part"], "left").select(*rows.columns, "first_id", "first_url").unionByName(alone)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it; as Hadoop names them, where pyarrow has another name."""
    scheme, _, rest = folder.partition(":")
    if scheme == "dbfs":  # mounted on every machine
        folder = f"file:///dbfs/{rest.lstrip('/')}"
    elif scheme in {"s3a", "s3n"}:
        folder = f"s3:{rest}"
    elif scheme not in {"file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"} and not folder.startswith("/"):
        raise ValueError(f"archives can't be written to {folder!r}: spark.checkpoint.dir must be an absolute path or an address of file, hdfs, s3a, gs, abfs or dbfs")
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page; returns the manifest (path, records, bytes) of the archives.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the smallest id are responses
    and the others revisit it. Null html is an empty payload; null ids are never the smallest: they revisit
    when an id has the payload, and are responses otherwise; a null url leaves its header out. Rows that repeat
    an id and a payload share a record id. Payloads are shuffled only where too many have copies for a broadcast, and then only those
    that have (``_beside_copies``).
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    firsts = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("id").alias("first_id"), F.min_by("url", "id").alias("first_url"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1"))
    firsts = written(firsts, "copies")
    columns = ["id", "url", "payload", "first_id", "first_url"]
    if is_small(firsts, _BROADCAST_ROWS) and firsts.agg(F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0))).first()[0] <= _BROADCAST_BYTES:
        placed = rows.join(F.broadcast(firsts), "key", "left").select(columns)
    else:
        placed = _beside_copies(rows, firsts).select(columns)
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    told = placed.select("id", "url", "payload", refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_url"))
    return written(told.mapInArrow(_write_task(folder), "path string, records long, bytes long"), "manifest")


def _index_lines(f: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    """The lines of a stored index, read a part at a time."""
    end, rest = at + size, b""
    while at < end:
        part = f.read_at(min(_BLOCK_BYTES, end - at), at)
        at += len(part)
        *lines, rest = (rest + part).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _blocks(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def row(path: str, at: int, lengths: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [path], "at": [at], "lengths": [lengths]}, schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(path) as f:
                found = zip_reader.members(f, f.size())
                start = zip_reader.data_offset(f, found[DATA])
                at, size, lengths = start, 0, []
                for line in _index_lines(f, zip_reader.data_offset(f, found[INDEX]), found[INDEX].stored_bytes):
                    place = json.loads(line.partition(b" ")[2])
                    if size >= _BLOCK_BYTES:
                        yield row(path, at, lengths)
                        size, lengths = 0, []
                    at = at if lengths else start + place["offset"]
                    lengths.append(place["length"])
                    size += place["length"]
                if lengths:
                    yield row(path, at, lengths)

    return find


def _records(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for path, at, lengths in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            with store.open_input_file(path) as f:
                data, place, out = f.read_at(sum(lengths), at), 0, []
            for n in lengths:
                head, payload = parse_record(data[place : place + n])
                place += n
                told, stored = head["warc-payload-digest"].partition(":")[2], head["warc-type"] == "response"
                if stored and payload_digest(payload) != told:
                    raise zip_reader.BadArchive(f"the payload of a record in {path} doesn't have its digest")
                page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                out.append((page and int(page), int(head["x-payload-length"]), told, head["warc-type"], refers and int(refers), head.get("warc-target-uri"), payload if stored else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return read


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits)."""
    archives, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # The rows are a few numbers each but stand for megabytes: the numbers of tasks go by the archives' bytes.
    wide = manifest.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-total // _BLOCK_BYTES), max(2 * wide, total // _TASK_BYTES)))
    spread = manifest.select("path").repartition(max(1, min(archives, 4 * wide))).mapInArrow(_blocks(folder), "path string, at long, lengths array<long>")
    return spread.repartition(tasks).mapInArrow(
        _records(folder), "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: one row per page.

    Result for nulls and repeated ids as in ``write_archives``; ids are integers; an empty table gives no
    archive and an empty result; other columns of ``pages`` are not read.
    """
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, min_bytes)
    found = read_archives(manifest, removed_at_exit(pages.sparkSession, folder))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
