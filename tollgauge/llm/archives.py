"""WARC archives compressed record by record with a Zstandard dictionary that each archive brings along.

Every task cuts its pages into archives of about ``roll`` bytes. An archive's dictionary is built from all its records and stands in a
leading skippable frame (magic 0x184D2A5D); then each record is one Zstandard frame, so readers can start at any record. Files get
names that no other attempt of a task uses; only those in the manifest, which Spark takes from the successful attempt of each task, belong to
the archive set. Files go to a folder that all executors share.

Payloads of at least ``least`` bytes that occur more than once are stored once, by the record with the largest page_id; the others are
revisit records that refer to it.

Defined cases: a null html is an empty payload; a null url leaves out the target header; a null page_id comes before all others, is kept, and nothing
refers to it; repeated rows (equal page_id and html) are all responses if they hold the largest page_id, else all revisits; an empty
table makes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgauge.llm.tables import shared_folder, stored

#: Fixed values of the formats.
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of archives that one task reads back.
TASK_BYTES = 128 << 20


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow file system and path of a folder's address."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Dictionary built from records; where they are too few for training, their last bytes as they are."""
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8, f=18, accel=4, split_point=1.0)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], size: int, level: int) -> bytes:
    """Dictionary frame, then one frame per record."""
    d = dictionary(records, size)
    if len(d.as_bytes()) < 8:
        d = None
    raw = d.as_bytes() if d else b""
    pack = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(pack.compress, records)])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    raw = data[8 : 8 + size]
    if len(raw) >= 4 and struct.unpack_from("<I", raw)[0] == ZSTD:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    with zstandard.ZstdDecompressor(dict_data=d).stream_reader(memoryview(data)[8 + size :], read_across_frames=True) as stream:
        rest = b""
        while True:
            while (end := rest.find(b"\r\n\r\n")) < 0:
                more = stream.read(1 << 16)
                if not more:
                    if rest:
                        raise ValueError("the archive ends inside a record")
                    return
                rest += more
            lines = rest[:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            need = end + 4 + int(head["Content-Length"]) + 4
            parts, have = [rest], len(rest)
            while have < need:
                parts.append(stream.read(max(1 << 16, need - have)))
                if not parts[-1]:
                    raise ValueError("the archive ends inside a record")
                have += len(parts[-1])
            rest = b"".join(parts)
            yield head, rest[end + 4 : need - 4]
            rest = rest[need:]


def write_archives(pages: DataFrame, folder: str, least: int = 1000, roll: int = 32 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder``; returns the manifest (path, records, bytes)."""
    html = F.coalesce("html", F.lit(""))
    page = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    copies = page.where(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1 AND first IS NOT NULL").drop("n")
    page = page.join(copies, ["digest", "size"], "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        held_bytes = 0

        def flush() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            info = b"software: tollgauge\r\nformat: WARC/1.1\r\n"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            data = archive([head.encode() + info + b"\r\n\r\n", *held], dictionary_bytes, level)
            with store.open_output_stream(path) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})
            held.clear()
            return row

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, text, digest, refers = (batch.column(c)[i].as_py() for c in range(5))
                held.append(record("response" if refers is None else "revisit", page_id, url, text.encode(), digest, refers, date))
                held_bytes += len(held[-1])
                if held_bytes >= roll:
                    yield flush()
                    held_bytes = 0
        if held:
            yield flush()

    return stored(page.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) per record; stored payloads are checked against their digests."""

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path) as stream:
                    data = stream.read()
                rows: list[tuple] = []
                size = 0
                for head, block in records_of(data):
                    kind = head["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    rows.append((number(head["WARC-Record-ID"]), full, digest, kind, number(head.get("WARC-Refers-To")), payload if kind == "response" else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # manifest rows are tiny, so the number of tasks is told by the archives behind them: a fixed number is not folded together at run time
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return manifest.select("path").repartition(tasks, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8_warc_dictionary(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, and return the contract's columns from what was read."""
    folder = shared_folder(pages.sparkSession)
    return read_archives(write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
