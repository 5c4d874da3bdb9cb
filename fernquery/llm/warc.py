"""WARC archives compressed with Zstandard (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds the dictionary; then each record
is one frame of its own, so that any record can be read alone. The writer trains the
dictionary on a bounded sample. The reader loads it from the leading frame, decodes
frame by frame and checks the version line, the header block, the lengths and the
digests; whatever breaks them raises ``WarcError`` with the file and the offset.

Files are written and read through ``pyarrow.fs`` in the shared folder. A task writes
under a name that depends on its partition alone and moves the file into place when it
is complete, so a repeated task replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm.common import fresh_path, stored

#: Fixed values of the format: magic numbers of the skippable frame that holds a dictionary, of a frame, and of a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary: its size, and the payloads it is trained on, at most.
DICT_BYTES, DICT_SAMPLE, DICT_TEXT = 32 << 10, 400, 1 << 14
#: Bytes read at a time, and of one record at most (longer ones are an error).
READ, MAX_RECORD = 1 << 20, 1 << 30


class WarcError(ValueError):
    """An archive that doesn't hold what it says."""


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records like ``samples``; where they are too few to train on, their joined text serves as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or VERSION


def block(kind: str, page_id: str, url: bytes | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit holds the HTTP header alone, which says how long the payload was."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <urn:page:%s>" % page_id.encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + b"".join(url.splitlines()))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if kind == "revisit":
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <urn:page:%s>" % refers_to.encode()]
    head.append(b"WARC-Block-Digest: sha1:" + sha1_base32(body).encode())
    head.append(b"Content-Length: %d" % len(body))
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archive(path: str, dictionary: bytes, records: Iterator[bytes], level: int = 3) -> int:
    """Write records under ``path``; returns how many. The file appears only when it is complete."""
    store, name = open_fs(path)
    part, count = f"{name}.{uuid.uuid4().hex}.part", 0
    packed = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True, write_checksum=True)
    with store.open_output_stream(part, compression=None) as out:
        out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        for record in records:
            out.write(packed.compress(record))
            count += 1
    store.move(part, name)
    return count


def parse(record: bytes, where: str) -> dict:
    """Fields and payload of one record, after checks of its header, lengths and digests."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise WarcError(f"{where}: no version line and header block")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b": ")
        if not colon or name.lower() in fields:
            raise WarcError(f"{where}: header line {line[:60]!r}")
        fields[name.lower()] = value
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in fields:
            raise WarcError(f"{where}: {name.decode()} is missing")
    if not fields[b"content-length"].isdigit():
        raise WarcError(f"{where}: content-length {fields[b'content-length'][:20]!r}")
    size = int(fields[b"content-length"])
    body, end = rest[:size], rest[size:]
    if len(body) != size or end != b"\r\n\r\n":
        raise WarcError(f"{where}: block of {len(rest) - 4} bytes; content-length says {size}")
    if (said := fields.get(b"warc-block-digest")) is not None and said != b"sha1:" + sha1_base32(body).encode():
        raise WarcError(f"{where}: block digest")
    http, found, payload = body.partition(b"\r\n\r\n")
    length = next((line[16:] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")), b"")
    if not found or not length.isdigit():
        raise WarcError(f"{where}: no HTTP header")
    kind, digest = fields[b"warc-type"].decode(), fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    if kind == "response" and (len(payload) != int(length) or sha1_base32(payload) != digest):
        raise WarcError(f"{where}: payload of {len(payload)} bytes; {int(length)} and digest {digest} were said")
    named = lambda x: x.decode().removeprefix("<urn:page:").removesuffix(">") if x is not None else None
    return {"page": named(fields[b"warc-record-id"]), "url": fields.get(b"warc-target-uri"), "type": kind, "bytes": int(length), "digest": digest, "refers_to": named(fields.get(b"warc-refers-to")), "payload": payload if kind == "response" else None}


def read_archive(path: str) -> Iterator[dict]:
    """The records of an archive, in order. One record is in memory at a time."""
    store, name = open_fs(path)
    with store.open_input_stream(name, compression=None) as file:
        start = file.read(8)
        magic, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
        if magic != SKIPPABLE:
            raise WarcError(f"{path}: no leading frame with a dictionary")
        content = file.read(size)
        if len(content) != size:
            raise WarcError(f"{path}: the leading frame is cut off")
        if content[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=MAX_RECORD)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        at, waiting = 8 + size, b""
        while True:
            frame, pieces, total = unpack.decompressobj(), [], 0
            waiting = waiting or file.read(READ)
            if not waiting:
                return
            where = f"{path} at {at}"
            if len(waiting) < 4:
                waiting += file.read(READ)
            if waiting[:4] != struct.pack("<I", FRAME):
                raise WarcError(f"{where}: not a frame")
            while True:
                at += len(waiting)
                try:
                    pieces.append(frame.decompress(waiting))
                except zstandard.ZstdError as e:
                    raise WarcError(f"{where}: {e}") from e
                total += len(pieces[-1])
                if total > MAX_RECORD:
                    raise WarcError(f"{where}: a record of more than {MAX_RECORD} bytes")
                if frame.eof:
                    waiting = frame.unused_data
                    at -= len(waiting)
                    break
                waiting = file.read(READ)
                if not waiting:
                    raise WarcError(f"{where}: the last frame is cut off")
            yield parse(b"".join(pieces), where)


def write_archives(records: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write ``records(page, url, payload, type, refers_to)``, an archive per partition; returns ``(path, records)``."""
    open_fs(folder)[0].create_dir(open_fs(folder)[1], recursive=True)

    def run(batches):
        from pyspark import TaskContext

        counts = [0]

        def blocks():
            for batch in batches:
                for page, url, payload, kind, ref in zip(*(batch[c].to_pylist() for c in ("page", "url", "payload", "type", "refers_to"))):
                    yield block(kind, page, url, payload, sha1_base32(payload), ref)

        path = f"{folder}/pages-{TaskContext.get().partitionId():05d}.warc.zst"
        counts[0] = write_archive(path, dictionary, blocks())
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [counts[0]]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return records.mapInArrow(run, "path string, records long")


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all archives of ``paths(path)``: ``(page, type, bytes, digest, refers_to[, payload])``."""
    names = ["page", "type", "bytes", "digest", "refers_to", *(["payload"] if payloads else [])]
    schema = pa.schema([("page", pa.string()), ("type", pa.string()), ("bytes", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), *([("payload", pa.binary())] if payloads else [])])

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, held = [], 0
                for r in read_archive(path):
                    rows.append({n: r[n] for n in names})
                    held += 200 + len(r["payload"] or b"") * payloads
                    if held > READ:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select("path").mapInArrow(run, "page string, type string, bytes long, digest string, refers_to string" + ", payload binary" * payloads)


def deduplicated(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``records`` for ``write_archives``.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the
    smallest id is a response and the others revisit it; smaller payloads are all
    responses. Repeated rows of that id are all responses. A page with a null id
    revisits the others; if all have null ids, all are responses. A null html is the
    empty payload; a null url is left out of the record.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("binary").alias("url"), payload.alias("payload"), F.when(F.octet_length(payload) >= min_bytes, F.sha1(payload)).alias("sha"))
    shared = stored(rows.filter("sha is not null").groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first"), "shared_payloads")
    again = rows.join(shared, "sha", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return again.select(text(F.col("id")).alias("page"), "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("type"), F.when(revisit, text(F.col("first"))).alias("refers_to"))


def archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the pages as archives in the shared folder; returns ``(path, records)``.

    An empty table gives archives without records.
    """
    spark: SparkSession = pages.sparkSession
    sample = pages.select(F.substring(F.coalesce(F.col(html_col), F.lit("")), 1, DICT_TEXT).alias("t")).limit(DICT_SAMPLE).collect()
    dictionary = train([block("response", "0", None, r["t"].encode(), "", None) for r in sample])
    records = deduplicated(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)
    return stored(write_archives(records, folder or fresh_path(spark, "warc"), dictionary), "archives")
