"""WARC archives: writing records in segments, reading them back and putting segments together again."""

from __future__ import annotations

import base64
import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import stage_table

#: Payload bytes in one HTTP chunk, block bytes in one segment, and the size at which an archive is closed.
CHUNK, SEGMENT, ARCHIVE = 16 << 10, 64 << 10, 8 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_DATE = b"2024-01-01T00:00:00Z"
_RECORD = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("origin_id", pa.string()), ("segment", pa.int64()), ("total_length", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
RECORD_DDL = ("archive string, record_id string, record_type string, uri string, refers_to string, payload_digest string, origin_id string, "
              "segment bigint, total_length bigint, block binary, error string")


def base32_digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def record_name(key, digest: str) -> str:
    return f"urn:x-record:{'' if key is None else key}:{digest}"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are read over, a broken frame raises ValueError."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload behind the HTTP header of a block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP header has no end")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def _member(kind: bytes, name: str, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name.encode() + b">", b"WARC-Date: " + _DATE]
    lines += [k + b": " + v for k, v in headers if v] + [b"Content-Length: %d" % len(block), b"", b""]
    return gzip.compress(b"\r\n".join(lines) + block + b"\r\n\r\n", 1, mtime=0)


def _records(key, uri: str | None, payload: bytes, digest: str, first, segment: int) -> list[bytes]:
    """Members of one row: one record, or a first segment and its continuations."""
    safe = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", uri or "").encode()
    name = record_name(key, digest)
    common = [(b"WARC-Target-URI", safe), (b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http; msgtype=response")]
    if first is not None:
        refers = [(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"WARC-Refers-To", b"<" + record_name(first, digest).encode() + b">")]
        return [_member(b"revisit", name, common + refers, _HTTP + b"\r\n")]
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_member(b"response", name, common, block)]
    pieces = [block[at : at + segment] for at in range(0, len(block), segment)]
    out = [_member(b"response", name, [*common, (b"WARC-Segment-Number", b"1")], pieces[0])]
    for k, piece in enumerate(pieces[1:], 2):
        headers = [(b"WARC-Segment-Origin-ID", b"<" + name.encode() + b">"), (b"WARC-Segment-Number", b"%d" % k)]
        if k == len(pieces):
            headers.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_member(b"continuation", f"{name}:{k}", headers, piece))
    return out


def write_archives(rows: DataFrame, key: str, uri: str, payload: str, min_bytes: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE) -> DataFrame:
    """(archive, content): gzip-membered archives of a record per row, staged in the shared folder.

    Rows with equal payloads of at least `min_bytes`: the one with the largest
    key is a response, the others revisit it. Only keys and digests are
    shuffled for that, summed inside the tasks first, and only repeated digests
    go on; payloads meet their revisit mark by key. A null payload is empty; a
    null key is smaller than any other and named by an empty key; repeated rows
    give repeated records. Continuations go to an archive of their own, so
    that segments of a record are spread over archives.
    """
    base = rows.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary")).alias("payload"))
    base = base.withColumn("sha1", F.sha1("payload"))
    digests = base.filter(F.octet_length("payload") >= min_bytes).select("key", "sha1")
    repeated = digests.groupBy("sha1").agg(F.max("key").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    marks = (
        digests.join(repeated, "sha1").filter(~F.col("key").eqNullSafe(F.col("first")))
        .select(F.col("key").alias("__key"), F.col("sha1").alias("__sha1"), "first").distinct()
    )
    marked = base.join(marks, F.col("key").eqNullSafe(F.col("__key")) & (F.col("sha1") == F.col("__sha1")), "left")
    ready = marked.select(F.col("key").cast("string").alias("key"), "uri", "payload", "sha1", F.col("first").cast("string").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        label = uuid.uuid4().hex
        number, size = 0, {"main": 0, "cont": 0}
        open_ = {"main": [], "cont": []}

        def close(which: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            content = b"".join(open_[which])
            open_[which], size[which] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([f"{label}-{number:05d}-{which}.warc.gz"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for k, u, p, sha, first in zip(*(c.to_pylist() for c in batch.columns)):
                for j, member in enumerate(_records(k, u, p, base32_digest(sha), first, segment)):
                    which = "cont" if j else "main"
                    open_[which].append(member)
                    size[which] += len(member)
                    if size[which] >= archive:
                        yield close(which)
        for which in open_:
            if open_[which]:
                yield close(which)

    return stage_table(ready.mapInArrow(run, "archive string, content binary"))


def save_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file of its name below a folder that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                    out.write(content)
        yield pa.RecordBatch.from_pylist([], pa.schema([("done", pa.int64())]))

    archives.select("archive", "content").mapInArrow(run, "done bigint").count()


def open_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of files written elsewhere."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def _members(content: bytes) -> Iterator[bytes]:
    """Inflated members one after another; an archive without compression is one member."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content):
        inflater = zlib.decompressobj(31)
        # a bounded window first, so that what follows a small member is not copied each time
        out, step = [], 1 << 20
        while not inflater.eof and at < len(content):
            piece = view[at : at + step]
            out.append(inflater.decompress(piece))
            at += len(piece) - len(inflater.unused_data)
        if not inflater.eof:
            raise ValueError("archive is cut")
        yield b"".join(out)


def _parse(member: bytes) -> Iterator[dict]:
    at = 0
    while at < len(member):
        if member[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = member.find(b"\r\n\r\n", at)
        if end < 0 or not member.startswith(b"WARC/", at):
            raise ValueError("record header is broken")
        head = {}
        for line in member[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        start = end + 4
        length = int(head["content-length"])
        if start + length > len(member):
            raise ValueError("record is cut")
        yield head | {"block": member[start : start + length]}
        at = start + length


def read_records(archives: DataFrame) -> DataFrame:
    """A row per record: ids, type, segment fields and block; an unreadable rest of an archive gives one row with `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda v: v.strip("<>") if v else None
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, size = [], 0
                try:
                    for member in _members(content or b""):
                        for h in _parse(member):
                            found.append({
                                "archive": archive, "record_id": bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "uri": bare(h.get("warc-target-uri")),
                                "refers_to": bare(h.get("warc-refers-to")), "payload_digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                                "origin_id": bare(h.get("warc-segment-origin-id")), "segment": int(h["warc-segment-number"]) if "warc-segment-number" in h else None,
                                "total_length": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "block": h["block"], "error": None})
                            size += len(h["block"])
                            if size > 4 << 20:
                                yield pa.RecordBatch.from_pylist(found, _RECORD)
                                found, size = [], 0
                except (ValueError, KeyError, zlib.error) as problem:
                    found.append({"archive": archive, "error": f"{type(problem).__name__}: {problem}"})
                if found:
                    yield pa.RecordBatch.from_pylist(found, _RECORD)

    return archives.select("archive", "content").mapInArrow(run, RECORD_DDL)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, in order of their number, checked against the total length.

    Records without a segment number pass by without a shuffle. A group is one
    record, so its size is that of one page. Repeated records (one id, equal
    blocks) are told by their count and come back as often. A gap, a missing
    end, a wrong total or two different blocks of one number give `error` and
    a null block.
    """
    ids = ["record_id", "record_type", "uri", "refers_to", "payload_digest"]
    whole = records.filter("segment is null").select(*ids, "block", "error")
    parts = records.filter("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    numbered = parts.groupBy("origin", "segment", "block").agg(
        F.count("*").alias("n"), F.max("total_length").alias("total"), *[F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in ids])
    grouped = numbered.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("pieces"), F.max("total").alias("total"), F.min("n").alias("n"), *[F.max(c).alias(c) for c in ids])
    order = F.transform("pieces", lambda p: p["segment"])
    joined = F.concat_ws("", F.transform("pieces", lambda p: F.hex(p["block"])))
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"]))
    problem = (
        F.when(order != F.sequence(F.lit(1).cast("long"), F.size("pieces").cast("long")), "segments are not 1 to n")
        .when(F.col("total").isNull(), "last segment is missing").when(length != F.col("total"), "total length differs")
    )
    joined_rows = (
        grouped.withColumn("error", problem).withColumn("block", F.when(F.col("error").isNull(), F.unhex(joined)))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*ids, "block", "error")
    )
    return whole.unionByName(joined_rows)


def read_payloads(archives: DataFrame) -> DataFrame:
    """(record_id, record_type, uri, refers_to, payload_digest, payload, error) of every response and revisit.

    The payload of a revisit is null; its length and text are those of the
    record it refers to.
    """
    whole = reassemble(read_records(archives))
    schema = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, errors = [], []
            for kind, block, error in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                payload = None
                if error is None and kind != "revisit":
                    try:
                        payload = http_payload(block or b"")
                    except ValueError as problem:
                        error = str(problem)
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names[:5], "payload", "error"])

    return whole.mapInArrow(run, schema)
