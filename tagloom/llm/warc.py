"""Web archives: one gzip member per record, written by tasks to the shared folder and read back in sequence.

Writing: of the pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id becomes the
response, the others are revisit records that name it and carry no payload. Each task writes files of its own
under new names and reports them; only reported files are read, so a lost or repeated task leaves no double records.

Reading: a file is a stream, inflated piece by piece; a record's block has exactly Content-Length bytes, each gzip
member holds exactly one record, and a payload has to match its digest, or the read fails. A revisit has no payload to
hold against its digest: it has to name a response of the same digest and length, or the read fails.

Null html is an empty payload, null url an empty target. A null page_id is written as an empty id and read back as
null, as an empty text id is; other characters of text ids than letters, digits and ``_.-~`` are percent-encoded in
the archive. Repeated rows of the largest id are responses all of them; if all ids of a group are null, all are responses.
A payload is held whole by one task, however long. An empty table gives no files and no records. Columns other than the
three named ones take no part, whatever their names."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import kept_table, utf8
from tagloom.session import ensure_checkpoint_dir

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 512 << 20      # compressed bytes after which a task begins another file
_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _one_line(value: str) -> str:
    """A header value: control characters are percent-encoded, as they would end the header."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page: str, url: str, payload: bytes, kind: str, refers_to: str) -> bytes:
    """One record as a gzip member. A revisit's block ends after the HTTP header, whose length is the full payload's."""
    block = _HTTP % len(payload) + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{quote(page, safe='')}>"), ("WARC-Target-URI", _one_line(url)),
            ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>")]
    text = "WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in head) + "\r\n"
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(text.encode() + block + b"\r\n\r\n") + gz.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as pieces of its content. A member is to be used up before the next."""
    rest = stream.read(_CHUNK)
    while rest:
        state = {"rest": rest}

        def pieces(state=state):
            gz = zlib.decompressobj(31)
            data = state["rest"]
            while not gz.eof:
                if not data:
                    data = stream.read(_CHUNK)
                    if not data:
                        raise ValueError("the archive ends within a record")
                out = gz.decompress(data, _CHUNK)
                data = gz.unconsumed_tail or (b"" if not gz.eof else data)
                if out:
                    yield out
            state["rest"] = gz.unused_data

        yield pieces()
        rest = state["rest"] or stream.read(_CHUNK)


def parse(pieces: Iterator[bytes]) -> dict:
    """One record from the pieces of its member: headers, payload, and the payload's stated length and digest."""
    buffer = bytearray()
    while (at := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("a record without the end of its header")
        buffer += piece
    lines = bytes(buffer[:at]).decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(head["Content-Length"])
    del buffer[:at + 4]
    for piece in pieces:
        buffer += piece
    if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('WARC-Record-ID')}: its block isn't {length} bytes long")
    split = buffer.find(b"\r\n\r\n", 0, length) + 4
    http = bytes(buffer[:split]).decode("latin-1").lower()
    payload = bytes(buffer[split:length])
    stated = int(http.split("content-length: ", 1)[1].split("\r\n", 1)[0])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {head['WARC-Record-ID']}: the payload doesn't match its digest")
    return {"head": head, "payload": payload, "bytes": stated, "digest": digest}


def _uri_fs(folder: str):
    """The folder's file system and path; a bare path is local to all (a shared mount)."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1))


def with_record_types(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``page, url, payload, kind, refers_to`` per row. The groups of equal payloads are counted on digests; only
    groups of two or more are written down, and the pages meet them in a join that Spark can split at a hot digest."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(utf8(html_col), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    groups = kept_table(rows.filter("same is not null").groupBy("same")
                        .agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
                        "payload-groups")
    joined = rows.join(groups, "same", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return joined.select("page", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                         F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``page, url, payload, kind, refers_to`` rows; the list of files (``path, records, bytes``), itself kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _uri_fs(folder)
        fs.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                page, url, payload, kind, ref = row
                data = record("" if page is None else str(page), url or "", payload, kind, "" if ref is None else str(ref))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return kept_table(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the listed files: ``page, url, record_type, refers_to, payload_bytes, payload_digest`` and, if
    asked for, ``payload`` (empty for revisits), which is then read from the archives once more. The records without
    payloads are written down once; revisits are checked on them."""
    found = kept_table(records(files, folder), "warc-records")
    lost = unmatched_revisits(found).first()
    if lost is not None:
        raise ValueError(f"revisit of page {lost['page']!r}: no response has its digest {lost['payload_digest']} and length {lost['payload_bytes']}")
    return records(files, folder, with_payload=True) if with_payload else found


def unmatched_revisits(found: DataFrame) -> DataFrame:
    """``page`` (that the revisits name), ``payload_digest`` and ``payload_bytes`` of revisits without their response.
    Both sides are made distinct first: a response that a third of all records revisit is one row."""
    key = ["page", "payload_digest", "payload_bytes"]
    named = found.filter("record_type = 'revisit'").select(F.coalesce("refers_to", F.lit("")).alias("page"), *key[1:]).distinct()
    there = found.filter("record_type = 'response'").select(F.coalesce("page", F.lit("")).alias("page"), *key[1:]).distinct()
    return named.join(there, key, "left_anti")


def records(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records as they stand in the listed files, in the files' order. One task reads a file at a time."""
    names = ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _uri_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for pieces in members(stream):
                        r = parse(pieces)
                        h = r["head"]
                        rows.append((unquote(h["WARC-Record-ID"][10:-1]) or None, h["WARC-Target-URI"], h["WARC-Type"],
                                     unquote(h.get("WARC-Refers-To", "")[10:-1]) or None, r["bytes"], r["digest"],
                                     *[r["payload"]] * with_payload))
                        held += 200 + len(r["payload"]) * with_payload
                        if held > 8 << 20:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "path").select("path")
    return spread.mapInArrow(run, ", ".join(f"{a} {'long' if b == pa.int64() else 'binary' if b == pa.binary() else 'string'}"
                                            for a, b in zip(names, kinds, strict=True)))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, str]:
    """Write the pages' archives below the shared folder; the list of files and the folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    return write_archives(with_record_types(pages, id_col, url_col, html_col, min_bytes), folder), folder
