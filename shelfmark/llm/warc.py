"""WARC archives compressed with Zstandard: one frame per record, shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame; every record is a frame of its own, so any
record can be decoded alone.  Writing tasks write under a name of their own
attempt and rename when complete, so a retried task leaves no partial archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import shared_dir, written

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
#: a fixed WARC-Date keeps archives reproducible
DATE = "2024-01-01T00:00:00Z"


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(data)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def record_bytes(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n"
    return head.encode("utf-8") + payload + b"\r\n\r\n"

#: an archive is fed to the decoder in pieces of this size
PIECE_BYTES = 16 << 10


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload; raises ValueError on a malformed head or a wrong length."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"header without a colon: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"record without {name}")
    if not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    n = int(headers["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError(f"content-length {n}, but {len(body) - 4} bytes follow")
    return headers, body[:n]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, decoded frame by frame."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", data, 4)[0]
        content = data[8 : 8 + n]
        if len(content) != n:
            raise ValueError("the dictionary frame is cut short")
        if len(content) >= 4 and struct.unpack_from("<I", content)[0] == FRAME:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary, at = zstandard.ZstdCompressionDict(content) if content else None, 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        one, parts, fed = reader.decompressobj(), [], at
        while not one.eof and fed < len(data):  # what follows the frame is copied back, so pieces are small
            parts.append(one.decompress(view[fed : fed + PIECE_BYTES]))
            fed = min(fed + PIECE_BYTES, len(data))
        if not one.eof:
            raise ValueError(f"the frame at byte {at} is cut short")
        at = fed - len(one.unused_data)
        yield parse_record(b"".join(parts))


def train_dictionary(pages: DataFrame, html: str, sample_rows: int, dict_bytes: int) -> bytes:
    """Dictionary from the ``sample_rows`` distinct texts of smallest hash; empty if there is too little to train on.

    A threshold for the hash comes from the number of distinct texts, so that
    about four times the sample is looked at, however many rows there are.
    """
    hashed = pages.select(F.substring(F.col(html), 1, 20_000).alias("h")).where(F.length("h") > 0).withColumn("k", F.xxhash64("h"))
    distinct = hashed.agg(F.approx_count_distinct("k").alias("n")).first()["n"]
    share = min(1.0, 4 * sample_rows / max(1, distinct))
    some = hashed.where(F.col("k") <= int(min(2**63 - 1, -(2**63) + share * 2**64)))
    samples = [r["h"].encode("utf-8") for r in some.groupBy("k").agg(F.first("h").alias("h")).orderBy("k").limit(sample_rows).collect()]
    if sum(map(len, samples)) < 20 * 1024 or len(samples) < 8:
        return b""
    return zstandard.train_dictionary(min(dict_bytes, sum(map(len, samples)) // 10), samples).as_bytes()


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", html: str = "html", url: str = "url", revisit_from: int = 0, level: int = 3, sample_rows: int = 400, dict_bytes: int = 64 << 10, roll_bytes: int = 16 << 20) -> DataFrame:
    """Write one record per row below ``path``; returns (archive, records, bytes), one row per archive.

    Among records of equal payloads of at least ``revisit_from`` bytes the one of
    smallest id is a response, the rest revisit it and carry no payload.  A null
    html is an empty payload; rows with a null id are written too, and lose ties
    to no id (nulls last).  Equality is by SHA-1 and length, found by a grouped
    minimum and an equi join that adaptive execution can split.  Repeated rows
    (same id, same payload) are responses all.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    dictionary = train_dictionary(pages, html, sample_rows, dict_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("sha"), F.octet_length(payload).cast("long").alias("n"))
    keys = rows.select("id", "sha", "n")
    firsts = keys.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where((F.col("copies") > 1) & (F.col("n") >= revisit_from)).select("sha", "n", "first")
    linked = keys.join(firsts, ["sha", "n"]).where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("rid"), F.col("sha").alias("rsha"), F.col("n").alias("rn"), "first").distinct()
    marked = rows.join(linked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("sha") == F.col("rsha")) & (F.col("n") == F.col("rn")), "left").select("id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=own) if own else zstandard.ZstdCompressor(level=level)
        lead = dictionary_frame(dictionary)
        parts, size, count, done = [lead], len(lead), 0, []

        def close() -> None:
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name + ".tmp") as f:
                for part in parts:
                    f.write(part)
            fs.move(name + ".tmp", name)
            done.append((os.path.basename(name), count, size))

        for batch in batches:
            for i, u, p, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = p.encode("utf-8")
                headers = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if i is None else i}>"), ("WARC-Date", DATE)]
                if u:
                    headers.append(("WARC-Target-URI", u.replace("\r", "%0D").replace("\n", "%0A")))
                headers += [("WARC-Payload-Digest", f"sha1:{_digest(body)}"), ("X-Payload-Length", str(len(body))), ("Content-Type", "text/html; charset=utf-8")]
                if first is not None:
                    headers += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                frame = packer.compress(record_bytes(headers, b"" if first is not None else body))
                parts.append(frame)
                size, count = size + len(frame), count + 1
                if size >= roll_bytes:
                    close()
                    parts, size, count = [lead], len(lead), 0
        if count:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return marked.mapInArrow(write, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the archives; a bad header, length or digest fails the job.

    ``archives`` is the manifest that ``write_archives`` returns, with the names of
    complete archives below ``folder``: one that a lost task left behind is not in
    it.  Tasks open their archives themselves; payloads leave in batches of about
    ``batch_bytes``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = f.read()
                out, size = [], 0
                for h, body in read_archive(data):
                    if h["warc-type"] == "response" and h["warc-payload-digest"] != f"sha1:{_digest(body)}":
                        raise ValueError(f"digest of {h['warc-record-id']} does not match its payload")
                    page, refers = (h[k].removeprefix("<urn:page:").removesuffix(">") if k in h else "" for k in ("warc-record-id", "warc-refers-to"))
                    out.append((int(page) if page else None, h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(refers) if refers else None, body.decode("utf-8") if h["warc-type"] == "response" else None))
                    size += len(body) + 200
                    if size >= batch_bytes:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    names = archives.select("archive")
    return names.repartition(max(1, min(names.count(), 20_000))).mapInArrow(read, _READ_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)


_READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def archive_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder, then read the archives back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(written(write_archives(pages, path, revisit_from=revisit_from), "warc-manifest"), path)
