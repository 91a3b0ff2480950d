"""WARC archives compressed with a Zstandard dictionary.

Each archive starts with a skippable frame that holds a dictionary built from that archive's records; every
record is one frame compressed with it, so single records stay addressable.  Of records with equal payloads of at
least ``min_bytes`` bytes the one with the largest id is a ``response``; the others are ``revisit`` records that name it.

Cases: a null payload is an empty one; a null id never is the largest unless all of the group are null; repeated rows
of the largest id are all responses; a null or odd URL is written percent-encoded, null as none; an empty table
writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metasift.llm.common import saved, text_or_empty, tidy
from metasift.session import scratch_path

#: Uncompressed bytes after which a task closes an archive; one longer record makes a longer archive.
ARCHIVE_BYTES = 32_000_000
DICT_BYTES = 64_000
#: Bytes of records, evenly spread over the archive, that its dictionary is built from.
SAMPLE_BYTES = 1_000_000
LEVEL = 3
#: Tasks that read archives back, at most.
READERS = 20_000
#: Fixed value: the skippable frame that carries a dictionary for the frames after it.
SKIPPABLE = (0x184D2A5D).to_bytes(4, "little")
CRLF = b"\r\n"

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, path string, offset long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(ident: str | None) -> str:
    return f"<urn:x-page:{quote(ident, safe='')}>" if ident is not None else "<urn:x-page-none>"


def _ident(urn: str) -> str | None:
    return unquote(urn[len("<urn:x-page:"):-1]) if urn.startswith("<urn:x-page:") else None


def record(ident: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record.  A revisit keeps the response's HTTP head, its length included, and no payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(payload)).encode(), b"", b""])
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(ident)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~')}")
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def info(name: str, date: str) -> bytes:
    """The record that opens an archive and says what it is."""
    block = f"software: metasift\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {quote(name)}",
            "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


def is_info(raw: bytes) -> bool:
    return raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def parse(raw: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    length = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _ident(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": _ident(refers) if refers else None, "payload": payload if kind == "response" else None,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over the archive; raw content where they are too few to train on."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    pieces = [r[k:k + 16_384] for r in sample for k in range(0, len(r), 16_384)]
    size = min(DICT_BYTES, max(1024, sum(map(len, pieces)) // 10))
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame, then a frame for each record."""
    trained = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
    return b"".join([SKIPPABLE, len(trained).to_bytes(4, "little"), trained, *[packer.compress(r) for r in records]])


def unarchive(stream, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive read front to back, a record at a time."""
    head = stream.read(8)
    if head[:4] != SKIPPABLE:
        raise ValueError("the archive does not start with a dictionary frame")
    size = int.from_bytes(head[4:], "little")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    at, rest = 8 + size, b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        begin = at - len(rest)
        while not frame.eof:
            if not rest:
                rest = stream.read(step)
                at += len(rest)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield begin, b"".join(parts)


def _put(folder: str, name: str, data: bytes) -> str:
    """Write a whole file under its final name at once; a second attempt of the same task replaces it."""
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, f"{base}/{name}")
    return name


def _writer(folder: str, limit: int, date: str):
    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{k:05d}.warc.zst"
            data = archive([info(name, date), *held])
            _put(folder, name, data)
            return pa.RecordBatch.from_pylist([{"path": name, "records": len(held), "bytes": len(data)}])

        for batch in batches:
            for r in batch.to_pylist():
                ident, best = r["page_id"], r["best"]
                keep = ident == best
                held.append(record(ident, r["url"], r["payload"], "response" if keep else "revisit", None if keep else best, date))
                size += len(held[-1])
                if size >= limit:
                    yield close()
                    held, size, k = [], 0, k + 1
        if held:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Write ``pages`` to archives in ``folder``; returns their manifest (path, records, bytes).

    ``date`` (``2024-05-01T12:00:00Z``) is when the pages were taken, now if not given; a retried task writes the same.

    Payloads meet by digest and length in an aggregation of maxima; the join back on it spreads hot payloads."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), text_or_empty(html).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.struct(F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("d")))
    best = rows.select("key", "id").groupBy("key").agg(F.max("id").alias("best"))
    known = rows.join(best.withColumnRenamed("key", "same"), F.col("key") == F.col("same"))
    shared = F.octet_length("payload") >= min_bytes
    known = known.select(
        F.col("id").cast("string").alias("page_id"), "url", "payload",
        F.when(shared, F.col("best")).otherwise(F.col("id")).cast("string").alias("best"),
    )
    return saved(known.mapInArrow(_writer(folder, archive_bytes, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that ``manifest`` lists, decompressed and parsed one at a time."""
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        kind = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for at, raw in unarchive(stream):
                        if is_info(raw):
                            continue
                        row = parse(raw) | {"path": path, "offset": at}
                        if row["payload"] is not None and (len(row["payload"]) != row["payload_bytes"] or digest(row["payload"]) != row["payload_digest"]):
                            raise ValueError(f"{path} at {at}: the payload differs from its digest")
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(raw)
                        if size > 8_000_000 or len(rows) >= 5_000:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    # As many tasks as archives, up to a bound: with a number given, the few bytes of their names are not put into one.
    return manifest.select("path").repartition(max(1, min(manifest.count(), READERS)), "path").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new folder of archives under the shared folder and read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder, payloads=False)
