"""WARC archives of Zstandard frames: a dictionary in the leading skippable frame, one frame for each record."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.llm.arrowtext import slices
from civiltext.llm.files import Written, reading
from civiltext.llm.sampling import smallest_hashes
from civiltext.sources.storage import materialise, scratch_path

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 100
#: The dictionary is fitted on so many pages, so many characters of each.
SAMPLE_PAGES = 400
SAMPLE_CHARS = 8_000
DICTIONARY_BYTES = 32_768
#: An archive is closed at this size.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 64 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class Record:
    """One record as read: its header fields in lower case and its block."""

    fields: dict[str, str]
    block: bytes


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(_SPACE, f'{page_id}/{digest}').urn}>"


def clean_uri(url: str) -> str:
    """A URL on one line of visible characters."""
    return "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record: the HTTP head and the payload, or for a revisit the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {clean_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    """Header and block of one record; raises ValueError where the record is not what its header says."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a record without the end of its header")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {first[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header field: {line[:40]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("a content length that is no number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"content length {n}, but {len(rest) - 4} bytes")
    return Record(fields, rest[:n])


def page_of(record: Record) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, its digest checked."""
    head, gap, payload = record.block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("a block without an HTTP head")
    sizes = [line.split(b":", 1)[1] for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if len(sizes) != 1:
        raise ValueError("an HTTP head without its length")
    size, kind = int(sizes[0]), record.fields["warc-type"]
    digest = record.fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a payload of another length or digest than its header says")
    elif kind != "revisit" or payload or "warc-refers-to" not in record.fields:
        raise ValueError(f"not a response or a revisit: {kind!r}")
    number = lambda name: int(record.fields[name]) if name in record.fields and record.fields[name] != "None" else None
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id")


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_archive(stream) -> Iterator[bytes]:
    """The raw records of an archive, one for each frame, in bounded pieces of input."""
    head = stream.read(8)
    magic, n = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("an archive without a leading dictionary frame")
    dictionary = stream.read(n)
    if len(dictionary) != n:
        raise ValueError("a dictionary frame that is cut off")
    if dictionary[:4] == struct.pack("<I", FRAME):  # the dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = b""
    while rest or (rest := stream.read(READ_BYTES)):
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(READ_BYTES)
            if not frame.eof and not rest:
                raise ValueError("a frame that is cut off")
        yield b"".join(parts)


def fit_dictionary(pages: DataFrame, html: str = "html", page_id: str = "page_id") -> bytes:
    """A dictionary from a bounded sample: the pages with the smallest hashes of id and text."""
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    chosen = smallest_hashes(pages, [F.col(page_id), text], SAMPLE_PAGES).select(F.substring(text, 1, SAMPLE_CHARS).alias("t")).distinct()
    parts = [r["t"].encode() for r in chosen.orderBy("t").limit(SAMPLE_PAGES).collect() if r["t"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: a dictionary of plain content
        return (b"".join(parts) + record_bytes(0, "http://", b"", "0" * 64, 0, True))[-DICTIONARY_BYTES:]


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives of all pages into ``folder``; returns the list of them (uri, records, bytes).

    Of records with equal payloads of at least 100 bytes the one with the smallest page id is a
    response, the others revisit it; shorter payloads are all responses. A null html is an empty
    payload. If rows with the smallest id are repeated, each of them is a response; rows without
    an id revisit the smallest id there is, and are responses where there is none.
    """
    dictionary = fit_dictionary(pages, html, page_id)
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text.alias("html"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
    shared = rows.filter(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    marked = rows.join(shared.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        out, records, done = None, 0, []
        for part in slices(batches, "html"):
            for r in part.to_pylist():
                if out is None:
                    out, records = Written(folder, f"pages-{TaskContext.get().partitionId():05d}.warc.zst"), 0
                    out.write(dictionary_frame(dictionary))
                out.write(context.compress(record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["first"], r["revisit"])))
                records += 1
                if out.bytes >= ARCHIVE_BYTES:
                    out.close()
                    done.append((out.uri, records, out.bytes))
                    out = None
        if out is not None:
            out.close()
            done.append((out.uri, records, out.bytes))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], names=["uri", "records", "bytes"])

    return materialise(marked.mapInArrow(write, "uri string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record of the listed archives.

    Frames, headers, lengths and digests are checked; a fault ends the job with what is wrong and where.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for uri, records in zip(batch.column("uri").to_pylist(), batch.column("records").to_pylist()):
                rows, seen = [], 0
                with reading(uri) as stream:
                    for raw in read_archive(stream):
                        try:
                            record = parse_record(raw)
                            rows.append((*page_of(record), record.fields.get("warc-target-uri")))
                        except ValueError as e:
                            raise ValueError(f"{uri}, record {seen}: {e}") from e
                        seen += 1
                        if len(rows) == 2000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if seen != records:
                    raise ValueError(f"{uri}: {seen} records, {records} were written")
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, archives.count())
    spread = archives.select("uri", "records").repartition(min(n, 100_000))
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc")))
