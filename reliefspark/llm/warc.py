"""Zstandard WARC archives: a dictionary in the leading skippable frame, then one frame per record; written and read back.

An archive is a row (path, content), the columns of Spark's binaryFile source, so the reader takes .warc.zst files and
tables of archives alike, on whatever store Spark reads."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, small_batches

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Bytes of records after which a task begins another archive; a record is never split.
ARCHIVE_BYTES = 16 << 20
#: Payloads from whose first bytes a dictionary is made, and its size.
DICTIONARY_PAYLOADS, DICTIONARY_BYTES = 64, 16 << 10
#: No record may decode to more.
RECORD_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, digest: str) -> bytes:
    """A response record with the payload, or a revisit record with the response's HTTP headers only. size and digest are of
    the whole payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head += [("WARC-Target-URI", target)] if target else []
    head += [("X-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """One archive in memory: append records, then bytes()."""

    def __init__(self, samples: list[bytes], level: int = 3):
        raw = b"".join(s[: DICTIONARY_BYTES // 8] for s in samples)[-DICTIONARY_BYTES:]
        self.parts, self.size = [], 0
        if len(raw) >= 8:
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packed = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(raw)
            self.parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
            self.zstd = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        else:
            self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def append(self, record: bytes) -> None:
        self.parts.append(self.zstd.compress(record))
        self.size += len(self.parts[-1])

    def bytes(self) -> bytes:
        return b"".join(self.parts)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded records. A dictionary that is compressed itself is decoded first; a dictionary in the standard format or
    raw content will do. Other skippable frames are passed over. Raises ValueError where a frame is damaged or cut short."""
    at, d = 0, None
    view = memoryview(content)
    while at < len(view):
        if len(view) - at < 4:
            raise ValueError(f"{len(view) - at} bytes after the last frame")
        (magic,) = struct.unpack_from("<I", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if len(view) - at < 8:
                raise ValueError("skippable frame cut short")
            (size,) = struct.unpack_from("<I", view, at + 4)
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) != size:
                raise ValueError("skippable frame cut short")
            if at == 0 and magic == DICTIONARY_MAGIC:
                if body[:4] == b"\x28\xb5\x2f\xfd":
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=RECORD_BYTES)
                standard = body[:4] == b"\x37\xa4\x30\xec"
                d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if standard else zstandard.DICT_TYPE_RAWCONTENT)
            at += 8 + size
            continue
        one = zstandard.ZstdDecompressor(dict_data=d, max_window_size=1 << 31).decompressobj() if d else zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
        out, size, used = [], 0, at
        try:
            while not one.eof:
                if used >= len(view):
                    raise ValueError("frame cut short")
                piece = bytes(view[used : used + (1 << 16)])
                used += len(piece)
                out.append(one.decompress(piece))
                size += len(out[-1])
                if size > RECORD_BYTES:
                    raise ValueError("record too long")
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame: {e}") from e
        at = used - len(one.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """Headers in lower case, HTTP headers, payload. Raises ValueError unless version, header lines, required fields, content
    length, digests and the two line ends after the block are right."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of headers")
    lines = record[:end].decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError(f"version {lines[0][:20]!r}")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+", name):
            raise ValueError(f"header line {line[:60]!r}")
        if name.lower() in head:
            raise ValueError(f"{name} twice")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"no {name}")
    if not re.fullmatch(r"\d+", head["content-length"]):
        raise ValueError("content-length is no number")
    size = int(head["content-length"])
    block = record[end + 4 : end + 4 + size]
    if len(block) != size or record[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"content-length {size}, but {len(record) - end - 8} bytes")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])} if gap else {}
    if head["warc-type"] == "response":
        if fields.get("content-length", str(len(payload))) != str(len(payload)):
            raise ValueError("HTTP content-length")
        if "warc-payload-digest" in head and head["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("payload digest")
    return {"head": head, "http": fields, "payload": payload}


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): archives with one record per row of pages (page_id, url, html).

    Of rows with equal payloads (null html is the empty payload) the one with the largest page_id is the response, the
    others are revisits of it. Rows with a null page_id are revisits unless their payload has no numbered page. Rows that
    repeat the response's id are responses too. Other columns are not looked at; an empty table gives no archive."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    src = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    keyed = src.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    # equal payloads by two digests together; partial aggregates meet, so a payload of a third of the pages is no burden
    groups = keyed.groupBy("sha1", "sha256").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups.select("sha256", "keeper"), "payloads")
    src = src.withColumn("sha256", F.sha2("payload", 256))
    ready = src.join(small(groups, groups.count(), 200_000), "sha256", "left").select("page_id", "url", "payload", F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(archive: Archive) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([archive.bytes()], pa.binary())], ["path", "content"])

        archive = None
        for b in batches:
            rows = [c.to_pylist() for c in b.columns]
            for page, url, payload, refers in zip(*rows, strict=True):
                if archive is None:
                    archive = Archive([p for p in rows[2] if p][:DICTIONARY_PAYLOADS])
                archive.append(write_record(page, url, payload, refers, len(payload), base32_sha1(payload)))
                if archive.size >= archive_bytes:
                    yield out(archive)
                    archive = None
        if archive is not None:
            yield out(archive)

    return ready.mapInArrow(run, "path string, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of archives (path, content): page_id, url, payload_bytes, payload_digest, record_type, refers_to
    (a page_id), and the payload (null in revisits). A record that breaks the format raises, naming the archive."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for k, record in enumerate(frames(content)):
                    try:
                        r = parse_record(record)
                    except ValueError as e:
                        raise ValueError(f"{path}, record {k}: {e}") from e
                    h, kind = r["head"], r["head"]["warc-type"]
                    number = [int(h[n]) if h.get(n) else None for n in ("x-page-id", "x-refers-to-page-id")]
                    size = len(r["payload"]) if kind == "response" else int(r["http"].get("content-length", 0))
                    rows.append((number[0], h.get("warc-target-uri"), size, h.get("warc-payload-digest", "").removeprefix("sha1:"), kind, number[1], r["payload"] if kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in enumerate(kinds)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return archives.select("path", "content").mapInArrow(run, schema)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Archives of pages, written to the shared folder and read again: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(materialize(write_archives(pages), "archives"), with_payload=False).drop("url")
