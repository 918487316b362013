"""Zstandard-compressed WARC archives: write, read back, validate.

An archive begins with a skippable frame that holds the dictionary of its records; each record
is one frame of its own. The writer trains the dictionary of an archive on its first records
(``DICTIONARY_ROWS`` and ``DICTIONARY_BYTES`` at most), closes an archive at ``ARCHIVE_BYTES``
and gives it a name of its own; the list of finished archives is a table that Spark commits, so
a task that is lost and run again leaves only files that no list names. The reader loads the
dictionary, decodes one frame at a time in pieces of ``CHUNK`` bytes and checks each record:
version line, named fields, Content-Length against the block, the closing blank lines, and the
payload digest of responses.

Records of equal payload (by SHA-1 and length) are written once: the one with the largest page_id
is the response, all others are revisits that refer to it. Payloads under ``min_bytes`` are never
revisits.

Defined results: null html is an empty payload; null url leaves the target out; a null page_id is
smaller than any other, and if a payload has no other it stays a response; rows of one page_id
and one payload are all responses if that page_id is the largest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askgrid.llm.workspace import lean_batches, new_path, written

MAGIC = 0x184D2A5D  # the skippable frame that holds a dictionary
ARCHIVE_BYTES, CHUNK = 16_000_000, 1 << 16
DICTIONARY_ROWS, DICTIONARY_BYTES, DICTIONARY_SIZE = 400, 4_000_000, 64_000
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Rows of digests that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000
_RECORDS = "record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has its headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """Bytes of one archive, its dictionary trained on the first records."""

    def __init__(self) -> None:
        self.first: list[bytes] = []
        self.held = 0
        self.out = bytearray()
        self.records = 0
        self.packer = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.packer:
            self.out += self.packer.compress(data)
            return
        self.first.append(data)
        self.held += len(data)
        if len(self.first) >= DICTIONARY_ROWS or self.held >= DICTIONARY_BYTES:
            self._begin()

    def _begin(self) -> None:
        import zstandard

        try:
            size = min(DICTIONARY_SIZE, max(1024, self.held // 10))
            dictionary = zstandard.train_dictionary(size, [x[:65536] for x in self.first], level=3)
        except zstandard.ZstdError:  # too little to train on: the first record's head serves as raw content
            dictionary = zstandard.ZstdCompressionDict(self.first[0][:4096], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = dictionary.as_bytes()
        self.out += struct.pack("<II", MAGIC, len(raw)) + raw
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
        for x in self.first:
            self.out += self.packer.compress(x)
        self.first = []

    def size(self) -> int:
        return len(self.out) + self.held * (self.packer is None)

    def close(self) -> bytes:
        if self.first:
            self._begin()
        return bytes(self.out)


def frames(read) -> Iterator[bytes | str]:
    """Each frame's content from ``read(n)``; a string tells what is wrong, and ends the archive."""
    import zstandard

    head = read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != MAGIC:
        yield "no dictionary frame"
        return
    raw = b""
    while len(raw) < size and (more := read(size - len(raw))):
        raw += more
    if len(raw) < size:
        yield "the dictionary is cut short"
        return
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
        kind = zstandard.DICT_TYPE_AUTO
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    left = b""
    while True:
        left = left or read(CHUNK)
        if not left:
            return
        frame, parts = unpack.decompressobj(), []
        try:
            while not frame.eof:
                if not left and not (left := read(CHUNK)):
                    yield "the last frame is cut short"
                    return
                parts.append(frame.decompress(left))
                left = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            yield f"bad frame: {e}"
            return
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """The columns of ``read_archives`` of one decoded frame; the last says what is wrong with it."""
    head, split, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    error = None
    if not split or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        error = "no WARC header"
    elif missing := [k for k in REQUIRED if k not in fields]:
        error = f"without {', '.join(missing)}"
    elif not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4:
        error = "Content-Length is not the block's length"
    elif not rest.endswith(b"\r\n\r\n"):
        error = "no blank lines at the end"
    http, _, payload = rest[:-4].partition(b"\r\n\r\n") if not error else (b"", b"", b"")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r", b""))
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields.get("warc-type")
    if not error and kind == "response" and (said != digest(payload) or length and int(length[1]) != len(payload)):
        error = "the payload is not what its digest or length says"
    size = int(length[1]) if length else len(payload)
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), said or None, size, payload if kind == "response" else None, error


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        archive, done = Archive(), []

        def close() -> None:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            data = archive.close()
            with where.open_output_stream(path, compression=None) as f:
                f.write(data)
            done.append((path, archive.records, len(data)))

        for batch in batches:
            for page, url, html, refers_to, again in zip(*[c.to_pylist() for c in batch.columns]):
                archive.add(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, again))
                if archive.size() >= ARCHIVE_BYTES:
                    close()
                    archive = Archive()
        if archive.records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[], [], []], (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, _ = fs.FileSystem.from_uri(folder)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                store, own = fs.FileSystem.from_uri(path) if "://" in path else (where, path)
                with store.open_input_stream(own, compression=None) as f:
                    for data in frames(f.read):
                        rows.append(parse(data) if isinstance(data, bytes) else (None,) * 5 + (0, None, data))
                        held += len(data)
                        if len(rows) >= 1000 or held >= 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, again) of each page: whether its payload is written by another, and by which."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    pages = pages.withColumns({"_ag_sha": F.sha1(F.coalesce("html", F.lit(""))), "_ag_size": size})
    # Counted in each task first, so a payload with a third of all pages is a row a task.
    payloads = pages.where(F.col("_ag_size") >= min_bytes).groupBy("_ag_sha", "_ag_size").agg(F.count("*").alias("n"), F.max("page_id").alias("_ag_last"))
    shared = written(payloads.where("n > 1").drop("n"), "payloads")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_ag_last")), F.lit(False)) & F.col("_ag_last").isNotNull()
    joined = pages.join(shared, ["_ag_sha", "_ag_size"], "left")
    return joined.select("page_id", "url", "html", F.when(again, F.col("_ag_last")).alias("refers_to"), again.alias("again"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record for each page into archives under ``folder`` (shared by all executors); the table of finished archives."""
    spark = pages.sparkSession
    lean_batches(pages.sparkSession)
    folder = folder or new_path(spark, "archives")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    done = written(with_revisits(pages, min_bytes).mapInArrow(_write(folder), "path string, records long, bytes long"), "archive-list")
    done._askgrid_folder = folder
    return done


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the listed archives; ``error`` is null for valid ones."""
    lean_batches(archives.sparkSession)
    return archives.select("path").mapInArrow(_read(folder), _RECORDS)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives in a folder, as ``read_archives`` takes them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("bytes"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and return a row for each record; a bad record is an error."""
    archives = write_archives(pages, min_bytes=min_bytes)
    found = read_archives(archives, archives._askgrid_folder)
    valid = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "error")).cast("boolean")).otherwise(True)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    page = lambda c: F.nullif(number(c), F.lit("")).cast("long")
    return found.where(valid).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
