"""WARC archives with Zstandard: one frame per record, and a dictionary in front.

An archive is a skippable frame with a dictionary, which its first records have trained, and
then one frame per record. The reader loads the dictionary (plain or itself compressed),
decodes one frame after another from a stream, and checks the version line, the needed
headers, the length of the block and, for responses, the digest and length of the payload.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the ones with the smallest
key are responses; the others are revisits that hold the headers and refer to it. A null
payload is empty. A row without key is a record of its own, which others refer to only if its
whole group has no key; then all are responses. A null URL leaves out its header; control
characters in a URL are percent-encoded. Repeated rows make a record each. No archive is
written for an empty partition, so an empty table has no archives. Other columns are not read.

Tasks write archives under new names in the shared folder and report those they finished, so
what a lost task left behind is never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchsieve.functions.durable import new_folder, settle

REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 16 << 10
#: Records of about so many bytes train an archive's dictionary.
TRAINING_BYTES = 2 << 20
DATE = "2000-01-01T00:00:00Z"

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None
) -> bytes:
    """One record; a revisit when it refers to another page."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        clean = "".join(c if ord(c) >= 32 else f"%{ord(c):02X}" for c in url)
        headers.append(("WARC-Target-URI", clean))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to one archive after training a dictionary on the first of them."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = where.open_output_stream(name, compression=None)
        self.waiting: list[bytes] = []
        self.compressor: zstandard.ZstdCompressor | None = None
        self.bytes = 0

    def add(self, record: bytes) -> None:
        self.bytes += len(record)
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.waiting.append(record)
        if self.bytes >= TRAINING_BYTES:
            self._begin()

    def _begin(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except zstandard.ZstdError:  # too few records to train on: they serve as they are
            raw = b"".join(self.waiting)[:DICTIONARY_BYTES]
            trained = zstandard.ZstdCompressionDict(raw, zstandard.DICT_TYPE_RAWCONTENT)
        data = trained.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
        for record in self.waiting:
            self.out.write(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()
        self.out.close()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    digest: str

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["WARC-Record-ID"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers["WARC-Refers-To"]) if "WARC-Refers-To" in self.headers else None


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:80]!r}")
        out[name.strip()] = value.strip()
    return out


def parse_record(data: bytes) -> Record:
    """Check one record and take it apart; a fault is a ValueError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("the version line is wrong")
    headers = _headers(lines[1:])
    if lacking := [h for h in NEEDED if h not in headers]:
        raise ValueError(f"headers are lacking: {', '.join(lacking)}")
    if len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block has another length than its header says")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the block holds no HTTP headers")
    length = int(_headers(http.split(b"\r\n")[1:])["Content-Length"])
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if headers["WARC-Type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload does not match its length or digest")
    elif headers["WARC-Type"] != "revisit" or payload:
        raise ValueError("the record is neither a response nor an empty revisit")
    return Record(headers, payload, length, digest)


def read_archive(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[Record]:
    """Records of an archive, decoded frame by frame in bounded memory."""
    data = stream.read(chunk)
    dictionary = None
    if data[:4] == struct.pack("<I", DICTIONARY_MAGIC):
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size and (more := stream.read(chunk)):
            data += more
        raw, data = data[8 : 8 + size], data[8 + size :]
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(chunk)):
        frame, parts = decoder.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a frame")
        yield parse_record(b"".join(parts))


def with_references(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to), the last for rows that revisit another."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
        (F.octet_length(html) >= REVISIT_BYTES).alias("long"),
    )
    first = (
        rows.where("long")
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", F.when(other, F.col("first")).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (page_id, url, html, refers_to); (path, records) of each archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        counts: list[int] = []
        writer = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for page_id, url, html, refers_to in zip(*columns, strict=True):
                if writer is None or writer.bytes >= ARCHIVE_BYTES:
                    if writer:
                        writer.close()
                    paths.append(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                    counts.append(0)
                    writer = ArchiveWriter(paths[-1])
                payload = (html.as_py() or "").encode()
                writer.add(record_bytes(page_id.as_py(), url.as_py(), payload, refers_to.as_py()))
                counts[-1] += 1
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"]
        )

    return records.select("page_id", "url", "html", "refers_to").mapInArrow(
        write, "path string, records long"
    )


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of ``archives`` (path, records); a wrong number of records is an error."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(path: str, expected: int) -> Iterator[tuple]:
        where, name = fs.FileSystem.from_uri(path)
        n = 0
        with where.open_input_stream(name, compression=None) as stream:
            for n, r in enumerate(read_archive(stream), 1):
                kind, url = r.headers["WARC-Type"], r.headers.get("WARC-Target-URI")
                row = (r.page_id, url, kind, r.payload_bytes, r.digest, r.refers_to)
                yield (*row, r.payload.decode()) if with_payload else row
        if n != expected:
            raise ValueError(f"{path} holds {n} records, not {expected}")

    all_names = [*names, "payload"] if with_payload else names
    all_types = [*types, pa.string()] if with_payload else types

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        arrays = [pa.array(c, t) for c, t in zip(columns, all_types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, all_names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path"), batch.column("records"), strict=True):
                held: list[tuple] = []
                size = 0
                for row in rows(path.as_py(), expected.as_py()):
                    held.append(row)
                    size += len(row[-1]) if with_payload else 200
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    schema = (
        "page_id long, url string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long" + ", payload string" * with_payload
    )
    return archives.select("path", "records").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; the table of finished archives."""
    folder = folder or new_folder(pages.sparkSession)
    return settle(write_archives(with_references(pages), folder))
