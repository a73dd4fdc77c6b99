"""WARC archives in Zstandard form: one frame per record, dictionary in a leading frame.

Writing: pages with equal payloads are grouped by digest; the one with the smallest
id is a ``response``, the others are ``revisit`` records that name it. Each task packs
its records into archives of bounded size. An archive begins with a skippable frame
that holds the (compressed) dictionary, trained on a bounded sample of the records at
hand; every record is one frame. Archives are rows of a table in the shared folder.

Reading: the dictionary is loaded from the leading skippable frame, one frame is
decoded per record, and version line, required headers, both lengths, the end of the
record and the digest of a stored payload are validated; a damaged archive raises.

Defined results: a null page is an empty payload; a null url leaves out its header; a
null id comes back as null and only stands for others if its group has no other id;
repeated rows of the smallest id are all responses, of which revisits name one; every record
has an id of its own. Rows are told apart by their place, which has to be the same each time
``pages`` is read, as in a table. Further columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import broadcast_if_bounded, read, whole_text
from gatewarden.session import cut_lineage

#: Fixed values of the format.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

#: Bytes of records in an archive (an archive has one record at least).
ARCHIVE_BYTES = 8_000_000
#: The dictionary is trained on the first records of a task, up to these bounds.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 2_000_000, 16_384
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 0
DATE = "2025-01-01T00:00:00Z"

ARCHIVE = "archive string, records long, content binary"
RECORD = ("page_id long, url string, record_type string, refers_to long, "
          "payload_digest string, payload_bytes long, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None, digest: str, row: int | None = None) -> str:
    """The id of a record; without ``row``, of the one that stands for its payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{row}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE,
           row: int | None = None) -> bytes:
    """The bytes of a record; a revisit keeps the HTTP head, which tells the length of the payload.

    ``row`` tells records of equal ids and payloads apart; the one that revisits name has none.
    """
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id, digest, row)),
            ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or none if the samples are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    def __init__(self, dictionary: zstandard.ZstdCompressionDict | None) -> None:
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes()) if dictionary else b""
        self.lead = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed if dictionary else b""
        self.frames, self.size = [], 0

    def add(self, data: bytes) -> None:
        self.frames.append(self.compressor.compress(data))
        self.size += len(data)

    def take(self) -> tuple[int, bytes]:
        out = len(self.frames), self.lead + b"".join(self.frames)
        self.frames, self.size = [], 0
        return out


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, decoded frame by frame."""
    view, at, dictionary = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise ValueError("the dictionary frame is cut off")
        data = bytes(view[8 : 8 + size])
        data = zstandard.ZstdDecompressor().decompress(data) if data[:4] == ZSTD_MAGIC else data
        dictionary, at = zstandard.ZstdCompressionDict(data), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + 16_384]
            if not chunk:
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(chunk))
            at += len(chunk) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def _fields(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n"))


def parse(data: bytes) -> dict:
    """A validated record as a row."""
    head, split, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if first != VERSION or not split:
        raise ValueError("no WARC record")
    fields = _fields(lines)
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the length of the block is wrong")
    http, split, payload = rest[:length].partition(b"\r\n\r\n")
    stated = int(_fields(http.partition(b"\r\n")[2])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError("the payload is damaged")
    number = lambda k: int(fields[k]) if k in fields else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number("X-Page-ID"), "url": url, "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Page-ID"), "payload_digest": digest, "payload_bytes": stated,
            "payload": payload if fields["WARC-Type"] == "response" else None}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(writer: Writer) -> pa.RecordBatch:
        n, content = writer.take()
        name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
        return pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "content": [content]})

    def records() -> Iterator[bytes]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: batch.column(k)[i].as_py() for k in ("page_id", "url", "html", "refers_to", "row")}
                yield record(x["page_id"], x["url"], x["html"].encode(), x["refers_to"], row=x["row"])

    todo, sample, size = records(), [], 0
    for data in todo:
        sample.append(data)
        size += len(data)
        if len(sample) >= SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    writer = Writer(train(sample)) if sample else None
    for part in (sample, todo):
        for data in part:
            if writer.frames and writer.size + len(data) > ARCHIVE_BYTES:
                yield row(writer)
            writer.add(data)
    if writer and writer.frames:
        yield row(writer)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for data in frames(content.as_py()):
                rows.append(parse(data))
                size += len(data)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """The archives of ``page_id, url, html``, written to the shared folder."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        whole_text("html").alias("html"), F.monotonically_increasing_id().alias("row"))
    digest = F.sha2("html", 256)
    # only payloads that occur again are kept: one row each, however many copies there are
    again = page.where(F.octet_length("html") >= least_revisit).groupBy(digest.alias("of")).agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"),
        F.count("*").alias("copies"),
    ).where("copies > 1").select("of", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    page = page.join(broadcast_if_bounded(again, ("of",)), digest == F.col("of"), "left")
    revisits = F.when((F.col("first_id") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first_id"))
    row = F.when(F.col("first_row").isNull() | (F.col("first_row") != F.col("row")), F.col("row"))
    columns = page.select("page_id", "url", "html", revisits.alias("refers_to"), row.alias("row"))
    return cut_lineage(columns.mapInArrow(_pack, ARCHIVE))


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of ``content``."""
    return archives.select("content").mapInArrow(_unpack, RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLE: dict[str, str] = {}
