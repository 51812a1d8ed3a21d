"""WARC archives compressed with Zstandard and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; each record is one frame
of its own.  The reader takes the dictionary from that frame, decodes one frame at a time,
so memory is bounded by a record, and checks version line, headers, lengths and digests of each record.

Each task writes archives of its own to the shared folder, under names that no other attempt
uses, and returns a manifest row for each; the manifest is written down before it is read, so
files of attempts that were lost are never read.

Defined results: a null html has an empty payload, a null url an empty target; a null page_id is
written as ``-`` and read back as null; repeated rows are records each, and of
equal payloads all rows with the largest page_id are responses; null ids come after all others
and are responses only if all are null.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import checkpoint, shared_dir, table

# fixed values of the formats
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
READ_TASKS = 20_000  # at most, for the archives to be read
LEAST_BYTES = 1000  # of a payload that may be revisited
ARCHIVE_BYTES = 64 << 20  # of records before compression, after which the next archive begins
SAMPLE_PAGES, DICTIONARY_BYTES = 400, 32 << 10


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header only."""
    name = lambda x: f"<urn:page:{'-' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", " ".join(url.split()))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record; ValueError names what is wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION or not mark:
        raise ValueError("no WARC/1.1 header")
    fields = _fields(lines[1:])
    for name in REQUIRED:
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size}, but {len(rest) - 4} bytes")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    if not mark or not http.startswith(b"HTTP/1.1 "):
        raise ValueError("no HTTP header")
    inner = _fields(http.split(b"\r\n")[1:])
    if fields["WARC-Type"] == "response":
        if int(inner["Content-Length"]) != len(payload):
            raise ValueError("payload length differs")
        if "sha1:" + hashlib.sha1(payload).hexdigest() != fields.get("WARC-Payload-Digest"):
            raise ValueError("payload digest differs")
    elif fields["WARC-Type"] == "revisit":
        if payload or "WARC-Refers-To" not in fields:
            raise ValueError("a revisit has a payload or refers to nothing")
    else:
        raise ValueError(f"unknown type {fields['WARC-Type']}")
    return fields, inner, payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, mark, value = line.decode("utf-8", "surrogatepass").partition(": ")
        if not mark:
            raise ValueError(f"bad header line {name!r}")
        out[name] = value
    return out


def frames(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one frame at a time."""
    import zstandard

    lead = stream.read(8)
    if len(lead) < 8 or struct.unpack("<I", lead[:4])[0] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    length = struct.unpack("<I", lead[4:])[0]
    words = stream.read(length)
    if len(words) != length:
        raise ValueError("the dictionary frame is cut short")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    buffer = stream.read(size)
    while buffer:
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(buffer))
            if one.eof:
                buffer = one.unused_data or stream.read(size)
                break
            buffer = stream.read(size)
            if not buffer:
                raise ValueError("the last frame is cut short")
        yield b"".join(parts)


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of at most SAMPLE_PAGES pages; empty if they are too few."""
    import zstandard

    sample = pages.where("html is not null").select(F.substring("html", 1, 20000).alias("html")).limit(SAMPLE_PAGES).toPandas()["html"]
    texts = [record("response", k, "http://example.org/", t.encode("utf-8", "surrogatepass"), "0" * 40, None) for k, t in enumerate(sample)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.select("page_id", "url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), (F.octet_length("html") >= LEAST_BYTES).alias("large"))
    groups = pages.where("large").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").select("digest", "largest")
    joined = pages.join(groups, "digest", "left")
    revisit = F.col("large") & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(typed: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes the records; returns the manifest (path, n_records), written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        out, path, count, size = None, "", 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, kind, refers = (c[row].as_py() for c in batch.columns)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, count, size = files.open_output_stream(path), 0, 0
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                raw = record(kind, page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(packer.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})

    return checkpoint(map_arrow(typed, run, "path string, n_records long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records; the payload of a revisit is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )

        def number(urn: str | None) -> int | None:
            text = (urn or "-").removeprefix("<urn:page:").removesuffix(">")
            return None if text == "-" else int(text)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, rows, size = 0, [], 0
                with files.open_input_stream(path) as stream:
                    for raw in frames(stream):
                        try:
                            fields, inner, payload = parse(raw)
                        except ValueError as e:
                            raise ValueError(f"{path}, record {seen}: {e}") from e
                        kind = fields["WARC-Type"]
                        rows.append(
                            (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if kind == "response" else None, int(inner["Content-Length"]),
                             fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(fields.get("WARC-Refers-To")))
                        )
                        seen, size = seen + 1, size + len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{path}: {seen} records, the manifest has {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spread = manifest.repartition(max(1, min(manifest.count(), READ_TASKS)))  # a number, so that small rows are not put together into one task
    return map_arrow(spread, run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(with_types(pages), folder, train_dictionary(pages))
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""

QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": SQL}
