"""WARC archives with a Zstandard dictionary of their own: one frame per record, equal payloads as revisits."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halfseen.llm.common import handover, query, shared_path, table

#: Fixed values of the formats: skippable frame that holds the dictionary, revisit profile, versions.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"

DICTIONARY_BYTES = 65_536      # size of an archive's dictionary
SAMPLE_BYTES = 4_000_000       # an archive's first records, up to so many bytes, are what it is built from
ARCHIVE_BYTES = 1_000_000_000  # an archive is closed after so many bytes before compression
LEAST_SHARED = 100             # payloads of fewer bytes are stored each


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def field(name: str, value) -> bytes:
    """A header line; characters that would end it are percent-encoded."""
    text = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {text}\r\n".encode()


def record(kind: str, ident: str, date: str, fields: list[tuple[str, object]], block: bytes, block_type: str) -> bytes:
    head = VERSION + field("WARC-Type", kind) + field("WARC-Record-ID", f"<{ident}>") + field("WARC-Date", date)
    head += b"".join(field(n, v) for n, v in fields if v is not None)
    return head + field("Content-Type", block_type) + field("Content-Length", len(block)) + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """response with its payload, or revisit of the page that holds an equal one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id)]
    ident = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    if refers_to is None:
        return record("response", ident, date, fields, http + payload, "application/http; msgtype=response")
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Payload-Length", len(payload))]
    return record("revisit", ident, date, fields, http, "application/http; msgtype=response")


class Archive:
    """One file: dictionary frame, warcinfo, records, each in a frame of its own."""

    def __init__(self, uri: str, samples: list[bytes], date: str):
        self.uri, self.records, self.raw, self.stored = uri, 0, 0, 0
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path, compression=None)
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:      # too few or too small records to build one from
            trained = None
        if trained is not None:
            data = trained.as_bytes()
            self.put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.zstd = zstandard.ZstdCompressor(level=6, dict_data=trained, write_content_size=True)
        self.put(self.zstd.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, [], b"format: WARC File Format 1.1\r\n",
                                           "application/warc-fields")))

    def put(self, data: bytes) -> None:
        self.stored += self.out.write(data)

    def add(self, rec: bytes) -> None:
        self.put(self.zstd.compress(rec))
        self.records += 1
        self.raw += len(rec)

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        return self.uri, self.records, self.raw, self.stored


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows (page_id, url, html) as archives below `folder`; returns (archive, records, raw_bytes, stored_bytes).

    Of equal payloads of LEAST_SHARED bytes or more the smallest page_id is the response and
    the others are revisits. Tasks write files of their own under fresh names and only
    what a successful task reports is in the result, so a retried task leaves at most a
    file that nobody names. Memory is bounded by SAMPLE_BYTES and one record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy(F.col("digest").alias("d"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1 and first is not null").select("d", "first"))
    linked = rows.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    names = ["archive", "records", "raw_bytes", "stored_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    for r in batch.slice(lo, 256).to_pylist():
                        yield page_record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"], date)

        def report(archive):
            return pa.RecordBatch.from_pylist([dict(zip(names, archive.close()))])

        held, size, archive = [], 0, None
        for rec in records():
            if archive is None:
                held.append(rec)
                size += len(rec)
                if size < SAMPLE_BYTES:
                    continue
                archive, rec = start(held), None
            if rec is not None:
                archive.add(rec)
            if archive.raw >= archive_bytes:
                yield report(archive)
                held, size, archive = [], 0, None
        if archive is None and held:
            archive = start(held)
        if archive is not None:
            yield report(archive)

    def start(held: list[bytes]) -> Archive:
        archive = Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst", held, date)
        for rec in held:
            archive.add(rec)
        held.clear()
        return archive

    return handover(linked.mapInArrow(run, "archive string, records long, raw_bytes long, stored_bytes long"))


def open_archive(uri: str):
    """Decompressed bytes of an archive as a stream; its dictionary is read from the leading frame."""
    fs, path = filesystem(uri)
    f = fs.open_input_stream(path, compression=None)
    magic, length = struct.unpack("<II", f.read(8))
    if magic == DICTIONARY_FRAME:
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(length))).stream_reader(f, read_across_frames=True)
    f.close()
    return zstandard.ZstdDecompressor().stream_reader(fs.open_input_stream(path, compression=None), read_across_frames=True)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record."""
    import io
    buffered = io.BufferedReader(stream, 1 << 20)
    while True:
        line = buffered.readline()
        if not line:
            return
        if line != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := buffered.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = buffered.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or buffered.read(4) != b"\r\n\r\n":
            raise ValueError("truncated record")
        yield fields, block


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Page records of the archives: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response whose payload does not match its digest fails the job.
    """
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                out, size = [], 0
                for fields, block in records(open_archive(uri)):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    page = int(fields["page-id"]) if "page-id" in fields else None
                    payload, refers, length = None, None, 0
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of page {page} does not match its digest")
                    else:
                        refers, length = int(fields["warc-refers-to"].strip("<>").rpartition(":")[2]), int(fields["payload-length"])
                    out.append((page, fields.get("warc-target-uri"), payload, length, digest, kind, refers))
                    size += len(block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    files = archives.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism), "archive")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives and read them back; one row per page.

    Null html is an empty payload. A null url leaves out the target. A page without id is
    a response or revisit like others but is never referred to, so equal payloads of
    which none has an id are all responses. Repeated rows with the smallest id are all
    responses. Line breaks in a url come back percent-encoded. Other columns are not
    archived. An empty table writes no archive.
    """
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, folder or shared_path(spark, "warc")))


@query("op1_warc_dictionary", """
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))""")
def op1_warc_dictionary(spark, d):
    return round_trip(table(spark, d, "pages")).drop("url", "payload")
