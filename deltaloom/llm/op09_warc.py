"""WARC archives: a writer that stores equal payloads once, and a salvage reader.

Each record is a gzip member of its own.  Writing uses Spark's text sink, so it reaches any file system that Spark
does: a value is a member without its last byte, and the sink's separator is that byte.  It is the top byte of the
record's length, so zero for records below 16 MB; after larger ones an empty member follows, which ends in zero.
Reading uses binaryFile and scans bytes:
when a check fails (gzip member, header, length, closing bytes, digest), the reader looks for the next gzip
member or version line, goes on there, and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm.common import stage, with_position

MIN_REVISIT = 100
#: Bytes of the records of an archive, before they are compressed: about, and at most unless a single record has more.
FILE_BYTES, MOST_BYTES = 16 << 20, 1 << 30
#: Records are written by classes of size, each with its own number of records for an archive.
CLASSES = (1 << 16, 1 << 24, 1 << 31)
CHUNK = 1 << 14
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1."
MEMBER = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with _uid, payload_bytes, payload_digest, record_type and refers_to.

    Among equal payloads of at least min_revisit bytes the row with the smallest page_id is the response (of
    repeated rows the first), the others revisit it.  Null html: empty payload.  A group without any page_id
    consists of responses.  Only digests and ids are shuffled to find the groups.
    """
    held = stage(with_position(pages.select(
        "page_id", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("payload_bytes"),
        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload_digest")), "_uid"), "op9-digests")
    first = (
        held.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "_uid"))).alias("one"))
        .where("n > 1 and one is not null").select("payload_digest", F.col("one.page_id").alias("_to"), F.col("one._uid").alias("_first"))
    )
    joined = held.join(first, "payload_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("_uid"))
    return joined.select(
        "page_id", "_uid", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_to")).alias("refers_to"))


def _clean(col):
    """A header value on one line."""
    return F.regexp_replace(col.cast("string"), r"[\x00-\x1F\x7F]", " ")


def member(record: bytes) -> bytes:
    """A gzip member, or two of which the second is empty, that ends in a zero byte."""
    zipped = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = zipped.compress(record) + zipped.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            made = [member(x.as_buffer()).removesuffix(b"\0") if x.is_valid else b"" for x in b.column(0).slice(at, 256)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives below path and returns the plan of the records.

    page_id has to be an integer.  The payload moves at most once, to meet its row of the plan; where page_id is unique
    only revisits are asked.  Archives have about file_bytes; as the records of one have at most the size of their class,
    none is over MOST_BYTES but by a single record.
    """
    plan = stage(plan_records(pages, min_revisit), "op9-plan")
    size = lambda body: body + F.coalesce(F.octet_length("url"), F.lit(0)) + 600
    kind_of = lambda n: F.when(n <= CLASSES[0], 0).when(n <= CLASSES[1], 1).otherwise(2)
    sizes = pages.select(size(F.coalesce(F.octet_length("html"), F.lit(0))).cast("long").alias("n"))
    there = sizes.groupBy(kind_of(F.col("n")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("b")).collect()  # at most 3 rows
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    # a revisit is told apart by (page_id, digest); repeated rows: as many revisits as the plan has
    revisits = plan.where("record_type = 'revisit'").groupBy("page_id", "payload_digest").agg(
        F.count(F.lit(1)).alias("_revisits"), F.max("refers_to").alias("refers_to"))
    rows = pages.select("page_id", "url", html.alias("html"), digest.alias("payload_digest"))
    joined = rows.join(
        revisits.withColumnRenamed("page_id", "_id").withColumnRenamed("payload_digest", "_digest"),
        F.expr("page_id <=> _id and payload_digest = _digest"), "left").drop("_id", "_digest")
    repeated = plan.groupBy("page_id", "payload_digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    if not repeated.isEmpty():  # number repeated rows: the first is the response where the plan keeps one
        w = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy(F.lit(1)))
        copies = F.count(F.lit(1)).over(Window.partitionBy("page_id", "payload_digest"))
        joined = joined.withColumn("_k", w).withColumn("_c", copies)
        again = F.col("_revisits").isNotNull() & (F.col("_k") > F.col("_c") - F.col("_revisits"))
    else:
        again = F.col("_revisits").isNotNull()
    kind = F.when(again, "revisit").otherwise("response")
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"),
        F.coalesce(line("WARC-Record-ID", urn(F.col("page_id"))), F.lit("")),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(
            line("WARC-Refers-To", urn(F.col("refers_to"))), F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
            line("WARC-Payload-Length", F.octet_length("html").cast("string")))).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.when(again, "0").otherwise(F.octet_length("html").cast("string")), F.lit("\r\n\r\n"),
        F.when(again, "").otherwise(F.col("html")), F.lit("\r\n\r\n"))
    for k, n, total in there:
        per_file = max(1, min(file_bytes * n // max(1, total), MOST_BYTES // CLASSES[k]))
        mine = joined.where(kind_of(size(F.octet_length("html"))) == k)
        zipped = mine.select(record.alias("value")).mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
        zipped.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)
    if not there:
        joined.select(record.alias("value")).limit(0).write.text(path)
    return plan


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


@dataclass
class Salvage:
    """Records and gaps of one archive's bytes, in order."""

    data: bytes
    records: list[Record] = field(default_factory=list)
    gaps: list[Gap] = field(default_factory=list)

    def run(self) -> "Salvage":
        data, at, bad, why = self.data, 0, None, ""
        while at < len(data):
            found: tuple[list[Record], int] | None = None
            if data.startswith(MEMBER, at):
                found, reason = self._member(at)
            elif data.startswith(VERSION, at):
                found, reason = record_at(data, at)
            else:
                reason = "no member or version line"
            if found:
                if bad is not None:
                    self.gaps.append(Gap(bad, at - bad, why))
                    bad = None
                self.records += found[0]
                at = found[1]
            else:
                if bad is None:
                    bad, why = at, reason
                at = next_start(data, at + 1)
        if bad is not None:
            self.gaps.append(Gap(bad, len(data) - bad, why))
        return self

    def _member(self, at: int) -> tuple[tuple[list[Record], int] | None, str]:
        """The records of a member whose check sum zlib found right; bytes of it that are no record are logged as a
        gap of the whole member."""
        unzip, to, parts = zlib.decompressobj(31), at, []
        try:
            while not unzip.eof and to < len(self.data):
                parts.append(unzip.decompress(memoryview(self.data)[to:to + CHUNK]))
                to = min(to + CHUNK, len(self.data))
        except zlib.error:
            return None, "broken member"
        if not unzip.eof:
            return None, "cut member"
        plain, end, inside, out, lost = b"".join(parts), to - len(unzip.unused_data), 0, [], ""
        while inside < len(plain):
            found, reason = record_at(plain, inside)
            if found:
                out += [Record(at, r.headers, r.block) for r in found[0]]
                inside = found[1]
            else:
                lost = lost or f"{reason}, inside a member"
                after = plain.find(b"\n" + VERSION, inside)
                inside = after + 1 if after >= 0 else len(plain)
        if lost and not out:
            return None, lost
        if lost:
            self.gaps.append(Gap(at, end - at, lost))
        return (out, end), ""


def next_start(data: bytes, at: int) -> int:
    """The next place that may begin a member, or a version line at the start of a line; else the end."""
    member = data.find(MEMBER, at)
    version = data.find(b"\n" + VERSION, max(0, at - 1))
    return min([x for x in (member, version + 1 if version >= 0 else -1) if x >= at], default=len(data))


def record_at(data: bytes, at: int) -> tuple[tuple[list[Record], int] | None, str]:
    """One record and its end, or the reason why there is none."""
    # a header has any length, but ends before the next version line
    after = data.find(b"\n" + VERSION, at)
    top = data.find(b"\r\n\r\n", at, after if after >= 0 else len(data))
    if top < 0:
        return None, "no end of header"
    lines = data[at:top].split(b"\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "bad header line"
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, "no length"
    begin, end = top + 4, top + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None, "cut or wrong length"
    block = data[begin:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        return None, "wrong digest"
    return ([Record(at, headers, block)], end + 4), ""


_SCHEMA = ("kind string, path string, position bigint, bytes bigint, reason string, page_id bigint, url string, "
           "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def _page(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of kind 'record' and 'gap' of all archives below path.

    An archive is read as one value, so archives have to be below 2 GB, which `write` sees to.
    payloads: with the payload of responses.  An empty folder gives an empty relation.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for i in range(b.num_rows):
                name, got = b.column(0)[i].as_py(), Salvage(b.column(1)[i].as_py()).run()
                rows: list[tuple] = []
                for r in got.records:
                    h, kind = r.headers, r.headers.get("warc-type")
                    size = int(h["warc-payload-length"]) if kind == "revisit" and h.get("warc-payload-length", "").isdigit() else len(r.block)
                    rows.append((
                        "record", name, r.offset, len(r.block), None, _page(h.get("warc-record-id")), h.get("warc-target-uri"), size,
                        h.get("warc-payload-digest", "").removeprefix("sha256:") or hashlib.sha256(r.block).hexdigest(), kind,
                        _page(h.get("warc-refers-to")), r.block if payloads else None))
                rows += [("gap", name, g.offset, g.length, g.reason, *[None] * 7) for g in got.gaps]
                for k in range(0, len(rows), 4096):
                    columns = list(zip(*rows[k:k + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return files.mapInArrow(run, _SCHEMA)
