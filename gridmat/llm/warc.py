"""WARC archives of web pages: an index beside the records, and reads of selected byte ranges.

Pages with equal payloads share one record: of those, one is a ``response`` and
the others are ``revisit`` records that name it. Which is which is settled
before anything is written: a window over the pages of one digest. Digests with
a share of all pages are known from a first count (at most ``HEAVY`` of them, a
broadcast of bounded size), are dealt out by page, and leave the payloads that
will not be written behind.

Every task writes its records to archives of its own, each record a gzip
member, and returns one index row a record: path, offset, length, URL, digest
and page id. The index is a table, so only rows of tasks that ended well are in
it; an archive of a lost task is named nowhere and harms nothing.

Readers start from rows of the index, all or some: they are brought together by
archive and sorted by offset, ranges that touch or nearly touch are read at
once, and each record is parsed and checked against its digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmat.llm.common import partitions, release_memory, scratch_path, stored

#: Equal payloads under so many bytes are written again.
LEAST_BYTES = 1000
#: At most so many digests have more than 1 / HEAVY of all pages.
HEAVY = 4096
LEAST_HEAVY = 1000
#: An archive is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Ranges at most so far apart are read as one, up to RANGE_BYTES or one record.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


# ---------------------------------------------------------------- records


class Record(NamedTuple):
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes | None


def _headers(fields: Iterable[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def header_url(url: str | None) -> str | None:
    """A URL as one line of a header: white space and control characters as percent codes."""
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, own_id: uuid.UUID, response_id: uuid.UUID, date: str = DATE) -> bytes:
    """One record; without a payload it revisits ``response_id``. The HTTP header keeps the length of the full payload."""
    block = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + b"\r\n" + (payload or b"")
    revisit = payload is None
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{own_id.urn}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_url(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", _REVISIT if revisit else None),
        ("WARC-Refers-To", f"<{response_id.urn}>" if revisit else None),
        ("Page-ID", page_id),
        ("Page-Refers-To", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return b"WARC/1.0\r\n" + _headers(head) + b"\r\n" + block + _END


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


def parse(member: bytes) -> Record:
    """The record in one gzip member; lengths and digest must agree with its headers."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(_END)
    if not head.startswith(b"WARC/1.0\r\n"):
        raise ValueError("no WARC record at this place")
    named = _fields(head)
    size = int(named["content-length"])
    if rest[size:] != _END:
        raise ValueError(f"record {named['warc-record-id']} is not {size} bytes long")
    http, _, payload = rest[:size].partition(_END)
    length = int(_fields(http)["content-length"])
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(named[k]) if k in named else None
    if named["warc-type"] == "revisit":
        return Record(number("page-id"), length, digest, "revisit", number("page-refers-to"), None)
    if len(payload) != length or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of record {named['warc-record-id']} differs from its header")
    return Record(number("page-id"), length, digest, named["warc-type"], None, payload)


# ---------------------------------------------------------------- writing


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, as tasks reach it without Spark."""
    return (fs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith("file:/") and not uri.startswith("file://") else fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, made a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    return system.makeQualified(where).toString()


class _Archive:
    def __init__(self, folder: str, date: str):
        self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
        self.path = f"{folder}/{self.name}"
        system, path = _filesystem(folder)
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.offset = self.records = 0
        info = b"software: gridmat\r\nformat: WARC File Format 1.0\r\n"
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{self.next_id().urn}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]
        self.add(b"WARC/1.0\r\n" + _headers(head) + b"\r\n" + info + _END)

    def next_id(self) -> uuid.UUID:
        return uuid.uuid5(uuid.NAMESPACE_URL, f"{self.name}#{self.records}")

    def add(self, record: bytes) -> tuple[int, int]:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packed.compress(record) + packed.flush()
        self.out.write(member)
        at, self.offset, self.records = self.offset, self.offset + len(member), self.records + 1
        return at, len(member)


def _written(folder: str, file_bytes: int, date: str):
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(k) for k in ("page_id", "url", "size", "digest", "refers_to", "shared")]
                payloads = batch.column("payload").cast(pa.large_binary())
                for payload, *cells in zip(payloads, *columns, strict=True):
                    page_id, url, size, digest, refers_to, shared = (c.as_py() for c in cells)
                    payload = payload.as_py()
                    if archive is not None and archive.offset >= file_bytes:
                        archive.out.close()
                        archive = None
                    archive = archive or _Archive(folder, date)
                    response_id = uuid.uuid5(uuid.NAMESPACE_URL, f"sha1:{digest}")
                    own_id = response_id if shared and payload is not None else archive.next_id()
                    at, length = archive.add(record_bytes(page_id, url, payload, size, digest, refers_to, own_id, response_id, date))
                    rows.append((archive.path, at, length, url, digest, page_id, "revisit" if payload is None else "response"))
                cells = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("offset", "length", "page_id") else pa.string()) for n, c in zip(names, cells, strict=True)], names=names)
        finally:
            if archive is not None:
                archive.out.close()
        release_memory()

    return run


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES, heavy: int = HEAVY, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """page_id, url, size, digest, refers_to, shared, and the payload of the pages that are to be responses (null: a revisit).

    Of equal payloads the largest page_id is the response, of equal ids the
    largest URL, of rows equal in both any one; nulls come last.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).alias("payload")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload)
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = F.col("size") >= least_bytes
    # Digests with more than 1 / heavy of all pages: fewer than ``heavy`` rows, whatever the table.
    limit = max(pages.count() // heavy, least_heavy)
    known = rows.where(shared).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("page_id", "url")).alias("_top")).where(F.col("_n") > limit)
    known = stored(known, "warc-heavy")
    rows = rows.withColumn("shared", shared).join(F.broadcast(known), "digest", "left")
    top = F.col("page_id").eqNullSafe(F.col("_top.page_id")) & F.col("url").eqNullSafe(F.col("_top.url"))
    often = F.col("_n").isNotNull()
    # Short payloads need no partner; heavy ones know theirs, and all but the top leave their payload here.
    part = F.when(~shared, F.monotonically_increasing_id()).when(often, F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("_n") / F.lit(limit)))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", part).withColumn("payload", F.when(~often | top, F.col("payload"))).withColumn("_is_top", ~often | top)
    group = Window.partitionBy("digest", "part").orderBy(F.col("page_id").desc_nulls_last(), F.col("url").desc_nulls_last())
    dealt = rows.repartition(partitions(pages.sparkSession), "digest", "part").withColumn("_rank", F.row_number().over(group)).withColumn("_first", F.first("page_id").over(group))
    response = ~F.col("shared") | ((F.col("_rank") == 1) & F.col("_is_top"))
    refers_to = F.when(~response, F.when(F.col("_n").isNotNull(), F.col("_top.page_id")).otherwise(F.col("_first")))
    return dealt.select("page_id", "url", "size", "digest", refers_to.alias("refers_to"), "shared", F.when(response, F.col("payload")).alias("payload"))


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Archives of all pages below ``folder`` (a new scratch folder by default), and their index.

    One record a row of pages: a null html is an empty payload, a null URL has
    no header, a null page_id stays null and counts as the smallest, repeated
    rows are records of their own (one of them the response). An empty table
    gives no archive and an empty index. Other columns are not looked at. The
    folder must be one that tasks reach by themselves: local and shared, HDFS or
    an object store.
    """
    spark = pages.sparkSession
    where = _qualified(spark, folder or scratch_path(spark, "warc"))
    return stored(decided(pages, least_bytes).mapInArrow(_written(where, file_bytes, date), INDEX), "warc-index")


# ---------------------------------------------------------------- reading


def ranges(rows: Iterable[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(path, from, to, records) of sorted (path, offset, length): neighbours at most ``gap`` apart make one read of up to ``most`` bytes; a longer record comes alone."""
    path, lo, hi, held = None, 0, 0, []
    for p, at, length in rows:
        if held and p == path and at >= lo and at - hi <= gap and at + length - lo <= most:
            held.append((at, length))
            hi = max(hi, at + length)
            continue
        if held:
            yield path, lo, hi, held
        path, lo, hi, held = p, at, at + length, [(at, length)]
    if held:
        yield path, lo, hi, held


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    opened, source = None, None

    def wanted() -> Iterator[tuple[str, int, int]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)

    for path, lo, hi, held in ranges(wanted()):
        if path != opened:
            if source is not None:
                source.close()
            system, where = _filesystem(path)
            opened, source = path, system.open_input_file(where)
        source.seek(lo)
        data = source.read(hi - lo)
        found = [parse(data[at - lo : at - lo + length]) for at, length in held]
        cells = list(zip(*(r if with_payload else r._replace(payload=None) for r in found), strict=True))
        arrays = [pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]
        where = [pa.array([path] * len(held)), pa.array([at for at, _ in held], pa.int64())]
        yield pa.RecordBatch.from_arrays([*where, *arrays[:-1], arrays[-1].cast(pa.string())], names=["path", "offset", *names])
    if source is not None:
        source.close()
    release_memory()


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that the rows of an index name, any selection of them: path, offset and the columns of RECORD.

    ``payload`` is null for revisits (join ``payload_digest`` with the responses
    to resolve them), or for all where it is not asked for. A record that does
    not agree with its digest fails the job.
    """
    places = index.select("path", "offset", "length")
    sorted_places = places.repartition(partitions(index.sparkSession), "path").sortWithinPartitions("path", "offset")
    return sorted_places.mapInArrow(lambda batches: _read(batches, payload), f"path string, offset long, {RECORD}")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, from the archives written for it and read back by their index."""
    return read(write(pages), payload=False).drop("payload", "path", "offset")


__all__ = ["decided", "parse", "ranges", "read", "record_bytes", "round_trip", "write"]
