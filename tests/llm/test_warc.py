"""Archives of pages: round trips, shared payloads, selected reads, the format."""

import gzip
import hashlib
import random
import uuid

import pyarrow as pa
import pytest
from oracle import compare, open_tables
from pyspark.sql import functions as F

from gridmat.llm import queries, warc

LONG = "<p>" + "long enough to be shared, ünïcode too. " * 40


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", LONG), (2, "http://a/2", LONG), (7, "http://a/7", LONG), (None, None, LONG),
        (3, "http://a/ 3\r\nX: y", "short"), (4, "http://a/4", "short"), (5, None, None), (6, "http://a/6", ""), (6, "http://a/6", ""),
        (8, "http://a/8", LONG + "b"), (8, "http://a/8", LONG + "b"), (8, "http://a/9", LONG + "b"),
        (None, None, "WARC/1.0\r\n\r\n" + LONG), (9, "http://a/9", "x" * 3_000_000), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 1000), (13, "", "y" * 1000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for i, name in enumerate(("digest", "size", "payload", "part", "_n", "path", "shared")):
        df = df.withColumn(name, F.lit(i))
    return df.repartition(3).cache()


def _plain(rows):
    groups, out = {}, []
    for r in rows:
        raw = (r.html or "").encode()
        groups.setdefault(raw, []).append(r.page_id)
    for raw, ids in groups.items():
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        for k, i in enumerate(ids):
            again = len(raw) >= 1000 and k > 0
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def test_every_page_comes_back(spark, pages):
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=repr)
    assert got == _plain(pages.collect())


def test_hot_payloads_are_dealt_out(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.when(F.col("id") % 3 > 0, F.lit(LONG)).otherwise(F.concat(F.lit(LONG), F.col("id").cast("string"))).alias("html"))
    rows = warc.decided(many, heavy=16, least_heavy=10)
    spread = rows.where("size = " + str(len(LONG.encode()))).withColumn("at", F.spark_partition_id())
    assert spread.select("at").distinct().count() > 4
    assert spread.where("payload is not null").select("page_id").collect() == [(2999,)]
    assert spread.where("payload is null and refers_to = 2999").count() == 1999
    assert rows.where("payload is not null").count() == 1001


def test_selected_records_with_payload(spark, pages):
    index = warc.write(pages)
    assert index.count() == pages.count()
    chosen = index.where("page_id in (3, 7, 2, 9)")
    got = {r.page_id: r for r in warc.read(chosen).collect()}
    assert {k: r.payload for k, r in got.items()} == {3: "short", 7: LONG, 2: None, 9: "x" * 3_000_000}
    assert (got[2].record_type, got[2].refers_to, got[2].payload_digest) == ("revisit", 7, got[7].payload_digest)
    assert {r.url for r in index.where("page_id = 3").collect()} == {"http://a/ 3\r\nX: y"}
    # A byte changed on the way is noticed.
    moved = chosen.withColumn("offset", F.col("offset") + 1)
    with pytest.raises(Exception, match="(?i)error|header check"):
        warc.read(moved).collect()


def test_archives_are_plain_warc(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "out"), file_bytes=2000).collect()
    assert len({r.path for r in index}) > 3
    seen = 0
    for file in (tmp_path / "out").glob("*.warc.gz"):
        rest, kinds, ids = gzip.decompress(file.read_bytes()), [], set()
        while rest:
            head, _, rest = rest.partition(b"\r\n\r\n")
            fields = warc._fields(head)
            size = int(fields["content-length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            rest = rest[size + 4 :]
            kinds.append(fields["warc-type"])
            ids.add(fields["warc-record-id"])
            assert "x" not in fields
        assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"} and len(ids) == len(kinds)
        seen += len(kinds) - 1
    assert seen == len(index)


def test_ranges_cover_sorted_reads():
    rng = random.Random(4)
    for _ in range(200):
        rows = []
        for path in "ab":
            at = 0
            for _ in range(rng.randrange(20)):
                at += rng.randrange(50)
                length = rng.randint(1, 60)
                rows.append((path, at, length))
                at += length
        got = list(warc.ranges(rows, gap=20, most=100))
        assert [(p, a, n) for p, _, _, held in got for a, n in held] == rows
        for p, lo, hi, held in got:
            assert lo == held[0][0] and hi == max(a + n for a, n in held) and (hi - lo <= 100 or len(held) == 1)
        for (p, _, hi, _), (q, lo, to, _) in zip(got, got[1:]):
            assert p != q or lo - hi > 20 or to - hi > 0


def test_damage_is_noticed():
    raw = warc.record_bytes(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None, uuid.uuid4(), uuid.uuid4())
    pack = lambda x: gzip.compress(x)
    assert warc.parse(pack(raw)).payload == b"payload"
    for bad in (raw.replace(b"payload\r\n", b"paylaod\r\n"), raw[:-4], raw.replace(b"WARC/1.0", b"WARD/1.0")):
        with pytest.raises(ValueError):
            warc.parse(pack(bad))


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert list(warc._read(iter([pa.RecordBatch.from_pydict({"path": [], "offset": [], "length": []})]), True)) == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(queries.op11_index_warc(spark, folder), open_tables(folder), queries.ORACLES["op11_index_warc"]) is None
