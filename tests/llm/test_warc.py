import gzip
import hashlib
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same  # noqa: E402

from tidemark.llm import queries, warc  # noqa: E402


def test_against_sql(spark, small):
    assert len(same(spark, "op7_warc", queries.queries(), queries.oracle_sql(), small))


def test_cases(spark):
    long, other = "é" * 600, "<p>\r\n\r\n</p>" * 200
    df = spark.createDataFrame(
        [(1, "http://a/ü b", long), (5, None, long), (3, "u", long), (4, "x\r\ny", None), (6, "", ""), (7, "u", other), (7, "u", other), (None, "u", other), (9, "u", "same"), (8, "u", "same")],
        "page_id long, url string, html string",
    ).selectExpr("*", "1 AS file", "2 AS digest")
    index = warc.write(df)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=repr)
    want = [
        (1, 1200, "revisit", 5), (5, 1200, "response", None), (3, 1200, "revisit", 5), (4, 0, "response", None), (6, 0, "response", None),
        (7, 2200, "response", None), (7, 2200, "response", None), (None, 2200, "revisit", 7), (9, 4, "response", None), (8, 4, "response", None),
    ]
    assert got == sorted(want, key=repr)
    some = {r.page_id: r for r in warc.read(index.where("page_id IN (1, 5)"), with_payload=True).collect()}
    assert bytes(some[5].payload).decode() == long and some[1].payload is None
    assert some[1].payload_digest == some[5].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    one = index.where("page_id = 5").first()
    raw = open(one.file.removeprefix("file:"), "rb").read()[one.offset : one.offset + one.length]
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_near_ranges_are_read_together():
    reads = list(warc._coalesced([("a", 0, 10), ("a", 10, 10), ("a", 10**8, 5), ("b", 0, 5)]))
    assert [(f, a, b, len(m)) for f, a, b, m in reads] == [("a", 0, 20, 2), ("a", 10**8, 10**8 + 5, 1), ("b", 0, 5, 1)]


def test_reads_are_spread_and_long_payloads_come_whole(spark):
    long = random.Random(3).randbytes(6 << 20).hex()  # compressed still larger than one read
    df = spark.createDataFrame([(1, "u", long), *[(i, "u", f"{i} " * 900) for i in range(2, 60)]], "page_id long, url string, html string").coalesce(1)
    index = warc.write(df)
    assert index.agg({"length": "max"}).first()[0] > warc.READ_BYTES
    odd = index.select("file", "offset", "length").limit(1).selectExpr("file", "CAST(NULL AS LONG) AS offset", "length")
    wanted = index.select("file", "offset", "length")
    wanted = wanted.unionByName(odd).unionByName(wanted.where("length > 1000000"))
    got = warc.read(wanted)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == [1, *range(1, 60)]
    assert {r.payload_digest for r in rows if r.page_id == 1} == {hashlib.sha1(long.encode()).hexdigest()}
    assert warc.read(index.limit(0)).count() == 0
