"""WARC: the written files against an independent reader, the read rows against
brute force, pushed filters against Spark's own, and damaged or foreign files."""

import glob
import gzip
import hashlib
import os
import random
import re
import uuid
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm import warc

PAGES = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()),
                    StructField("payload", StringType()), StructField("record_type", StringType())])


def odd_pages():
    long = "<p>" + "x y " * 400 + "</p>"
    rows = [(i, f"http://h{i % 3}.org/{i}", long if i % 3 == 0 else f"{i} " * (i * 20), "extra", None) for i in range(60)]
    rows += [(None, None, long, "a", "b"), (None, "http://n.org/", "short", None, None), (7, None, None, None, None),
             (8, "http://e.org/\r\nWARC-Type: metadata", "", None, None), (5, "http://u.org/", "é" * 499 + "abc", None, None),
             (6, "http://u.org/", "é" * 499 + "abc", None, None), (9, "u", "é" * 499 + "a", None, None),
             (11, "ß/ü", "z" * 3_000_000, None, None), (12, "", "z" * 3_000_000, None, None)]
    rows += [(100, "http://same.org/", "same " * 300, None, None)] * 5 + [(100, "http://t.org/", "same " * 300, None, None)]
    rows += [(13, "http://w.org/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50, None, None)]
    return rows


def want(rows):
    """(page_id, bytes, digest, type, refers_to) by plain groups."""
    out, groups = [], {}
    for r in rows:
        data = (r[2] or "").encode()
        if len(data) < 1000:
            out.append((r[0], len(data), hashlib.sha1(data).hexdigest(), "response", None))
        else:
            groups.setdefault(data, []).append(r[0])
    for data, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i))
        ids.remove(top)
        digest = hashlib.sha1(data).hexdigest()
        out.append((top, len(data), digest, "response", None))
        out += [(i, len(data), digest, "revisit", top) for i in ids]
    return sorted(out, key=repr)


def got(spark, folder):
    rows = warc.pages_of(spark, folder).collect()
    return sorted(((None if r[0] is None else int(r[0]), r[1], r[2], r[3], None if r[4] is None else int(r[4]))
                   for r in rows), key=repr)


def plain_records(data):
    """An own, strict reader of inflated WARC bytes."""
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        yield fields, data[:n]
        assert data[n:n + 4] == b"\r\n\r\n"
        data = data[n + 4:]


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES).repartition(5)
    return warc.archive(pages, max_file_bytes=20_000)


def test_rows_equal_brute_force(spark, archive):
    assert got(spark, archive) == want(odd_pages())


def test_files_are_valid_for_other_readers(archive):
    folder = archive.removeprefix("file:")
    files = glob.glob(os.path.join(folder, "*.warc.gz"))
    assert len(files) > 3
    ids, responses, refers = [], {}, []
    for name in files:
        with gzip.open(name) as f:            # checks every member's CRC and length
            found = list(plain_records(f.read()))
        assert found[0][0]["WARC-Type"] == "warcinfo"
        for fields, block in found:
            ids.append(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "warcinfo":
                continue
            assert re.fullmatch("sha1:[A-Z2-7]{32}", fields["WARC-Payload-Digest"])
            head, _, body = block.partition(b"\r\n\r\n")
            length = int(re.search(rb"Content-Length: (\d+)", head)[1])
            if fields["WARC-Type"] == "response":
                assert length == len(body)
                responses[fields["WARC-Record-ID"]] = fields["WARC-Payload-Digest"]
            else:
                assert body == b"" and fields["WARC-Profile"] == warc.REVISIT_PROFILE
                refers.append((fields["WARC-Refers-To"], fields["WARC-Payload-Digest"]))
    assert len(set(ids)) == len(ids)
    assert refers and all(responses[r] == digest for r, digest in refers)


@pytest.mark.parametrize("test", [
    "record_type = 'revisit'", "record_type IN ('response', 'metadata')", "record_type <> 'response'",
    "refers_to IS NULL", "refers_to IS NOT NULL AND target_uri LIKE 'http://h1%'", "target_uri LIKE '%org/'",
    "target_uri LIKE '%u.or%'", "content_length >= 2000", "content_length < 300 AND record_type = 'response'",
    "target_uri <=> NULL", "NOT (target_uri = 'http://u.org/')", "payload_sha1 > '8'",
    "record_type = 'response' OR content_length > 5000"])
def test_pushed_filters_equal_sparks(spark, archive, test):
    columns = ("record_type", "target_uri", "refers_to", "payload_sha1", "content_length", "payload_bytes", "payload")
    pushed = warc.read_archive(spark, archive, *columns).where(test)
    whole = spark.createDataFrame(warc.read_archive(spark, archive, *columns).collect(), pushed.schema).where(test)
    assert sorted(pushed.collect(), key=repr) == sorted(whole.collect(), key=repr)


def test_filters_reach_the_reader():
    from pyspark.sql import datasource as ds

    reader = warc.WarcReader(StructType([StructField("payload_bytes", LongType())]), {"path": "/x"})
    kept = [ds.EqualTo(("record_type",), "response"), ds.Not(ds.IsNull(("target_uri",)))]
    left = [ds.GreaterThan(("payload_bytes",), 3), ds.EqualTo(("headers", "a"), "b")]
    assert list(reader.pushFilters(kept + left)) == left and reader.filters == kept


def test_unwanted_payloads_are_not_inflated(spark, tmp_dir):
    big = random.Random(3).randbytes(200_000).hex().encode()
    a = warc.member(warc.record_bytes("response", "urn:page:1:a", warc.DATE, "http://a.org/", payload=big))
    b = warc.member(warc.record_bytes("response", "urn:page:2:b", warc.DATE, "http://b.org/", payload=b"fine"))
    broken = a[:100_000] + b"\xff" * 1000 + a[101_000:]
    with open(os.path.join(tmp_dir, "x.warc.gz"), "wb") as f:
        f.write(broken + b)
    rows = warc.read_archive(spark, tmp_dir, "target_uri", "payload").where("target_uri = 'http://b.org/'").collect()
    assert [(r[0], bytes(r[1])) for r in rows] == [("http://b.org/", b"fine")]
    heads = warc.read_archive(spark, tmp_dir, "record_id", "content_length", "payload_bytes").collect()
    assert [(r[0], r[2]) for r in heads] == [("urn:page:1:a", 400_000), ("urn:page:2:b", 4)]
    with pytest.raises(Exception, match="gzip member at 0"):
        warc.read_archive(spark, tmp_dir, "payload").collect()


def foreign():
    block = b"HTTP/1.0 200 OK\r\nX-A: 1\r\n\r\nbody one"
    return [b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://f.org/\r\n a\r\n"
            b"Content-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: text/plain\r\n"
            b"WARC-Payload-Digest: md5:abc\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]


@pytest.mark.parametrize("name,pack", [("p.warc", b"".join), ("m.warc.gz", lambda r: b"".join(map(gzip.compress, r))),
                                       ("one.warc.gz", lambda r: gzip.compress(b"".join(r)))])
def test_foreign_files(spark, tmp_dir, name, pack):
    with open(os.path.join(tmp_dir, name), "wb") as f:
        f.write(pack(foreign()))
    df = warc.read_archive(spark, tmp_dir)
    rows = {r.record_id: r for r in df.collect()}
    assert bytes(rows["urn:uuid:1"].payload) == b"body one" and rows["urn:uuid:1"].target_uri == "http://f.org/ a"
    assert bytes(rows["urn:uuid:2"].payload) == b"a\r\n\r\n" and rows["urn:uuid:2"].payload_sha1 is None
    assert bytes(rows["urn:uuid:3"].payload) == b"" and rows["urn:uuid:3"].headers["warc-type"] == "metadata"
    assert [r.record_id for r in df.where("record_type = 'metadata'").select("record_id").collect()] == ["urn:uuid:3"]


@pytest.mark.parametrize("cut", [10, 150, -3])
def test_cut_off_files_are_errors(spark, tmp_dir, cut):
    whole = warc.record_bytes("response", "urn:page:1:a", warc.DATE, payload=b"x" * 100)
    with open(os.path.join(tmp_dir, "c.warc"), "wb") as f:
        f.write(whole[:cut])
    with pytest.raises(Exception, match="c.warc"):
        warc.read_archive(spark, tmp_dir, "payload").collect()


def test_files_of_no_commit_are_not_read(spark, tmp_dir):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    folder = warc.archive(pages, os.path.join(tmp_dir, "a"))
    with open(os.path.join(folder, "part-000000-9-lost-0.warc.gz"), "wb") as f:
        f.write(b"half a record of a lost attempt")
    assert got(spark, folder) == want([(1, "u", "x")])
    warc.archive(pages.withColumn("page_id", F.lit(2)), folder)       # appended by a second job
    assert [r[0] for r in got(spark, folder)] == [1, 2]


def test_empty_table_and_partitions(spark, tmp_dir):
    empty = spark.createDataFrame([], PAGES)
    folder = warc.archive(empty, os.path.join(tmp_dir, "e"))
    assert got(spark, folder) == []
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    folder = warc.archive(pages.repartition(8), os.path.join(tmp_dir, "f"))
    warc.register(spark)
    few = spark.read.format("warc").option("partition_bytes", "1").load(folder)
    assert few.rdd.getNumPartitions() == 8 and few.where("record_type = 'response'").count() == 40


def test_many_equal_rows_are_dealt(spark):
    one = spark.createDataFrame([("d", 1, 5)], "payload_sha1 string, __id int, n int")
    assert warc._copies(one, F.lit(10_000)).count() == 10_000
    assert warc._copies(one, F.lit(0)).count() == 0


def test_members_hold_their_length():
    raw = uuid.uuid4().bytes * 100
    got = warc.member(raw)
    assert gzip.decompress(got) == raw and int.from_bytes(got[16:20], "little") == len(got)
    assert zlib.decompressobj(31).decompress(got + b"rest") == raw
