import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from wardflow.llm import warc as X


def brute(rows, least=0):
    own = {}
    for i, h in rows:
        own.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        ids = [x for x in own[p] if x is not None]
        first = max(ids) if ids else None
        kind = "response" if i == first or len(p) < least else "revisit"
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), kind, first if kind == "revisit" else None))
    return out


def pages():
    rnd = random.Random(5)
    rows = [(k, "".join(rnd.choice(["\x1f", "\x08", "abc", "ab" * 50]) for _ in range(rnd.choice([0, 3, 400])))) for k in range(200)]
    return rows + [(None, "dup"), (None, None), (7, None), (8, "dup"), (8, "dup"), (300, "z" * 300_000)]


@pytest.mark.parametrize("split,level", [("700", 0), ("3000", 6), ("128m", 0)])
def test_round_trip_over_any_byte_ranges(spark, tmp_path, split, level):
    rows, path = pages(), str(tmp_path / "archive")
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("http://a/\r\nb")).repartition(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        X.write_warc(df, path, level=level)
        read = X.read_warc(spark, path).collect()
        if split != "700":  # a second pass over some thousand ranges takes a minute
            assert X.damaged_members(spark, path).collect() == []
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = sorted(("null" if i is None else str(i), d, kind, n if kind == "response" else 0, None if o is None else str(o)) for i, n, d, kind, o in brute(rows))
    assert sorted((r.record_id, r.payload_digest, r.record_type, len(r.payload), r.refers_to) for r in read) == want
    for r in read:
        if r.record_type == "response":
            assert X.base32_of_hex(hashlib.sha1(bytes(r.payload)).hexdigest()) == r.payload_digest
    for f in os.listdir(path):  # the files are plain concatenations of gzip members
        if f.startswith("part"):
            assert gzip.decompress(open(f"{path}/{f}", "rb").read()).count(b"WARC/1.1\r\n") > 0


def test_small_payloads_and_empty_table(spark, tmp_path):
    rows = [(1, "ab"), (2, "ab"), (3, "abcdef"), (4, "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    X.write_warc(df, str(tmp_path / "a"), least_bytes=3)
    kinds = {r.record_id: r.record_type for r in X.read_warc(spark, str(tmp_path / "a")).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    X.write_warc(df.limit(0), str(tmp_path / "b"))
    assert X.read_warc(spark, str(tmp_path / "b")).collect() == []


def test_large_member_ends_with_the_separator():
    raw = X.member("response", "1", None, None, "A", os.urandom(1 << 24), level=0)
    assert raw[-1] == 0 and len(gzip.decompress(raw)) > 1 << 24


def test_a_length_that_is_no_number_is_no_record():
    from wardflow.llm import warc

    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: "
    assert warc.parse(head + b"x\r\n\r\nabc") is None and warc.parse(head + b"-1\r\n\r\nabc") is None
    assert warc.parse(head + b"2\r\n\r\nabc")[-1] == b"ab" and warc.parse(head + b"\r\n\r\nabc")[-1] == b""


@pytest.mark.parametrize("split", ["300", "5000", "128m"])
def test_damaged_members_are_listed_and_spoil_no_other(spark, tmp_path, split):
    rnd = random.Random(6)
    good = [X.member("response", str(k), None, "http://a/", "D", rnd.randbytes(400)) for k in range(12)]
    flipped = bytearray(good[3])
    flipped[len(flipped) // 2] ^= 0xFF
    other = gzip.compress(b"something else entirely", mtime=0)
    length = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: ten\r\n\r\nabc", mtime=0)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join([*good[:3], bytes(flipped), *good[4:6], other, X.EMPTY_MEMBER, good[6], length, *good[7:9]]))
    (tmp_path / "w" / "b.warc").write_bytes(good[9] + good[10][:150])
    (tmp_path / "w" / "c.warc").write_bytes(good[11])
    (tmp_path / "w" / "d.warc").write_bytes(b"")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = X.read_warc(spark, str(tmp_path / "w")).collect()
        damage = X.damaged_members(spark, str(tmp_path / "w")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(int(r.record_id) for r in records) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 11]
    files = {}
    for r in damage:
        files.setdefault(os.path.basename(r.path), []).append((r.reason, bytes(r.raw)))
    assert set(files) == {"a.warc", "b.warc"}
    assert files["b.warc"] == [(X.TRUNCATED, good[10][:150])]
    lost = [raw for _, raw in files["a.warc"]]
    assert other in lost and length in lost and bytes(flipped) == b"".join(raw for raw in lost if raw not in (other, length))
    assert {reason for reason, raw in files["a.warc"] if raw == length} == {X.NO_RECORD}
