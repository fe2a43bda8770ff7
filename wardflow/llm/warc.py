"""WARC archives: one gzip member per record, written by Spark and read back in splits.

Writing: records with equal payloads become one response and revisits of it.
Members are handed to Spark's text writer as raw bytes. A member ends with the
high byte of its size, which is zero (a member of 16 MB or more gets an empty
member behind it), and that byte is the line separator, so a file is exactly
the concatenation of its members.

Reading: Spark cuts files into byte ranges; the text reader's line separator is
the gzip magic, so each task scans its range for the magic and owns what starts
inside. A candidate counts if its decoded start is a WARC header; one that the
magic inside its own data cut short takes the next pieces. Pieces of a member
that the end of a range parted are put together per file in a second, small
step. A member whose data is damaged gives no record and spoils no other;
``damaged_members`` lists what gave none. Archives must not be named ``*.gz``, else Spark's reader inflates them as
one stream before they can be split.
"""

from __future__ import annotations

import base64
import gzip
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import common
from wardflow.llm.common import table

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DAMAGE = "path string, range_start long, reason string, raw binary"
BROKEN, TRUNCATED, NO_RECORD, NO_MEMBER = "broken data", "file ends inside", "no WARC record", "no member"
RECORD = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload binary"


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def member(record_type: str, record_id: str, refers_to: str | None, uri: str | None, digest: str, payload: bytes,
           level: int = 6) -> bytes:
    """One WARC record as a gzip member (a revisit carries no payload)."""
    block = HTTP + (b"" if record_type == "revisit" else payload)
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    out = gzip.compress(raw, compresslevel=level, mtime=0)
    return out + EMPTY_MEMBER if out[-1] else out


def parse(raw: bytes) -> tuple | None:
    """(type, id, refers to, uri, digest, payload) of a decoded record, or None if it is none (a length that is no number included)."""
    head, found, block = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length") or "0"
    if not (length.isascii() and length.isdigit()):
        return None
    block = block[: int(length)]
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    inner = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return (fields.get("warc-type"), inner(fields.get("warc-record-id")), inner(fields.get("warc-refers-to")),
            fields.get("warc-target-uri"), (fields.get("warc-payload-digest") or "").removeprefix("sha1:"), block)


class Member:
    """A gzip member that is decoded piece by piece."""

    def __init__(self) -> None:
        self.decoder, self.parts, self.raw = zlib.decompressobj(wbits=31), [], []

    def feed(self, piece: bytes) -> bool:
        """Take a piece; False if the data so far is no WARC record."""
        try:
            self.parts.append(self.decoder.decompress(piece))
        except zlib.error:
            return False
        self.raw.append(piece)
        start = b"".join(self.parts[:2])[:5] if self.parts else b""
        return b"WARC/".startswith(start) if len(start) < 5 else start == b"WARC/"

    @property
    def done(self) -> bool:
        return self.decoder.eof

    def record(self) -> tuple | None:
        return parse(b"".join(self.parts))

    def reason(self, record: tuple | None) -> str | None:
        """What is wrong with a finished member (None: nothing; an empty member holds nothing to lose)."""
        if self.decoder.unused_data:
            return NO_MEMBER
        return NO_RECORD if record is None and any(self.parts) else None


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 0, level: int = 6) -> None:
    """Write one record per row of ``pages`` to the folder ``path``.

    Payload: the text in UTF-8 (null: empty). Of rows with equal payloads of at
    least ``least_bytes`` bytes, those with the largest id are responses and the
    others revisit it; smaller payloads are all responses. A null id is smaller
    than any other; its record's id is ``null``.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("string").alias("id"), F.col(f"`{page_id}`").alias("n"),
                        F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    first = rows.groupBy("digest").agg(F.max("n").alias("owner"))
    small = F.octet_length("payload") < least_bytes
    ready = (rows.join(first, "digest").withColumn("response", small | F.col("n").eqNullSafe(F.col("owner")))
             .select(F.coalesce("id", F.lit("null")).alias("id"), F.col("owner").cast("string").alias("owner"), "response",
                     "url", "digest", "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    kind = "response" if r["response"] else "revisit"
                    out.append(member(kind, r["id"], None if r["response"] else r["owner"], r["url"],
                                      base32_of_hex(r["digest"]), r["payload"], level)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    ready.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Bytes between gzip magics, in file order within each byte range."""
    read = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return read.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("start"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record fields, path, start, seq, kind, raw): records of a range, and what it cannot finish or place.

    kind 0: a record; 1: a member that goes on behind the range; 2: a piece that
    no member of the range wants; 3: damage, with the reason as its record type.
    """
    names = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload", "path", "start", "seq", "kind", "raw"]
    types = [pa.string()] * 5 + [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    where, open_member, seq, placed = None, None, 0, False
    nothing = (None,) * 6

    def close() -> None:
        if open_member is not None:
            rows.append((*nothing, *where, seq, 1, b"".join(open_member.raw)))

    for batch in batches:
        for piece, path, start in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if (path, start) != where:
                close()
                where, open_member, seq, first = (path, start), None, 0, True
            seq += 1
            if first and start == 0 and not piece:
                first = False
                continue  # what lies before the first magic of a file
            first = False
            piece = MAGIC + piece
            if open_member is not None:
                if not open_member.feed(piece):
                    # look for the next member
                    rows.append((BROKEN, *nothing[1:], path, start, seq, 3, b"".join(open_member.raw)))
                    open_member = None
            if open_member is None:
                fresh = Member()
                if fresh.feed(piece):
                    open_member = fresh
                else:
                    rows.append((*nothing, path, start, seq, 2, piece))
                    continue
            if open_member.done:
                record = open_member.record()
                if record is not None:
                    rows.append((*record, path, start, seq, 0, None))
                reason = open_member.reason(record)
                if reason:
                    lost = open_member.decoder.unused_data or b"".join(open_member.raw)
                    rows.append((reason, *nothing[1:], path, start, seq, 3, lost))
                open_member = None
            if len(rows) >= 256:
                yield flush()
    if where is not None:
        close()
    yield flush()


def _joined(rows: pd.DataFrame) -> Iterator[tuple[tuple | None, tuple | None]]:
    """(record, None) or (None, damage) of what the ends of byte ranges parted in one file."""
    open_member, at = None, 0
    for start, kind, raw in rows.sort_values(["start", "seq"])[["start", "kind", "raw"]].itertuples(index=False):
        if kind == 1:
            if open_member is not None:
                yield None, (at, BROKEN, b"".join(open_member.raw))
            open_member, at = Member(), start
            open_member.feed(raw)
        elif open_member is None:
            yield None, (start, NO_MEMBER, raw)
        elif not open_member.feed(raw):
            yield None, (at, BROKEN, b"".join(open_member.raw))
            yield None, (start, NO_MEMBER, raw)
            open_member = None
        if open_member is not None and open_member.done:
            record = open_member.record()
            if record is not None:
                yield record, None
            reason = open_member.reason(record)
            if reason:
                yield None, (at, reason, open_member.decoder.unused_data or b"".join(open_member.raw))
            open_member = None
    if open_member is not None:
        yield None, (at, TRUNCATED, b"".join(open_member.raw))


def _join_pieces(rows: pd.DataFrame) -> pd.DataFrame:
    """Records of one file that the ends of byte ranges parted."""
    columns = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload"]
    return pd.DataFrame([record for record, _ in _joined(rows) if record], columns=columns)


def _join_damage(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one file that belong to no record."""
    path = rows["path"].iloc[0]
    return pd.DataFrame([(path, *damage) for _, damage in _joined(rows) if damage], columns=["path", "range_start", "reason", "raw"])


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    return _pieces(spark, path).mapInArrow(_scan, RECORD + ", path string, start long, seq long, kind int, raw binary")


def _parted(scanned: DataFrame) -> DataFrame:
    return scanned.filter("kind IN (1, 2)").select("path", "start", "seq", "kind", "raw")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: type, id, refers_to, target_uri, payload digest and payload.

    Members that are cut off, fail their checksum or hold no WARC record give no row here.
    """
    scanned = _scanned(spark, path)
    whole = scanned.filter("kind = 0").select("record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload")
    return whole.union(_parted(scanned).groupBy("path").applyInPandas(_join_pieces, RECORD))


def damaged_members(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of the archives under ``path`` that belong to no record: file, start of the byte range
    they were found in, reason and the bytes, from the gzip magic on.

    Reasons: ``broken data`` (a member begins and then fails to decode),
    ``file ends inside`` (cut off), ``no WARC record`` (decodes, but to something else or with
    a malformed length) and ``no member`` (nothing decodes from there, a failed checksum
    in a member of one piece included). A sound archive has no rows; empty members are none.
    """
    scanned = _scanned(spark, path)
    found = scanned.filter("kind = 3").select("path", F.col("start").alias("range_start"), F.col("record_type").alias("reason"), "raw")
    return found.union(_parted(scanned).groupBy("path").applyInPandas(_join_damage, DAMAGE))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    common.checkpoint(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def _number(c: Column) -> Column:
    return F.when(c != "null", c).cast("long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back."""
    path = scratch_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    responses = (read.filter("record_type = 'response'")
                 .groupBy(F.col("record_id").alias("source_id"), "payload_digest").agg(F.max(F.octet_length("payload")).alias("full")))
    light = read.select("record_type", "record_id", "refers_to", "payload_digest", F.octet_length("payload").alias("own"),
                        F.coalesce("refers_to", "record_id").alias("source_id"))
    both = light.join(responses, ["source_id", "payload_digest"], "left")
    return both.select(
        _number(F.col("record_id")).alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("own")).cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", _number(F.col("refers_to")).alias("refers_to"))
