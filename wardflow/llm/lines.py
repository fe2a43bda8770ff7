"""Line dedup through a sharded minimal perfect hash.

Lines become 128-bit digests. Digests found in at least two documents are cut
into shards of bounded size; each shard gets a minimal perfect hash (levels of
bit arrays in which every key finds a place of its own) that indexes compact
arrays: a fingerprint, the number of documents and the document that keeps the
line. Documents' digests are sent to the shards and probe the arrays as they
stream by, so a task holds one shard at a time and lines are never joined. A
shard with many probes (a line in a third of all documents) is copied to as
many tasks as its probe count asks for.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import words as W
from wardflow.llm.common import add_columns, checkpoint, table

BLANKS = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 1 << 16
PROBES_PER_TASK = 1 << 17
NOBODY = np.iinfo(np.int64).min


def line_digest(line: bytes, least: int) -> tuple[int, int] | None:
    """128-bit digest of a line's key (blanks stripped, A-Z lower-cased), or None if it is shorter than ``least``."""
    key = line.strip(BLANKS)
    if len(key) < least or len(str(key, "utf-8", "replace")) < least:
        return None
    d = hashlib.blake2b(key.lower(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys with a fingerprint, a count and an owner per key."""

    def __init__(self, a: np.ndarray, b: np.ndarray, count: np.ndarray, owner: np.ndarray):
        key = self.fold(a, b)
        self.levels: list[np.ndarray] = []
        left = np.arange(len(key))
        while len(left) and len(self.levels) < 48:
            size = max(64, -(-2 * len(left) // 8) * 8)
            at = (W.mix(key[left], len(self.levels)) % W.U64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            self.levels.append(np.packbits(bits))
            left = left[~alone]
        # keys that no level parts (equal after folding) are kept whole
        self.rest = {(int(a[i]), int(b[i])): (int(count[i]), int(owner[i])) for i in left}
        self.open()
        n = self.total
        self.fingerprint, self.count, self.owner = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        index = self.index(key)
        has = index >= 0
        has[left] = False
        self.fingerprint[index[has]], self.count[index[has]], self.owner[index[has]] = b[has], count[has], owner[has]

    @staticmethod
    def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix(a.view(np.uint64) ^ W.mix(b.view(np.uint64), 51), 52)

    def open(self) -> None:
        self.bits = [np.unpackbits(x).astype(bool) for x in self.levels]
        sums = [int(x.sum()) for x in self.bits]
        self.start = np.concatenate([[0], np.cumsum(sums)]).astype(np.int64)
        self.ranks = [np.cumsum(x) - 1 for x in self.bits]
        self.total = int(self.start[-1])

    def dump(self) -> bytes:
        return pickle.dumps({k: v for k, v in self.__dict__.items() if k not in ("bits", "ranks")})

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(raw))
        out.open()
        return out

    def index(self, key: np.ndarray) -> np.ndarray:
        """Place of each key in the arrays (any place, or -1, for a key that is not in the set)."""
        out = np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            at = (W.mix(key[left], level) % W.U64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.start[level] + ranks[at[hit]]
            left = left[~hit]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not in the set) and owner of each key."""
        index = self.index(self.fold(a, b))
        known = index >= 0
        known[known] = self.fingerprint[index[known]] == b[known]
        count, owner = np.zeros(len(a), np.int64), np.full(len(a), NOBODY, np.int64)
        count[known], owner[known] = self.count[index[known]], self.owner[index[known]]
        for i in np.flatnonzero(~known) if self.rest else ():
            count[i], owner[i] = self.rest.get((int(a[i]), int(b[i])), (0, NOBODY))
        return count, owner


def document_lines(docs: DataFrame, least: int) -> DataFrame:
    """Rows (a, b, id): the distinct digests of each row's lines of at least ``least`` code points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seen = {line_digest(x, least) for x in (text or b"").split(b"\n")}
                seen.discard(None)
                for x, y in seen:
                    a.append(x)
                    b.append(y)
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ids, pa.int64())],
                                             names=["a", "b", "id"])

    return docs.select("id", "text").mapInArrow(run, "a long, b long, id long")


def repeated_line_hits(lines: DataFrame, min_docs: int, keys_per_shard: int = KEYS_PER_SHARD,
                       probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """Rows (id, a, b): lines that a document loses, found by probing the shards' arrays."""
    held = lines.groupBy("a", "b", "id").agg(F.lit(1).alias("one"))
    keys = checkpoint(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")).filter("n > 1"))
    shards = max(1, -(-keys.count() // keys_per_shard))
    shard = F.pmod(F.col("a"), F.lit(shards)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        table_of = PerfectHash(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["n"].to_numpy(), rows["owner"].to_numpy())
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "probes": [int(rows["n"].sum())], "blob": [table_of.dump()]})

    arrays = checkpoint(keys.select(shard.alias("shard"), "a", "b", "n", F.coalesce("owner", F.lit(int(NOBODY))).alias("owner"))
                        .groupBy("shard").applyInPandas(build, "shard int, probes long, blob binary"))
    # probes of a shard: those of its keys, and its part of the lines that occur once
    spread = -(-lines.count() // (shards * probes_per_task))
    sizes = arrays.select("shard", (F.floor(F.col("probes") / probes_per_task) + 1 + spread).cast("int").alias("copies"))
    empty = F.lit(None).cast("long")
    held_arrays = (arrays.join(sizes, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
                   .select("shard", "copy", F.lit(0).alias("kind"), "blob", empty.alias("a"), empty.alias("b"), empty.alias("id")))
    probes = (lines.withColumn("shard", shard).join(F.broadcast(sizes), "shard")  # one small row per shard of keys
              .select("shard", F.pmod(F.xxhash64("id", "b"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"),
                      F.lit(None).cast("binary").alias("blob"), "a", "b", "id"))
    routed = held_arrays.union(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays_of = None
        for batch in batches:
            kind = batch.column(2).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [batch.num_rows]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if s == e:
                    continue
                if kind[s] == 0:
                    arrays_of = PerfectHash.load(batch.column(3)[e - 1].as_py())
                    continue
                part = batch.slice(s, e - s)
                a, b = part.column(4).to_numpy(zero_copy_only=False), part.column(5).to_numpy(zero_copy_only=False)
                count, owner = arrays_of.probe(a, b)
                ids = part.column(6)
                lose = (count >= min_docs) & (ids.fill_null(int(NOBODY)).to_numpy(zero_copy_only=False) != owner)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(lose)), pa.array(a[lose]), pa.array(b[lose])], names=["id", "a", "b"])

    return routed.mapInArrow(run, "id long, a long, b long")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and the columns ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z
    lower-cased. A key of at least ``least`` code points in at least ``min_docs``
    documents loses all its lines except in the largest ``doc_id`` that holds it.
    A null or empty text is one empty line (a null text stays null). Rows with an
    equal id are one document; a null id is a document that is never the largest.
    Input columns named like a result are replaced; other columns stay.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = checkpoint(document_lines(plain, least))
    hits = repeated_line_hits(lines, min_docs).select("id", F.struct("a", "b").alias("line")).groupBy("id").agg(
        F.collect_set("line").alias("__lose")).withColumnRenamed("id", "__id")
    joined = docs.select(*[F.col(f"`{c}`") for c in columns]).join(
        hits, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__id")), "left")
    schema = T.StructType([T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(column: pa.Array, lose: pa.Array) -> list[pa.Array]:
        out, before, dropped = [], [], []
        for raw, gone in zip(column.cast(pa.binary()).to_pylist(), lose.to_pylist()):
            parts = (raw or b"").split(b"\n")
            before.append(len(parts))
            if gone and raw is not None:
                gone = {(x["a"], x["b"]) for x in gone}
                parts = [x for x in parts if line_digest(x, least) not in gone]
                raw = b"\n".join(parts)
            out.append(raw)
            dropped.append(before[-1] - len(parts))
        return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]

    joined = joined.withColumn(text, F.col(f"`{text}`").cast("string"))
    done = add_columns(joined, [text, "__lose"], schema, run, keep=[c for c in columns if c != text])
    return done.select(*[F.col(f"`{c}`") for c in columns], "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and digest of the kept text of every document."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> owner AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
