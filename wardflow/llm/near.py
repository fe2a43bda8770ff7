"""Near-duplicate groups by HyperMinHash registers, banding and exact verification.

A document's distinct word shingles are dealt to buckets; each bucket keeps the
smallest hash as a 16-bit register (leading-zero count and ten mantissa bits).
An empty register borrows the first filled one in an order of its own, so every
band of a short document is informative and unrelated documents that share one
common shingle do not meet. Equal minima always give equal registers, so the
compression adds candidates but loses none; 40 bands of 5 registers miss a pair
at similarity 0.8 with probability 1.2e-7 (1 of 60,000 simulated pairs of 5 and 4 shingles).

Documents with the same shingle set are one class and enter with one
representative, so groups of copies form no pairs. Inside a band bucket pairs are not enumerated either: all members
are compared with one centre, which joins most of them into one component. In
buckets that still hold several, the members outside the largest component are
compared with all members, in bounded blocks inside tasks. So at the end every
pair of a bucket is either in one component or has been compared.
Candidates whose sets both have at least as many shingles as there are registers
pass a collision-corrected Jaccard estimate (five standard deviations wide); all
that remain are then confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import words as W
from wardflow.llm.common import add_columns, checkpoint, components, table

ROWS, BANDS, MANTISSA = 5, 40, 10
REGISTERS = ROWS * BANDS
#: chance that two different minima share a register: 0.17 * 2**-mantissa bits for sets of about equal size
COLLISION = 0.17 / (1 << MANTISSA)
#: rows of a block when all members of a bucket are compared
BLOCK = 2048
SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("sig_a", T.LongType()),
                       T.StructField("sig_b", T.LongType()), T.StructField("registers", T.BinaryType())])


def probe_order(k: int = REGISTERS) -> np.ndarray:
    """Row j: the order in which an empty register j looks at the others."""
    key = W.mix(np.arange(k * k, dtype=W.U64), 21).reshape(k, k)
    return np.argsort(key, axis=1).astype(np.int32)


def registers(h: np.ndarray, first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of shingle sets sorted within rows; zeros for an empty set."""
    k, n = REGISTERS, len(first) - 1
    reg = np.zeros(n * k, dtype=np.uint16)
    if len(h):
        bucket = (((h >> W.U64(32)) * W.U64(k)) >> W.U64(32)).astype(np.int64)
        cell = np.repeat(np.arange(n), np.diff(first)) * k + bucket
        bits = np.maximum(W.mix(h, 3), W.U64(1)).astype(np.float64).view(np.uint64)
        exponent = np.maximum((bits >> W.U64(52)).astype(np.int64) - 1023, 23) - 22
        code = (exponent << MANTISSA) | ((bits >> W.U64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1))
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        reg[cell[start]] = np.minimum.reduceat(code, start)
    reg = reg.reshape(n, k)
    filled = reg != 0
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = reg.copy()
    for attempt in range(k):
        if not len(row):
            break
        at = order[col, attempt]
        got = reg[row, at]
        ok = got != 0
        out[row[ok], col[ok]] = got[ok]
        row, col = row[~ok], col[~ok]
    return out


def sketch(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``doc_id``, number of distinct shingles, 128-bit signature of the set and registers of every document."""
    order = probe_order()

    def run(column: pa.Array) -> list[pa.Array]:
        data, offsets = W.text_buffer(column)
        parts = []
        for i, j in W.row_groups(offsets, 2 << 20):
            h, first = W.shingle_sets(W.words(data, offsets[i: j + 1], W.not_blank()), size)
            n = np.diff(first)
            sums = []
            for seed in (11, 12):
                acc = np.concatenate([np.zeros(1, W.U64), np.cumsum(W.mix(h, seed), dtype=W.U64)])
                sums.append((acc[first[1:]] - acc[first[:-1]]).view(np.int64))
            raw = registers(h, first, order)
            parts.append((n, *sums, [r.tobytes() for r in raw]))
        n, a, b = (np.concatenate([p[x] for p in parts]) for x in range(3))
        return [pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                pa.array([x for p in parts for x in p[3]], pa.binary())]

    return add_columns(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("__text")),
                       ["__text"], SKETCH, run, keep=["id"])


def band_rows(classes: DataFrame) -> DataFrame:
    """Rows (key, id): one per band of each class representative."""
    weights = W.mix(np.arange(REGISTERS, dtype=W.U64), 31).reshape(BANDS, ROWS) | W.U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reg = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS)
            key = W.mix((reg.astype(W.U64) * weights).sum(axis=2, dtype=W.U64) + np.arange(BANDS, dtype=W.U64), 33)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64())], names=["key", "id"])

    return classes.select("id", "registers").mapInArrow(run, "key long, id long")


def confirm(pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    A pair first has to pass the bound that the set sizes give and, if both sets
    have at least as many shingles as there are registers, the estimate from
    the registers, less five standard deviations. In smaller sets borrowed
    registers repeat the few filled ones, so the estimate says too little.
    """
    one = pairs.join(nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a"),
                                  F.col("text").alias("t_a")), "a")
    both = one.join(nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b"),
                                 F.col("text").alias("t_b")), "b")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                reg = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in (2, 3)]
                same = (reg[0] == reg[1]).mean(axis=1)
                few = b.column(6).to_numpy() < REGISTERS
                b = b.filter(pa.array(few | ((same - COLLISION) / (1 - COLLISION) >= least)))
                if not b.num_rows:
                    continue
                sets = []
                for c in (4, 5):
                    coded = b.column(c).dictionary_encode()
                    data, offsets = W.text_buffer(coded.dictionary)
                    sets.append((W.shingle_sets(W.words(data, offsets, W.not_blank()), size), coded.indices.to_numpy()))
                (ha, fa), ia = sets[0]
                (hb, fb), ib = sets[1]
                ok = np.zeros(b.num_rows, dtype=bool)
                for r, (x, y) in enumerate(zip(ia, ib)):
                    p, q = ha[fa[x]: fa[x + 1]], hb[fb[y]: fb[y + 1]]
                    at_q = np.searchsorted(q, p)
                    at_q[at_q == len(q)] = 0
                    common = int((q[at_q] == p).sum()) if len(q) else 0
                    ok[r] = 100 * common >= percent * (len(p) + len(q) - common)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "r_a", "r_b", "t_a", "t_b", F.least("n_a", "n_b").alias("few")).mapInArrow(run, "a long, b long").distinct()


def across_components(live: DataFrame, nodes: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the components that share a bucket, by comparing all their members.

    ``live`` has the rows (key, id, component) of the buckets that hold several
    components. A bucket's members outside its largest component meet all its
    members, in blocks of about ``block`` by ``block`` documents, on their full
    shingle sets inside the task. A member's first link to each component is
    returned, so the result does not grow with the square of a bucket.
    """
    per = live.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    largest = per.groupBy("key").agg(F.max(F.struct("c", "component")).alias("x"), F.sum("c").alias("m")).select(
        "key", F.col("x.component").alias("main"), F.ceil(F.col("m") / block).cast("int").alias("across"),
        F.ceil((F.col("m") - F.col("x.c")) / block).cast("int").alias("down"))
    rows = live.join(largest, "key").join(nodes.select("id", "text"), "id")
    spot = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.select("key", upto("down").alias("i"), spot("across").alias("j"), F.lit(False).alias("asks"), "id", "component", "text")
    asking = rows.filter("component <> main").select("key", spot("down").alias("i"), upto("across").alias("j"),
                                                      F.lit(True).alias("asks"), "id", "component", "text")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        data, offsets = W.text_buffer(pa.array(group["text"], pa.large_string()))
        h, first = W.shingle_sets(W.words(data, offsets, W.not_blank()), size)
        asks, ids, component = group["asks"].to_numpy(), group["id"].to_numpy(), group["component"].to_numpy()
        n = np.diff(first)
        values, dense = np.unique(h, return_inverse=True)
        mark = np.zeros(len(values), dtype=bool)
        found = set()
        for r in np.flatnonzero(asks):
            own = dense[first[r]: first[r + 1]]
            mark[own] = True
            common = np.diff(np.concatenate([[0], np.cumsum(mark[dense])])[first])
            mark[own] = False
            linked = ~asks & (component != component[r]) & (100 * common >= percent * (n + n[r] - common))
            for c in np.unique(component[linked]):
                other = ids[linked & (component == c)].min()
                found.add((min(ids[r], other), max(ids[r], other)))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return members.union(asking).groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over
    links) and ``kept`` (it is that document).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document with fewer
    than ``size`` words has its whole sequence as its only shingle. Null, empty
    and blank texts have no shingles, link with nothing and stay. Repeated rows
    form one class. A null ``doc_id`` names no component: its row takes the id
    of its class, and stays if the class has none.
    """
    ids = docs.schema[doc_id].dataType
    plain = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = checkpoint(sketch(plain, "id", "text", size))
    classes = checkpoint(sketched.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("sig_a", "sig_b")
                         .agg(F.min(F.struct("id", "n_shingles", "registers")).alias("x"))
                         .select("sig_a", "sig_b", "x.id", F.col("x.n_shingles").alias("n"), "x.registers"))

    bands = band_rows(classes)
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("centre")).filter("m > 1").drop("m")
    live = checkpoint(bands.join(shared, "key"))
    involved = live.select("id").distinct()
    # only documents that share a bucket are compared; their texts are fetched once
    nodes = checkpoint(plain.join(involved, "id", "left_semi").join(classes.select("id", "n", "registers"), "id"))

    pairs = live.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = checkpoint(confirm(pairs, nodes, size, percent))
    labels = components(links)
    # members of a bucket that the centre did not join into one component
    named = live.filter("id <> centre").select("key", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    mixed = (named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low < high").select("key"))
    mixed_live = checkpoint(named.join(mixed, "key"))
    links = checkpoint(links.union(across_components(mixed_live, nodes, size, percent)))
    labels = components(links)

    found = (sketched.join(classes.select("sig_a", "sig_b", F.col("id").alias("class_id")), ["sig_a", "sig_b"], "left")
             .join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "class_id")).otherwise(F.col("id"))
    return found.select(F.col("id").cast(ids).alias(doc_id), "n_shingles", component.cast(ids).alias("component_id"),
                        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on two-word shingles at similarity 0.8."""
    return near_groups(table(spark, sf_dir, "documents"), size=2, percent=80)
