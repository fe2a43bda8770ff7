"""Exact top-k search by inner product on an impact-ordered index, score at a time.

The index holds shards of bounded size. A posting is a row's non-zero component
in one dimension; its impact is the component, a quantised integer, and a shard's
postings lie in segments by descending magnitude (halving from one to the next).
A block of queries takes segment by segment: the segment's postings are laid out
as a matrix and multiplied with all queries at once, adding up the accumulators.
What a row may still gain or lose is at most the sum over dimensions of the largest
impact to come, and at most the product of the query's norm with that of the row's
components to come. With the exact scores of the k best accumulators as a floor,
rows whose upper bound lies below it cannot be members. A query stops when this
proof leaves few possible members, or when no segment is left, and scores the
possible members exactly.

Queries go in blocks of bounded size; each (shard, block) pair is one group of
a cogroup, so neither shards nor queries pass through the driver. The k best
of each shard are merged by a window per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.llm.common import table, written
from wardflow.llm.vectors import integer_vectors

SHARD_ROWS = 8192
QUERY_ROWS = 512
SHARD_SCHEMA = "shard int, n int, width int, vec_ids array<bigint>, copies array<bigint>, x binary, posts binary, ends array<int>"
BLOCK_SCHEMA = "block int, n int, width int, query_ids array<bigint>, q binary"
HIT_SCHEMA = "query_id bigint, block int, pos int, vec_id bigint, score bigint, copies bigint"


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _ids(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers (0 for null) and which are null."""
    return np.array([v or 0 for v in values], np.int64), np.array([v is None for v in values], bool)


def prepared(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """Rows (vec_id, x, copies) of the usable vectors; equal rows are one."""
    return integer_vectors(df, vec_id, vector, scale).groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"))


def segments(x: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places (row * width + dimension) of the non-zero components by descending bit length, and the end of each segment."""
    size = np.frexp(np.abs(x).ravel().astype(np.float64))[1]  # the bit length of an integer; 0 for 0
    order = np.argsort(-size, kind="stable")
    ends = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)), 0, -1), "right")
    return order[: int((size > 0).sum())].astype(np.uint32), [int(e) for e in np.unique(ends) if e]


def build_index(rows: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard of ``rows(vec_id, x, copies)``: the vectors and their postings in segments of falling impact."""

    def build(t: pa.Table) -> pa.Table:
        x = _padded(t.column("x"))
        posts, ends = segments(x)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "n": pa.array([x.shape[0]], pa.int32()),
                         "width": pa.array([x.shape[1]], pa.int32()),
                         "vec_ids": pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                         "copies": pa.array([t.column("copies").to_pylist()], pa.list_(pa.int64())),
                         "x": pa.array([x.astype(np.int32).tobytes()], pa.binary()), "posts": pa.array([posts.tobytes()], pa.binary()),
                         "ends": pa.array([ends], pa.list_(pa.int32()))})

    shard = F.pmod(F.xxhash64(F.lit(11), "vec_id", "x"), F.lit(n_shards).cast("long")).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(build, SHARD_SCHEMA)


def query_blocks(queries: DataFrame, n_blocks: int) -> DataFrame:
    """One row per block of ``queries(vec_id, x)``."""

    def pack(t: pa.Table) -> pa.Table:
        q = _padded(t.column("x"))
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "n": pa.array([q.shape[0]], pa.int32()),
                         "width": pa.array([q.shape[1]], pa.int32()),
                         "query_ids": pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                         "q": pa.array([q.astype(np.int32).tobytes()], pa.binary())})

    block = F.pmod(F.xxhash64(F.lit(12), "vec_id", "x"), F.lit(n_blocks).cast("long")).cast("int")
    return queries.select("vec_id", "x", block.alias("block")).groupBy("block").applyInArrow(pack, BLOCK_SCHEMA)


class Shard:
    """A shard in memory, ready to answer queries."""

    def __init__(self, x: np.ndarray, posts: np.ndarray, ends: list[int], ids: np.ndarray, no_id: np.ndarray, copies: np.ndarray):
        self.x, self.posts, self.ends, self.ids, self.no_id, self.copies = x, posts, ends, ids, no_id, copies
        self.order = np.argsort(ids, kind="stable")
        self.norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)))

    def own(self, query_id: int) -> np.ndarray:
        """Rows with the id ``query_id``."""
        a, b = np.searchsorted(self.ids, query_id, "left", self.order), np.searchsorted(self.ids, query_id, "right", self.order)
        rows = self.order[a:b]
        return rows[~self.no_id[rows]]

    def possible(self, q: np.ndarray, own: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Rows that may be among the k best of each query (never its own), and the segments read to prove it."""
        n, width = self.x.shape
        read = np.zeros(len(q), int)
        at = np.array([i for i, rows in enumerate(own) if n - len(rows) > k], int)  # the queries still at work
        out = [np.setdiff1d(np.arange(n), rows) if n - len(rows) <= k else rows for rows in own]
        limit = int(np.abs(q).max(initial=0)) * int(np.abs(self.x).max(initial=0)) * width
        kind = np.float32 if limit < 1 << 24 else np.float64  # sums of integers below are exact
        norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        slack = norm * self.norm * 2.0**-40 if limit >= 1 << 53 else np.zeros(len(q))
        acc = np.zeros((len(at), n), kind)
        for i, query in enumerate(at):
            acc[i, own[query]] = -np.inf
        coming = np.abs(self.x)
        begin, few = 0, max(4 * k, n // 64)
        for end in self.ends or [0]:
            if not len(at):
                break
            part, places = np.zeros((n, width), kind), self.posts[begin:end]
            part.flat[places] = self.x.flat[places]
            coming.flat[places] = 0
            acc += q[at].astype(kind) @ part.T
            begin, last = end, end == (self.ends or [0])[-1]
            read[at] += 1
            rest = np.abs(q[at]) @ coming.max(axis=0).astype(np.float64)
            if not last and (rest > norm[at] * self.norm / 2).all():
                continue  # far from a proof, and trying one costs a pass over the accumulators
            top = np.argpartition(acc, n - k, axis=1)[:, n - k:]
            floor = np.einsum("ikd,id->ik", self.x[top], q[at]).min(axis=1)
            # rounded up by far more than the error of these few operations
            row_rest = np.sqrt((coming.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-5)
            most = np.minimum(rest, norm[at] * row_rest.max()) * (1 + 1e-5) + slack[at]
            could = acc >= (floor - most - (most > 0)).astype(kind)[:, None]
            if not last:  # of the rows that pass, those whose own remainder is large enough
                i, row = np.nonzero(could)
                could[i, row] = acc[i, row] + norm[at][i] * row_rest[row] + slack[at][i] >= floor[i] - 1
            done = last | (could.sum(axis=1) <= few)
            for i in np.flatnonzero(done):
                out[at[i]] = np.flatnonzero(could[i])
            at, acc = at[~done], acc[~done]
        return out, read

    def best(self, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``rows``, copies counted, by exact score (ties: smaller id, rows without one last), and their scores."""
        score = self.x[rows] @ q
        order = np.lexsort((self.ids[rows], self.no_id[rows], -score))
        before = np.cumsum(self.copies[rows][order]) - self.copies[rows][order]
        order = order[before < k]
        return rows[order], score[order]


def search(index: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, k: int) -> DataFrame:
    """Rows (query_id, block, pos, vec_id, score, copies): the k best of every shard for every query."""

    def answer(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "block", "pos", "vec_id", "score", "copies")}
        for s in shards.to_pylist():
            ids, no_id = _ids(s["vec_ids"])
            x = np.frombuffer(s["x"], np.int32).reshape(s["n"], s["width"]).astype(np.int64)
            shard = Shard(x, np.frombuffer(s["posts"], np.uint32), s["ends"], ids, no_id, np.array(s["copies"], np.int64))
            for b in queries.to_pylist():
                q = np.zeros((b["n"], s["width"]), np.int64)  # components that a side lacks count as 0
                given = np.frombuffer(b["q"], np.int32).reshape(b["n"], b["width"])
                q[:, :b["width"]] = given[:, :s["width"]]
                members, _ = shard.possible(q, [shard.own(i) for i in b["query_ids"]], k)
                for pos, query_id in enumerate(b["query_ids"]):
                    rows, score = shard.best(q[pos], members[pos], k)
                    out["query_id"] += [query_id] * len(rows)
                    out["block"] += [b["block"]] * len(rows)
                    out["pos"] += [pos] * len(rows)
                    out["vec_id"] += [None if no_id[r] else int(ids[r]) for r in rows]
                    out["score"] += score.tolist()
                    out["copies"] += np.minimum(shard.copies[rows], k).tolist()
        kinds = {"block": pa.int32(), "pos": pa.int32()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    def spread(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    left = spread(index, "block", n_blocks).groupBy("shard", "block")
    right = spread(blocks, "shard", n_shards).groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(answer, HIT_SCHEMA)


def top_k(df: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    ``is_query`` is a condition on ``vec_id``. Components become floor(scale *
    component). Ties go to the smaller vec_id, rows without an id last. Vectors
    that are null, or hold null or non-finite components, take no part; empty
    ones score 0; where lengths differ, missing components count as 0. Rows that
    share the query's vec_id count as its own. Equal rows are separate candidates
    but one query; rows without an id are no queries. Other columns are ignored.
    """
    rows = written(prepared(df, vec_id, vector, scale))
    queries = rows.filter(F.col("vec_id").isNotNull() & is_query)
    n, n_queries = rows.count(), queries.count()
    ranked_schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n_queries:
        return df.sparkSession.createDataFrame([], ranked_schema)
    n_shards, n_blocks = -(-n // shard_rows), -(-n_queries // query_rows)
    index, blocks = written(build_index(rows, n_shards)), written(query_blocks(queries, n_blocks))
    hits = search(index, blocks, n_shards, n_blocks, k)
    single = hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    order = Window.partitionBy("query_id", "block", "pos").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "copy")
    ranked = single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
