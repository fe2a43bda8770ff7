"""Benchmark decontamination with an FM-index per training shard.

Each Arrow batch of documents is a shard. Its text, written in the benchmark's
vocabulary, is indexed (suffix order, Burrows-Wheeler transform in a wavelet
matrix, sampled suffix positions); every benchmark window is searched backwards
through wavelet ranks, and its occurrences are located by walking to a sampled
position. Overlapping occurrences merge into removal spans.

Only maximal runs of words that the benchmark holds are indexed, if they are as
long as the shortest window: no occurrence can lie outside them, so nothing is
lost and the index is small beside the text.

The benchmark goes to the tasks in blocks of bounded size (``block_bytes``); a
larger benchmark takes several passes over the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm import words as W
from wardflow.llm.common import add_columns, checkpoint

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", SPAN),
    T.StructField("word_spans", SPAN),
    T.StructField("items", T.ArrayType(T.StringType())),
])
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class WaveletMatrix:
    """Rank of a symbol among the first ``i`` symbols, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        s = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo = np.zeros(len(symbol), dtype=np.int64)
        for k in range(self.bits):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones, z = self.ones[k], self.zeros[k]
            i = np.where(bit, z + ones[i], i - ones[i])
            lo = np.where(bit, z + ones[lo], lo - ones[lo])
        return i - lo


class FMIndex:
    """FM-index of runs of symbols >= 1 separated by single zeros; the text starts with a zero."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        n = len(text)
        gaps = np.flatnonzero(text == 0)
        # every zero is a symbol of its own, so that no comparison passes the end of a run
        rank = text.astype(np.int64) + len(gaps)
        rank[gaps] = np.arange(len(gaps))
        _, rank = np.unique(rank, return_inverse=True)
        h = 1
        while True:
            key = rank.astype(np.int64) * (n + 1)
            key[: n - h] += rank[h:] + 1
            order = np.argsort(key, kind="stable")
            step = np.ones(n, dtype=np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(step) - 1
            if rank[order[-1]] == n - 1 or h >= n:
                break
            h = min(2 * h, n)
        bwt = text[order - 1]
        self.bwt = bwt
        self.wavelet = WaveletMatrix(bwt, alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        kept = (order % sample == 0) | (bwt == 0)
        self.kept, self.kept_rank, self.kept_at = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns (rows, right-aligned)."""
        n, width = len(self.bwt), patterns.shape[1]
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), n, dtype=np.int64)
        for k in range(1, width + 1):
            live = np.flatnonzero((lengths >= k) & (lo < hi))
            c = patterns[live, width - k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps to the left until a sampled one."""
        steps = np.zeros(len(rows), dtype=np.int64)
        rows = rows.copy()
        walking = np.flatnonzero(~self.kept[rows])
        while len(walking):
            c = self.bwt[rows[walking]]
            rows[walking] = self.before[c] + self.wavelet.rank(c, rows[walking])
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.kept_at[self.kept_rank[rows]] + steps


def phrase_block(ids: list[str], texts: list[str | None], size: int) -> dict | None:
    """Vocabulary, distinct windows (right-aligned symbol rows) and the items of each window."""
    data, offsets = W.text_buffer(pa.array(texts, type=pa.large_string()))
    w = W.words(data, offsets, W.alphanumeric())
    vocabulary, symbol = np.unique(w.hash, return_inverse=True)
    windows: dict[tuple[int, ...], set[str]] = {}
    for r, item in enumerate(ids):
        s = (symbol[w.first[r]: w.first[r + 1]] + 1).tolist()
        for i in range(max(1, len(s) - size + 1) if s else 0):
            windows.setdefault(tuple(s[i: i + size]), set()).add(item)
    if not windows:
        return None
    rows = np.zeros((len(windows), size), dtype=np.int64)
    lengths = np.array([len(k) for k in windows], dtype=np.int64)
    for r, k in enumerate(windows):
        rows[r, size - len(k):] = k
    guard = np.zeros(1 << 20, dtype=bool)
    guard[(vocabulary & W.U64((1 << 20) - 1)).astype(np.int64)] = True
    return {"vocabulary": vocabulary, "rows": rows, "lengths": lengths, "items": [sorted(v) for v in windows.values()],
            "guard": np.packbits(guard), "least": int(lengths.min())}


def shard_hits(column: pa.Array, block: dict) -> tuple[np.ndarray, list]:
    """Words per document of a shard, and (row, window, first word, first byte, end byte of each word ...) of hits."""
    data, offsets = W.text_buffer(column)
    n_words = np.zeros(len(column), dtype=np.int64)
    guard = np.unpackbits(block["guard"]).astype(bool)
    vocabulary, least = block["vocabulary"], block["least"]
    text, where, row_of, starts, ends = [], [], [], [], []
    for i, j in W.row_groups(offsets):
        w = W.words(data, offsets[i: j + 1], W.alphanumeric())
        n_words[i:j] = np.diff(w.first)
        maybe = np.flatnonzero(guard[(w.hash & W.U64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(vocabulary, w.hash[maybe])
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == w.hash[maybe]
        idx, sym = maybe[known], at[known] + 1
        if not len(idx):
            continue
        row = np.searchsorted(w.first, idx, side="right") - 1
        new_run = np.ones(len(idx), dtype=bool)
        new_run[1:] = (idx[1:] != idx[:-1] + 1) | (row[1:] != row[:-1])
        run = np.cumsum(new_run) - 1
        long = (np.bincount(run) >= least)[run]
        idx, sym, row, new_run = idx[long], sym[long], row[long], new_run[long]
        if not len(idx):
            continue
        at = np.flatnonzero(new_run)
        text.append(np.insert(sym, at, 0))
        where.append(np.insert(idx - w.first[row], at, -1))
        row_of.append(np.insert(row + i, at, -1))
        starts.append(np.insert(w.start[idx], at, -1))
        ends.append(np.insert(w.end[idx], at, -1))
    if not text:
        return n_words, []
    text, where, row_of, starts, ends = (np.concatenate(x) for x in (text, where, row_of, starts, ends))
    index = FMIndex(text, len(vocabulary) + 1)
    lo, hi = index.search(block["rows"], block["lengths"])
    count = np.maximum(hi - lo, 0)
    found = np.flatnonzero(count)
    if not len(found):
        return n_words, []
    of = np.repeat(found, count[found])
    first = np.cumsum(count[found]) - count[found]
    rows = np.repeat(lo[found] - first, count[found]) + np.arange(len(of))
    at = index.locate(rows)
    length = block["lengths"][of]
    order = np.lexsort((at, row_of[at]))
    at, of, length = at[order], of[order], length[order]
    row = row_of[at]
    last = at + length - 1
    offset = {r: int(offsets[r]) for r in np.unique(row).tolist()}
    hits = []
    for r, s, e in _groups(row):
        hits.append((r, of[s:e], where[at[s:e]], where[last[s:e]] + 1, starts[at[s:e]] - offset[r], ends[last[s:e]] - offset[r],
                     data[offset[r]: int(offsets[r + 1])]))
    return n_words, hits


def _groups(sorted_values: np.ndarray):
    cut = np.flatnonzero(np.diff(sorted_values)) + 1
    for s, e in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(sorted_values)]])):
        yield int(sorted_values[s]), int(s), int(e)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges as sorted, disjoint, non-touching ranges."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _search_batch(column: pa.Array, old: list[pa.Array], block: dict | None) -> list[pa.Array]:
    n = len(column)
    spans, word_spans, items = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    for a, to in zip(old, (spans, word_spans, items)):
        for r, v in enumerate(a.to_pylist()):
            to[r] = [(x["start"], x["end"]) for x in v] if to is not items else v
    if block is None:
        data, offsets = W.text_buffer(column)
        n_words = np.concatenate([np.diff(W.words(data, offsets[i: j + 1], W.alphanumeric()).first)
                                  for i, j in W.row_groups(offsets)] or [np.zeros(0, np.int64)])
        hits = []
    else:
        n_words, hits = shard_hits(column, block)
    for r, windows, w0, w1, b0, b1, raw in hits:
        items[r] = sorted({*items[r], *(x for k in np.unique(windows).tolist() for x in block["items"][k])})
        word_spans[r] = merged(word_spans[r] + list(zip(w0.tolist(), w1.tolist())))
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
        spans[r] = merged(spans[r] + list(zip(points[b0].tolist(), points[b1].tolist())))
    as_structs = lambda rows: pa.array([[{"start": s, "end": e} for s, e in x] for x in rows], type=SPAN_ARROW)
    return [pa.array(n_words, type=pa.int64()), pa.array([sum(e - s for s, e in x) for x in word_spans], type=pa.int64()),
            as_structs(spans), as_structs(word_spans), pa.array(items, type=pa.list_(pa.string()))]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int) -> list:
    """Functions that fetch one block of the benchmark each; a block holds about ``block_bytes`` of text."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("id"),
                             F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))

    def fetch(b: int) -> dict | None:
        got = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").collect()
        return phrase_block([r["id"] for r in got], [r["text"] for r in got], size)

    return [lambda b=b: fetch(b) for b in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                       item_text: str = "text", size: int = 10, keep: list[str] | None = None,
                       block_bytes: int = 8 << 20) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    A window is ``size`` consecutive words of an item (a shorter item is one
    window). Adds to the columns ``keep`` (default: all of ``docs``): ``n_words``,
    ``n_hit`` (words inside an occurrence), ``spans`` (merged removal spans in
    code points, half-open), ``word_spans`` (the same in words) and ``items``
    (ids of the items with an occurring window, sorted as strings).

    A null or empty text has no words; a null item text has no windows; a null
    item id counts as the id ``null``; rows with equal item ids are one item;
    repeated documents are each judged; input columns named like a result
    column are replaced; an empty benchmark finds nothing.
    """
    keep = list(docs.columns) if keep is None else keep
    blocks = benchmark_blocks(benchmark, item_id, item_text, size, block_bytes)
    out = docs
    for k, fetch in enumerate(blocks):
        block = fetch()
        later = ["spans", "word_spans", "items"] if k else []
        more = k + 1 < len(blocks)
        carry = [c for c in dict.fromkeys([*keep, text_col])] if more else keep
        out = add_columns(out, [text_col, *later], RESULT,
                          lambda column, *old, block=block: _search_batch(column, list(old), block), keep=carry)
        out = checkpoint(out) if more else out
    return out


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the code points in ``spans`` (sorted, disjoint)."""
    if text is None or not spans:
        return text
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return "".join(parts) + text[at:]


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document of ``documents`` by the items of ``benchmark``."""
    from wardflow.llm.common import table

    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                               table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
