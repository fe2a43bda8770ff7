"""Chat formatting of reply trees with DataFrame functions only.

Reply trees are walked by iterative self-joins with pointer doubling: round k
joins every node to the node 2**k levels above it, so a tree of depth d takes
log2(d) rounds. The rounds give each leaf the score of its root-to-leaf path;
the best paths per tree are then enumerated from their leaves through the same
jump tables, so the work follows the length of the chosen paths only.

Template: ``<turn ROLE>\\nTEXT</turn>\\n`` per turn. Inside roles and texts
``\\`` is written ``\\s`` and ``<`` is written ``\\l`` (in roles also ``>`` as
``\\g``), so no control string can appear in content, and plain replacement in
the opposite order restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardflow.llm.common import checkpoint, table

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g")) if role else c


def unescape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def _key(c: Column) -> Column:
    """A string that is equal exactly where ``c`` is, and never null."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def best_paths(nodes: DataFrame, tree: str, node: str, parent: str, score: str, per_tree: int = 1) -> DataFrame:
    """The ``per_tree`` best root-to-leaf paths of each reply tree.

    Rows (tree, node as key strings, ``rank``, ``position`` from the root,
    ``path_score``). A path's score is the sum of its nodes' scores (null: 0);
    ties go to the longer path, then to the smaller leaf key. A node without
    parent, or with one that its tree lacks, is a root. Of rows with the same
    tree and node the smallest (parent, score) counts. Nodes on or below a
    cycle have no root and no path.
    """
    base = checkpoint(
        nodes.select(_key(F.col(f"`{tree}`")).alias("t"), _key(F.col(f"`{node}`")).alias("n"),
                     F.when(F.col(f"`{parent}`").isNotNull(), _key(F.col(f"`{parent}`"))).alias("p"),
                     F.coalesce(F.col(f"`{score}`").cast("double"), F.lit(0.0)).alias("s"))
        .groupBy("t", "n").agg(F.min(F.struct("p", "s")).alias("x")).select("t", "n", "x.p", "x.s"))
    known = base.select("t", F.col("n").alias("p"), F.col("n").alias("up"))
    state = checkpoint(base.join(known, ["t", "p"], "left")
                       .select("t", "n", "up", F.col("s").alias("total"), F.lit(1).cast("long").alias("hops")))
    parents = state.filter("up IS NOT NULL").select("t", F.col("up").alias("n")).distinct()
    leaves = state.join(parents, ["t", "n"], "left_anti").select("t", "n")

    jumps: list[DataFrame] = []
    open_before = None
    while True:
        still = state.filter("up IS NOT NULL").count()
        if not still or still == open_before:
            break
        open_before = still
        jumps.append(state.filter("up IS NOT NULL").select("t", "n", "up"))
        above = state.select("t", F.col("n").alias("up"), F.col("up").alias("up2"),
                             F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        # nodes that have reached their root stay as they are
        risen = state.filter("up IS NOT NULL").join(above, ["t", "up"]).select(
            "t", "n", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("hops") + F.col("hops2")).alias("hops"))
        state = checkpoint(state.filter("up IS NULL").union(risen))

    ends = state.filter("up IS NULL").join(leaves, ["t", "n"], "left_semi")
    order = Window.partitionBy("t").orderBy(F.desc("total"), F.desc("hops"), "n")
    walk = (ends.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_tree)
            .select("t", "rank", F.col("total").alias("path_score"), (F.col("hops") - 1).alias("position"), "n"))
    for k in range(len(jumps) - 1, -1, -1):
        up = (walk.join(jumps[k], ["t", "n"])
              .select("t", "rank", "path_score", (F.col("position") - (1 << k)).alias("position"), F.col("up").alias("n")))
        walk = checkpoint(walk.union(up))
    return walk.select(F.col("t").alias("tree_key"), F.col("n").alias("node_key"), "rank", "position", "path_score")


def format_conversations(turns: DataFrame, key: list[str], position: str, role: str, text: str,
                         trained: str = "assistant") -> DataFrame:
    """One formatted conversation per key, with the spans that carry loss.

    Rows (key, ``formatted``, ``loss_spans`` as start and length in code points
    of ``formatted``); the spans cover exactly the escaped texts of the turns
    whose role is ``trained``. Null roles and texts count as empty.
    """
    keys = [F.col(f"`{k}`") for k in key]
    body = turns.select(*keys, F.col(f"`{position}`").alias("__at"),
                        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("__role"),
                        escape(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("__body"))
    body = body.withColumn("__head", F.concat(F.lit(OPEN), escape(F.col("__role"), role=True), F.lit(MIDDLE)))
    size = F.length("__head") + F.length("__body") + F.lit(len(CLOSE))
    before = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.withColumn("__start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("__head"))
    turn = F.struct("__at", F.concat("__head", "__body", F.lit(CLOSE)).alias("piece"),
                    F.col("__start").cast("int").alias("start"), F.length("__body").alias("length"),
                    (F.col("__role") == trained).alias("trained"))
    listed = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    return listed.select(
        *keys, F.array_join(F.transform("__turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("__turns", lambda x: x["trained"]),
                    lambda x: F.struct(x["start"], x["length"])).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">", 1)
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
                        unescape(F.substr(p, F.length(head) + len(MIDDLE) + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_trees(nodes: DataFrame, tree: str, node: str, parent: str, score: str, role: str, text: str,
                 per_tree: int = 1, trained: str = "assistant") -> DataFrame:
    """Format the best paths of reply trees: rows (``tree_key``, ``rank``, ``formatted``, ``loss_spans``)."""
    paths = best_paths(nodes, tree, node, parent, score, per_tree)
    content = (nodes.select(_key(F.col(f"`{tree}`")).alias("tree_key"), _key(F.col(f"`{node}`")).alias("node_key"),
                            F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
               .groupBy("tree_key", "node_key").agg(F.min(F.struct("role", "text")).alias("x"))
               .select("tree_key", "node_key", "x.role", "x.text"))
    rows = paths.join(content, ["tree_key", "node_key"])
    return format_conversations(rows, ["tree_key", "rank"], "position", "role", "text", trained)


EXTRA_TURN = "\\### Assistant: </turn> ok"


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Conversation rows as trees in which each turn replies to the one before it (order: turn, role, text)."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(by_turn)
    return rows.select("conv_id", "role", "text", n.alias("node"),
                       F.when(n > 1, n - 1).alias("parent"), F.lit(0.0).alias("score"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back and digested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(EXTRA_TURN).alias("text"))
    trees = checkpoint(conversations_as_trees(rows.union(extra)))
    done = format_trees(trees, "conv_id", "node", "parent", "score", "role", "text")
    read = done.select("tree_key", "formatted", read_turns(F.col("formatted")).alias("turns"),
                       read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(F.col("tree_key") != "n", F.substr("tree_key", F.lit(2))).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 16 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g'))
            + length(replace(replace(text, '\', '\s'), '<', '\l')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
