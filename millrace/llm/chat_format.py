r"""Chat formatting of reply trees.

Native: DataFrame functions only. Ancestors are found by self-joins that double the distance (a tree
of depth d takes log2 d of them), each cut by checkpoint(); paths of the chosen leaves are expanded
from the same tables. Joins are on (tree, message), so that a very large tree spreads over all tasks;
only a chosen path itself, which is one output row, is gathered.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash becomes
``\\``, ``#`` becomes ``\h`` and ``<`` becomes ``\l``, in roles also ``:`` becomes ``\c``; neither a turn
mark nor an end mark can then appear there, and parsing needs no look-back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import checkpointed, held

FILE_NODES = 500_000

OPEN, CLOSE = "### ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """A run of backslashes starts at an escape, so pairs from its left are escaped backslashes."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    colon = lambda x: F.instr(x, ": ")
    return F.transform(turns, lambda x: F.struct(unescape(x.substr(F.lit(len(OPEN) + 1), colon(x) - F.lit(len(OPEN) + 1))).alias("role"), unescape(x.substr(colon(x) + 2, F.char_length(x))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """Everything under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def _on(left: DataFrame, right: DataFrame, key: str, other: str):
    return left["tree_id"].eqNullSafe(right["t"]) & (left[key] == right[other])


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree_id, id, up) for distances 1, 2, 4, ..., and per node its distance n to the top and the score sum s of its path."""
    there = nodes.select(F.col("tree_id").alias("t"), F.col("id").alias("p"))
    at = nodes.join(there, _on(nodes, there, "parent", "p"), "left").select("tree_id", "id", F.col("p").alias("up"), F.lit(1).cast("long").alias("n"), "s")
    at = held(at)
    total, tables = at.count(), []
    for _ in range(math.ceil(math.log2(max(total, 2))) + 1):
        if at.where("up is not null").isEmpty():
            break
        tables.append(at.select("tree_id", "id", "up"))
        above = at.select(F.col("tree_id").alias("t"), F.col("id").alias("p"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        further = at.where("up is not null")
        moved = further.join(above, _on(further, above, "up", "p")).select("tree_id", "id", F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("s") + F.col("s2")).alias("s"))
        at = checkpointed(at.where("up is null").unionByName(moved), files=-(-total // FILE_NODES))
    return tables, at.where("up is null").select("tree_id", "id", "n", "s")


def reply_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree_id, leaf, rank, score, pos, id): the messages of every root-to-leaf path, pos from 0 at the root.

    messages: tree_id, id, parent (null at roots), score. Branches of a tree rank by the mean score of
    their messages, ties by leaf id; keep is the number of branches wanted from each tree (None: all).
    A parent that isn't there makes its child a root; messages on or below a cycle lie on no path;
    of messages with equal (tree_id, id) one is used; messages without id are left out, a null tree_id
    is a tree like others, a null score counts as zero.
    """
    m = messages.where("id is not null").groupBy("tree_id", "id").agg(F.min("parent").alias("parent"), F.max(F.coalesce(F.col("score"), F.lit(0.0)).cast("double")).alias("s"))
    m = held(m)
    tables, top = _jumps(m)
    inner = m.where("parent is not null").select(F.col("tree_id").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = top.join(inner, _on(top, inner, "id", "p"), "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf")
    ranked = leaves.select("tree_id", F.col("id").alias("leaf"), "n", (F.col("s") / F.col("n")).alias("score")).withColumn("rank", F.row_number().over(order))
    if keep is not None:
        ranked = ranked.where(F.col("rank") <= keep)
    files = -(-m.count() // FILE_NODES)
    path = checkpointed(ranked.withColumns({"id": F.col("leaf"), "off": F.lit(0).cast("long")}), files)
    for k in range(len(tables) - 1, -1, -1):
        jump = tables[k].where("up is not null").select(F.col("tree_id").alias("t"), F.col("id").alias("p"), "up")
        further = path.where(F.col("n") - F.col("off") > (1 << k))
        above = further.join(jump, _on(further, jump, "id", "p")).select("tree_id", "leaf", "n", "score", "rank", F.col("up").alias("id"), (F.col("off") + (1 << k)).alias("off"))
        path = checkpointed(path.unionByName(above), files)
    return path.select("tree_id", "leaf", "rank", "score", (F.col("n") - 1 - F.col("off")).alias("pos"), "id")


def format_trees(messages: DataFrame, keep: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """(tree_id, leaf, rank, score, formatted, loss_spans): every chosen path as one conversation.

    messages: tree_id, id, parent, role, text, score (other columns are ignored). Null roles and texts
    are empty. loss_spans are (start, end) in code points of the escaped texts of loss_role.
    """
    one = messages.where("id is not null").groupBy("tree_id", "id").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    said = one.select(F.col("tree_id").alias("t"), F.col("id").alias("p"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    path = reply_paths(messages.select("tree_id", "id", "parent", "score"), keep)
    rows = path.join(said, _on(path, said, "id", "p")).select("tree_id", "leaf", "rank", "score", "pos", "role", head(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    before = F.coalesce(F.sum(F.char_length("head") + F.char_length("body") + len(CLOSE)).over(Window.partitionBy("tree_id", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + F.char_length("head")
    rows = rows.withColumns({"start": start.cast("int"), "end": (start + F.char_length("body")).cast("int")})
    turn = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("role") == loss_role, F.struct("start", "end")).alias("span"))
    held = rows.groupBy("tree_id", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.filter(F.col("turns")["span"], lambda s: s.isNotNull())
    return held.select("tree_id", "leaf", "rank", "score", F.array_join(F.col("turns")["turn"], "").alias("formatted"), spans.alias("loss_spans"))
