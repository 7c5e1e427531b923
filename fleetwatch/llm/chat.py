"""Operator 10: conversations from reply trees.

Nodes of a forest ``(tree, node, parent, role, text, score)`` are joined with themselves:
after round k every node knows its 2^k-th ancestor and the score sum on the way, so a path of
depth d takes log2(d) self-joins. Branches are ranked per tree by mean score (ties: smaller
leaf), and only the chosen leaves are expanded to their paths, again by doubling. Each chosen
path becomes one formatted conversation with a loss mask over the assistant texts.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>``, newline. Inside role
and text a backslash becomes two and ``<|`` becomes ``<\\|``; a newline inside a role gets a
backslash in front. So no control string can occur in a text and reading back is exact.

Defined cases: null text or role is empty; a null score is 0; a parent that does not exist
makes its node a root; nodes on a cycle hang below no root and give no path; repeated rows of
a conversation are turns of their own, ties in ``turn`` ordered by role and text; a null
``conv_id`` is a conversation of its own; an empty table gives an empty result. The formatted
conversation is one value, so one conversation must fit into a task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sha256_hex, stored

START, END = "<|im_start|>", "<|im_end|>"


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    cond = F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    for x, y in pairs:
        cond = cond & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return cond


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """Rows of linear conversations as nodes, each the child of the row before it."""
    w = Window.partitionBy("tree").orderBy("o", "role", "text")
    return (rows.select(F.col(tree).alias("tree"), F.col(order).alias("o"), F.col(role).alias("role"),
                        F.col(text).alias("text"))
            .withColumn("node", F.row_number().over(w).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def paths(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, node, up): the nodes of the ``keep`` best branches of each tree (None: of
    all); ``up`` is the distance to the leaf."""
    links = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = links.select("tree", "node")
    first = (links.alias("a").join(known.alias("b"), _same("a", "b", ("parent", "node")), "left")
             .select("a.tree", "a.node", F.col("b.node").alias("jump"), F.lit(1).alias("dist"),
                     F.col("a.score").alias("total")))
    levels = [stored(first, "chat-level")]
    rounds = max(1, levels[0].count()).bit_length() + 1
    while len(levels) <= rounds and not levels[-1].where("jump IS NOT NULL").isEmpty():
        s = levels[-1]
        up = s.select("tree", F.col("node").alias("at"), F.col("jump").alias("next"), F.col("dist").alias("more"),
                      F.col("total").alias("plus"))
        # a node that has met its root is done; only the others are joined again
        onward = (s.where("jump IS NOT NULL").alias("a").join(up.alias("b"), _same("a", "b", ("jump", "at")))
                  .select("a.tree", "a.node", F.col("b.next").alias("jump"), (F.col("a.dist") + F.col("b.more")).alias("dist"),
                          (F.col("a.total") + F.col("b.plus")).alias("total")))
        levels.append(stored(s.where("jump IS NULL").unionByName(onward), "chat-level"))
    parents = levels[0].where("jump IS NOT NULL").select("tree", F.col("jump").alias("node")).distinct()
    leaves = (levels[-1].where("jump IS NULL").alias("a")
              .join(parents.alias("b"), _same("a", "b", ("node", "node")), "left_anti"))
    if keep is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("total") / F.col("dist")).desc(), "node"))
        leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= keep)
    walk = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up"))
    for k, level in enumerate(levels):
        jumps = level.where("jump IS NOT NULL").select("tree", "node", "jump")
        walk = walk.unionByName(
            walk.alias("a").join(jumps.alias("b"), _same("a", "b", ("node", "node")))
            .select("a.tree", "a.leaf", F.col("b.jump").alias("node"), (F.col("a.up") + F.lit(2 ** k)).alias("up")))
        if k % 2:
            walk = stored(walk, "chat-paths")
    return walk


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_paths(nodes: DataFrame, walk: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss): one conversation per path; ``loss`` holds the masked
    spans as code point offsets (start, length)."""
    turns = (walk.alias("p").join(nodes.alias("n"), _same("p", "n", ("node", "node")))
             .select("p.tree", "p.leaf", "p.up", F.coalesce("n.role", F.lit("")).alias("role"),
                     escape(F.coalesce("n.text", F.lit(""))).alias("text"))
             .withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")),
                                          F.lit("\n")))
             .withColumn("piece", F.concat("head", "text", F.lit(END + "\n"))))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0))
                             + F.char_length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"),
                                                         F.char_length("text").alias("length")))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", span.alias("span"))))
    return (turns.groupBy("tree", "leaf").agg(parts.alias("parts"))
            .select("tree", "leaf", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
                    F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained text parsed from the formatted conversations."""
    cut = F.split("formatted", r"<\|im_start\|>", -1)
    pieces = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))
    role = lambda t: unescape(F.regexp_extract(t, r"(?s)^((?:\\.|[^\\\n])*)\n", 1))
    body = lambda t: unescape(F.regexp_extract(t, r"(?s)^(?:\\.|[^\\\n])*\n(.*)<\|im_end\|>\n$", 1))
    turns = F.transform(pieces, lambda t: F.struct(role(t).alias("role"), body(t).alias("text")))
    trained = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", turns).withColumn("trained", F.array_join(trained, ""))


def digests(parsed: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.select(
        F.col("tree").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(F.array_join(lines, "")).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), sha256_hex(F.col("trained")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def format_conversations(rows: DataFrame) -> DataFrame:
    nodes = chain(rows)
    return format_paths(nodes, paths(nodes))
