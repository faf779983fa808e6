"""Conversations from reply trees (operator 8), with DataFrame functions alone.

Messages are nodes of trees: a null or unknown parent makes a root, a node without replies a leaf.  Iterative
self-joins on the parent link double their reach each round (node to its 2^k-th ancestor), so a path of n turns takes
log2(n) rounds; they carry ids only.  Each leaf then has one row per ancestor, joined once to the texts and grouped to
one conversation per path.  Branches of a tree are ranked by the sum of their scores.

Template: ``<s>role``, a new line, the text, ``</s>`` and a new line.  Control strings inside roles and texts get a
backslash behind their first character, and those that already have backslashes there one more, so that taking one away
restores them; new lines in roles are escaped too.  The loss mask lists where assistant texts stand in the result.

Defined results: a null text or role is empty; a message without tree or node id takes no part; of rows that share both
the first by (parent, role, text) counts; messages on or below a cycle of parents belong to no path; a null score is 0;
equal scores are ranked by leaf id.  One path is one row of the result and has to fit one task, as its text is one value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import remove, write

START, MIDDLE, STOP = "<s>", "\n", "</s>\n"
ASSISTANT = "assistant"
# Fixed control strings: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>
_TAIL = r"(/?s>|/?INST\]|</?SYS>>)"
CONTROL = r"(<|\[)(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)\\" + _TAIL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # Between doubled backslashes every other one stands before an n.
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def _paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, up: every node on the way from a leaf to its root, ``up`` steps above the leaf."""
    spark = nodes.sparkSession
    kinds = {n: nodes.schema[n].dataType.simpleString() for n in ("tree", "node")}
    parents = nodes.select("tree", F.col("node").alias("parent"))
    links = nodes.select("tree", "node", "parent").join(parents, ["tree", "parent"], "left_semi").select(
        "tree", "node", F.col("parent").alias("far"))
    jump_schema = f"tree {kinds['tree']}, node {kinds['node']}, far {kinds['node']}"
    jumps = [write(links, "jumps")]
    most = 1 + math.ceil(math.log2(nodes.count() + 2))

    def jump(k: int) -> DataFrame:
        return spark.read.schema(jump_schema).parquet(jumps[k])

    while len(jumps) <= most and not jump(-1).isEmpty():
        step = jump(-1)
        onward = step.select("tree", F.col("node").alias("far"), F.col("far").alias("farther"))
        jumps.append(write(step.join(onward, ["tree", "far"]).select("tree", "node", F.col("farther").alias("far")), "jumps"))
    # After more steps than there are nodes only cycles, and what hangs on them, go on.
    endless = jump(-1).select("tree", "node")
    ends = nodes.select("tree", "node").join(
        jump(0).select("tree", F.col("far").alias("node")), ["tree", "node"], "left_anti").join(endless, ["tree", "node"], "left_anti")
    schema = f"tree {kinds['tree']}, leaf {kinds['node']}, node {kinds['node']}, up bigint"
    path = write(ends.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    for k in range(len(jumps) - 1):
        pairs = spark.read.schema(schema).parquet(path)
        more = pairs.join(jump(k), ["tree", "node"]).select(
            "tree", "leaf", F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        following = write(pairs.union(more), "paths")
        remove(spark, path)
        path = following
    for old in jumps:
        remove(spark, old)
    return spark.read.schema(schema).parquet(path)


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """tree, leaf, rank, score, n_turns, formatted, loss: one row per root-to-leaf path.

    ``messages``: tree, node, parent, role, text, score.  ``branches`` keeps the best-ranked paths of each tree.
    ``loss`` is an array of (start, length) in code points of ``formatted``, of the escaped assistant texts.
    """
    first = W.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    nodes = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.filter("tree IS NOT NULL AND node IS NOT NULL").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    pairs = _paths(nodes)
    scored = pairs.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
        pairs = pairs.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turn = nodes.select(
        "tree", "node", (F.col("role") == ASSISTANT).alias("learn"), escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.select(
        "tree", "node", "learn", F.concat(F.lit(START), "head", F.lit(MIDDLE), "body", F.lit(STOP)).alias("turn"),
        (F.char_length("head") + len(START) + len(MIDDLE)).cast("long").alias("skip"), F.char_length("body").cast("long").alias("chars"))
    rows = pairs.join(turn, ["tree", "node"])
    before = W.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0)) + F.col("skip"))
    parts = placed.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct("start", F.col("chars").alias("length"))))).alias("loss"))
    return parts.join(ranked, ["tree", "leaf"]).select(
        "tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    def turn(part: Column) -> Column:
        head = F.substring_index(part, MIDDLE, 1)
        at = F.char_length(head) + len(MIDDLE)
        body = F.substring(part, at + 1, F.char_length(part) - at - len(STOP))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(F.split(formatted, START, -1), 2, 1 << 30), turn)


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    texts = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(texts, "")


def chained(turns: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Messages of trees without branches: each row replies to the one before it by ``order``."""
    place = F.row_number().over(W.partitionBy(tree).orderBy(*order)).cast("long")
    rows = turns.select(F.col(tree).alias("tree"), place.alias("node"), "role", "text", F.lit(0.0).alias("score"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def digests(paths: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    read = paths.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
