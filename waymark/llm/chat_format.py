"""Chat formatting over reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score.

A message has a tree, a node, a parent, a role, a text and a score. Each round of self-joins doubles the distance of
every node's ancestor pointer, so a tree of depth d takes log2(d) rounds. A leaf's score is the sum over its path; the
``top`` best leaves of each tree are formatted, each path as one conversation.

A null text or role is empty, a null score is 0. A parent that is not in the tree makes its child a root. Nodes on a
cycle have no root and are left out. Of rows that repeat a (tree, node) the smallest (parent, role, text, score) counts.
Equal scores are ranked by node. An empty table gives an empty result. A null tree is a tree of its own. Columns other than
those named are not read, so their names may clash. A path is one row of the result, so a very long text or path has to
fit one task; writing and reading it back takes time in proportion to its length, however many turns it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_or_empty

#: The chat template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
SALTS = 64


def escape(text: Column) -> Column:
    r"""No control string survives: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``, and on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def best_paths(messages: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(tree, leaf, node, pos, branch) of the chosen paths. ``messages``: tree (not null), node, parent, score; keys unique."""
    ids = messages.select("tree", "node", "parent", "score")
    known = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    jumps = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_there"), F.col("parent")).alias("up"), F.col("score").alias("total")
    )
    every = scratch.save(jumps, "jump0")
    leaves = every.select("tree", "node").join(every.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    rounds = max(1, math.ceil(math.log2(max(2, every.count()))) + 1)
    levels = [every.where("up IS NOT NULL")]
    while len(levels) <= rounds and not levels[-1].isEmpty():  # only nodes that haven't met their root are joined again
        above = every.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"))
        doubled = levels[-1].join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"))
        every = scratch.save(every.where("up IS NULL").unionByName(doubled), f"jump{len(levels)}")
        levels.append(every.where("up IS NOT NULL"))
    scored = leaves.join(every.where("up IS NULL"), ["tree", "node"])
    order = [F.col("total").desc(), F.col("node").asc()]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    some = salted.withColumn("branch", F.row_number().over(Window.partitionBy("tree", "_salt").orderBy(*order))).where(F.col("branch") <= top)
    best = some.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("branch") <= top)
    paths = best.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"), "branch")
    for k, j in enumerate(levels[:-1]):  # heights below 2**k are known; these add 2**k
        further = paths.join(j.select("tree", "node", "up"), ["tree", "node"])
        paths = paths.unionByName(further.select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height"), "branch"))
        paths = scratch.save(paths, f"paths{k}")
    return paths


def format_trees(
    messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text",
    score: str = "score", top: int = 1, train_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """tree, branch, leaf, n_turns, formatted, loss_spans (array of turn, from 0, and begin, length in code points of the formatted text)."""
    scratch = Scratch(messages.sparkSession)
    m = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-")).alias("tree"), F.col(tree).alias("_tree"),
        F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), text_or_empty(role).alias("role"),
        text_or_empty(text).alias("text"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
    )
    m = m.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score", "_tree")).alias("_"))
    m = scratch.save(m.select("tree", "node", "_.*"), "messages")
    turns = best_paths(m, scratch, top).join(m.select("tree", "node", "role", "text", "_tree"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    turns = turns.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    w = Window.partitionBy("tree", "leaf").orderBy(F.col("height").desc())
    before = F.coalesce(F.sum(F.length("_piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.struct((F.row_number().over(w) - 1).alias("turn"), (before + F.length("_head")).cast("long").alias("begin"), F.length("_body").cast("long").alias("length"))
    turns = turns.withColumn("_span", F.when(F.col("role").isin(*train_roles), span)).withColumn("_at", -F.col("height"))
    out = turns.groupBy("tree", "leaf").agg(
        F.first("_tree").alias("_tree"), F.first("branch").alias("branch"), F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("_at", "_piece", "_span"))).alias("_turns"),
    )
    spans = F.filter(F.col("_turns._span"), lambda x: x.isNotNull())
    formatted = F.array_join(F.col("_turns._piece"), "")
    return out.select(F.col("_tree").alias("tree"), "branch", "leaf", "n_turns", formatted.alias("formatted"), spans.alias("loss_spans"))


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by (turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(w).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), node.alias("node"), (node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, n_turns, turns (array of role, text), loss_text and formatted_chars, all parsed from the formatted text.

    The text is cut at its turns once, and a span is taken from its own turn, not from the start of the text.
    """
    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    def masked(parts: Column) -> Column:
        body = lambda s, part: F.substring(part, F.length(F.substring_index(part, "\n", 1)) + 2, s["length"].cast("int"))
        return F.array_join(F.transform("loss_spans", lambda s: unescape(body(s, F.get(parts, s["turn"])))), "")

    def read(parts: Column) -> Column:
        return F.struct(F.size(parts).cast("long").alias("n_turns"), F.transform(parts, turn).alias("turns"), masked(parts).alias("loss_text"))

    parts = F.filter(F.split("formatted", F.lit(r"<\|im_start\|>")), lambda x: x != "")
    cut = F.get(F.transform(F.array(parts), read), F.lit(0))  # a lambda names the cut text, so it is cut once
    back = formatted.select("tree", cut.alias("_"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("tree", "_.*", "formatted_chars")


#: The conversation that the query adds.
ADDED = "<|im_end|><|im_start|>assistant ok"
SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{ADDED}'), (-1, 1, 'assistant', '{ADDED}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('{START}') + 1 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(ADDED).alias("text"))
    back = read_back(format_trees(conversation_tree(table.unionByName(added))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), "n_turns", F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
