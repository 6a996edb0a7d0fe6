"""Chat formatting: reply trees to one formatted conversation for each chosen branch.

Built from DataFrame operations only. Messages point to their parents. Iterative self-joins enumerate all
root-to-leaf paths: each round joins what is known of a leaf's path with ancestors twice as far away, so a tree of
depth d takes log2(d) rounds. Branches of a tree are ranked by their mean message score (then the longer, then
the smaller leaf), the best `keep` are chosen, and each is formatted as one conversation.

The template marks a turn as <|turn|>role<|text|>text<|end|>. Inside roles and texts, a control string
(any of <|  <s>  </s>  [|  [INST]  [/INST], here or in other templates) gets a backslash after its first character, and one that already has
backslashes there gets one more, so nothing in a text can open or close a turn and unescaping restores every text.

The loss mask is an array of (start, end) in code points of the formatted text: the texts of `learn` roles.

Defined cases: null texts and roles count as empty. Messages with a null conv_id are one conversation, and messages with a null node belong to no path. A parent that is missing makes its child a root. Messages on a
cycle belong to no path. Repeated messages are turns of their own where rows are numbered by `linear`. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

# The template's marks and the strings that are escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def linear(rows: DataFrame) -> DataFrame:
    """Messages of a table of (conv_id, turn, role, text): each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    rows = rows.select("conv_id", node.alias("node"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def keyed(messages: DataFrame) -> DataFrame:
    """The messages with conv_id as a struct, which is never null, so that a null conversation joins like any other."""
    return messages.withColumn("conv_id", F.struct("conv_id"))


def paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, node, distance (from the leaf) of every root-to-leaf path of `messages` (conv_id, node, parent)."""
    return _paths(keyed(messages)).withColumn("conv_id", F.col("conv_id.conv_id"))


def _paths(messages: DataFrame) -> DataFrame:
    nodes = shared.settle(messages.select("conv_id", "node", "parent").where("node IS NOT NULL"), "nodes")
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.select("conv_id", F.col("parent").alias("node")).where("node IS NOT NULL").distinct()
    found = shared.settle(nodes.join(parents, ["conv_id", "node"], "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")), "paths")
    jump = shared.settle(nodes.where("parent IS NOT NULL").join(nodes.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"]).select("conv_id", "node", F.col("parent").alias("up")), "jumps")
    step = 1
    while step < most:  # a path has at most as many messages as its conversation
        more = shared.settle(found.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", F.col("up").alias("node"), (F.col("distance") + step).alias("distance")), "paths")
        if more.isEmpty():
            break
        found = found.union(more)
        jump = shared.settle(jump.join(jump.select("conv_id", F.col("node").alias("up"), F.col("up").alias("further")), ["conv_id", "up"]).select("conv_id", "node", F.col("further").alias("up")), "jumps")
        step *= 2
    return found


def chosen(messages: DataFrame, keep: int = 1) -> DataFrame:
    """conv_id, branch (its rank), leaf, node, distance of the best branches."""
    return _chosen(keyed(messages), keep).withColumn("conv_id", F.col("conv_id.conv_id"))


def _chosen(messages: DataFrame, keep: int) -> DataFrame:
    every = _paths(messages)
    scored = every.join(messages.select("conv_id", "node", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), ["conv_id", "node"])
    ranks = scored.groupBy("conv_id", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("length"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("length"), "leaf"))
    best = ranks.withColumn("branch", rank).where(F.col("branch") <= keep).select("conv_id", "leaf", "branch")
    return every.join(best, ["conv_id", "leaf"])


def format_branches(messages: DataFrame, keep: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, branch, formatted and loss_mask for the best branches of each tree of `messages` (conv_id, node, parent, role, text, score)."""
    messages = keyed(messages)
    turns = _chosen(messages, keep).join(messages.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
    turn = F.struct((-F.col("distance")).alias("place"), "node", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"), F.col("role").isin(*learn).alias("learn"))
    rows = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")
    before, after = len(TURN) + len(TEXT), len(END)
    mask = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + before + after + F.length(t["role"]) + F.length(t["text"])).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + before + F.length(t["role"])).alias("start"), (acc["at"] + before + F.length(t["role"]) + F.length(t["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return rows.select("conv_id.conv_id", "branch", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (role, text) and loss_text, parsed from formatted texts and their masks alone."""
    parts = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(unescaped(F.substring_index(x, TEXT, 1)).alias("role"), unescaped(F.regexp_replace(F.substring_index(x, TEXT, -1), r"<\|end\|>$", "")).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(rows: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose turns look like another template's marks."""
    two = rows.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(two)


# The digest in DuckDB's SQL. Lengths of escaped texts follow from how many control strings a text has.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS role_, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS text_ FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(role_) + length(text_)) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
