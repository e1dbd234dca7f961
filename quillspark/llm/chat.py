"""Chat formatting of reply trees, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Settled, settle

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """No control string survives: every backslash becomes a backslash and 0, every <| gets a backslash and 1 between."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\1|"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line break, so its own are escaped as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: each node's ancestor 2^k steps up, where there is one.

    Each table is its predecessor joined with itself, so a tree of depth d takes log2(d) joins. On a cycle of parents
    the tables never run out; they end once a table's step exceeds the number of nodes.
    """
    total = nodes.count()
    table = Settled(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up")), "jump")
    tables = []
    while table.df.limit(1).count():
        tables.append(table.df)
        if 1 << len(tables) > 2 * total:
            break
        upper = table.df.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        table = Settled(table.df.join(upper, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "jump")
    return tables


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, depth) of every root-to-leaf path; depth is 0 at the root.

    ``nodes`` has tree, of any type, node and parent, both long, each (tree, node) once. A parent that isn't there makes a root. A
    path is enumerated by self-joins with the ancestors 2^k steps up, largest step first: each doubles what is known,
    so rows never exceed the paths' own length. Nodes on cycles of parents, and what hangs on them, have no root and
    are left out.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    sound = settle(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent")), "nodes")
    parents = sound.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    steps = sound.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_from_leaf"))
    for k, jump in reversed(list(enumerate(_jumps(sound)))):
        higher = steps.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("up_from_leaf") + (1 << k)).alias("up_from_leaf"))
        steps = settle(steps.unionByName(higher), "steps")
    roots = sound.where("parent is null").select("tree", "node", F.lit(1).alias("root"))
    ends = steps.join(roots, ["tree", "node"]).groupBy("tree", "leaf").agg(F.max("up_from_leaf").alias("length"))
    return steps.join(ends, ["tree", "leaf"]).select("tree", "leaf", "node", (F.col("length") - F.col("up_from_leaf")).alias("depth"))


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, branch_rank, score, formatted, loss_spans), one row per chosen root-to-leaf path.

    ``messages`` has tree, node, parent (both long), role, text and score. A branch scores the sum of its messages' scores
    (null: 0); a tree's branches rank by score, then by leaf, and the ``best`` ones are formatted (None: all). Null
    roles and texts are empty. loss_spans are the offsets, in characters of ``formatted``, of the escaped assistant
    texts. Of rows that repeat (tree, node) the least by parent, role,
    text and score counts. An empty table gives an empty result.
    """
    fields = ["parent", "role", "text", "score"]
    once = messages.groupBy("tree", "node").agg(F.min(F.struct(*fields)).alias("m")).select("tree", "node", *[f"m.{c}" for c in fields])
    walked = paths(once.select("tree", "node", "parent"))
    scored = walked.join(once.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    ranked = scored.withColumn("branch_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    chosen = ranked if best is None else ranked.where(F.col("branch_rank") <= best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = once.select("tree", "node", (role == "assistant").alias("loss"), head.alias("head"), escape(text).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    rows = walked.join(chosen, ["tree", "leaf"]).join(turns, ["tree", "node"])
    ends = F.sum(size).over(W.partitionBy("tree", "leaf").orderBy("depth"))
    placed = rows.withColumn("at", ends - size + F.length("head"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"), "loss", F.struct(F.col("at").cast("long").alias("start"), F.length("body").cast("long").alias("length")).alias("span"))
    whole = placed.groupBy("tree", "leaf").agg(F.first("branch_rank").alias("branch_rank"), F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree", "leaf", "branch_rank", "score",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows of linear conversations as reply chains: each row answers the one before it by turn (then role, text).

    The tree is the id as a string, empty for null, which is a conversation of its own beside those of all numbers.
    """
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans, one row per conversation; a null conv_id is a conversation too.

    Rows go by turn, null first; rows that repeat a turn all stay, in the order of role and text. Null texts are empty.
    """
    done = format_trees(settle(conversation_nodes(conversations), "turns"), best=1)
    return done.select(F.nullif("tree", F.lit("")).cast("long").alias("conv_id"), "formatted", "loss_spans")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation."""
    read = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH a AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\0'), '<|', '<\1|'), chr(10), '\2')) + length(replace(replace(text, '\', '\0'), '<|', '<\1|')) + 24 AS n FROM a)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
