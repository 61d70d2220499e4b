"""Chat formatting of reply trees.

Messages name the message they answer. Jump tables (each message's 2^k-th ancestor) come from joining
the table with itself, so a tree of depth d takes log2(d) rounds; they give every message the score of
its path from the root. Leaves are the ends of paths; the best paths of a conversation are formatted,
each as one conversation.

Format of a turn: ``<|im_start|>`` role, line feed, text, ``<|im_end|>`` line feed. In texts and roles
a backslash is put before every backslash and between the two characters of ``<|`` (in roles also
before a line feed), so no text can hold a control string, and dropping each backslash that precedes a
character gives the text back.

Rules: null text and null role are empty. A parent that is null or not in the conversation makes a
root. Messages on a cycle, or below one, have no root and are in no path. Messages must be unique in
(conversation, id); ``by_turn`` makes ids from turns and keeps repeated rows as turns of their own. Equal
scores: the smaller leaf id wins. A conversation's formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage
from .common import row_key

# The chat format's control strings (fixed values).
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def by_turn(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: every turn answers the one before it. Adds id, parent and score."""
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    numbered = rows.select(F.col(conv).alias("conv"), "role", "text", F.row_number().over(order).cast("bigint").alias("id"))
    return numbered.withColumns({"parent": F.when(F.col("id") > 1, F.col("id") - 1), "score": F.lit(0.0)})


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, conv, id, score, depth) of the messages that have a root, and the jump tables."""
    count = nodes.count()
    state = nodes.select("node", "conv", "id", F.col("up").alias("jump"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("bigint").alias("depth"))
    tables: list[DataFrame] = []
    done = state.filter(F.col("jump").isNull())
    state = cut_lineage(state)
    # A path has no more messages than the table; what still jumps after that is on a cycle.
    while 1 << len(tables) <= count:
        active = state.filter(F.col("jump").isNotNull())
        if active.isEmpty():
            break
        tables.append(active.select("node", "jump"))
        far = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("score").alias("more"), F.col("depth").alias("deeper"))
        moved = active.join(far, "jump").select("node", "conv", "id", F.col("next").alias("jump"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth"))
        state = cut_lineage(state.filter(F.col("jump").isNull()).unionByName(moved))
    done = state.filter(F.col("jump").isNull()).drop("jump")
    return done, tables


def format_trees(messages: DataFrame, best: int | None = 1, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format the ``best`` paths of each conversation by mean score (None: all paths).

    ``messages``: conv, id, parent, role, text, score; other columns are ignored. Returns conv, path
    (rank from 1), leaf, score, n_turns, formatted and loss: the code point ranges (start, end) of
    formatted that are trained on, one for each turn whose role is in ``train``.
    """
    keyed = messages.select("conv", "id", "parent", "role", "text", "score").withColumns({"node": row_key("conv", "id"), "above": F.when(F.col("parent").isNotNull(), row_key("conv", "parent"))})
    parents = keyed.select(F.col("node").alias("above"), F.col("node").alias("up"))
    asks, roots = keyed.filter(F.col("above").isNotNull()), keyed.filter(F.col("above").isNull())
    narrow = ["node", "conv", "id", "score"]
    nodes = cut_lineage(
        asks.join(parents, "above", "left").select(*narrow, "up").unionByName(roots.select(*narrow, F.lit(None).cast("string").alias("up")))
    )
    rooted, tables = _jumps(nodes)
    answered = nodes.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
    leaves = rooted.join(answered, "node", "left_anti").withColumn("score", F.col("score") / F.col("depth"))
    if best == 1:
        first = leaves.groupBy("conv").agg(F.min(F.struct((-F.col("score")).alias("minus"), "id", "node", "depth")).alias("b"))
        chosen = first.select("conv", F.lit(1).alias("path"), F.col("b.id").alias("leaf"), (-F.col("b.minus")).alias("score"), F.col("b.node").alias("node"), F.col("b.depth").alias("depth"))
    else:
        ranked = leaves.withColumn("path", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "id")))
        chosen = ranked.filter(F.col("path") <= best) if best else ranked
        chosen = chosen.select("conv", "path", F.col("id").alias("leaf"), "score", "node", "depth")

    # Every message of a path: the first 2^k from its leaf upwards lead to the next 2^k.
    on_path = chosen.select(F.col("node").alias("end"), "node", F.col("depth").alias("position"))
    for k, jumps in enumerate(tables):
        more = on_path.join(jumps, "node").select("end", F.col("jump").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        on_path = cut_lineage(on_path.unionByName(more))

    header = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = on_path.join(keyed.select("node", header.alias("header"), escape(F.col("text")).alias("body"), F.coalesce("role", F.lit("")).alias("role")), "node")
    before = Window.partitionBy("end").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("header") + F.length("body") + len(END)
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("header"))
    turn = F.struct("position", F.concat("header", "body", F.lit(END)).alias("segment"), F.col("role").isin(*train).alias("learn"), "at", (F.col("at") + F.length("body")).alias("to"))
    grouped = placed.groupBy("end").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return (
        grouped.join(chosen.withColumnRenamed("node", "end"), "end")
        .select(
            "conv",
            "path",
            "leaf",
            "score",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["at"].cast("bigint").alias("start"), t["to"].cast("bigint").alias("end"))).alias("loss"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array of (role, text)."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    role = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, role, 1)).alias("role"),
            unescape(F.substr(p, F.length(F.regexp_extract(p, role, 0)) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, read back."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substr(formatted, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")
