"""Chat formatting over reply trees.

Messages form trees: each has a parent or starts a tree. Root-to-leaf paths are enumerated
by self-joins of the table of ancestors, whose reach doubles each time, so that a path of
n messages takes about log2(n) joins. Paths are ranked by the mean score of their
messages, and each chosen one is formatted as a conversation.

A turn is ``<|role|>``, a new line, the text, ``<|end|>`` and a new line. In texts and
roles a backslash is doubled and one is put after each ``<`` and ``[`` (after ``|`` too in
roles): no control string of this or the common templates survives inside a text, and
the marks can be taken out again. The loss mask lists the spans of assistant texts.

Defined cases: null texts and roles count as empty; rows without a conversation id form
one conversation; turns sort nulls first, then by role and text; repeated rows are turns of
their own; messages whose parent is missing start a tree, and so does each message of a
circle of replies, or one that replies to itself. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carequeue.operators.shared import written

END = "<|end|>\n"
LEARNED_ROLE = "assistant"
#: Length of paths from which on the longest conversation is asked for.
FIRST_LOOK = 16


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    bare = F.regexp_replace(text, r"([<\[])\\", "$1")
    return F.replace(bare, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("|\\"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("|\\"), F.lit("|")))


def linear_messages(rows: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) rows, each replying to the one before."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.to_json(F.struct("conv_id"))  # equal for equal ids, null included
    order = Window.partitionBy("_conv").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "_text"
    )
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("_text"))
        .withColumn("_conv", key)
        .select(
            "_conv",
            "conv_id",
            F.row_number().over(order).cast("long").alias("node"),
            "role",
            F.col("_text").alias("text"),
        )
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.lit(1.0))
    )


def paths(messages: DataFrame) -> DataFrame:
    """Rows (_conv, leaf, node, distance) of every path from a leaf to its root.

    ``reach`` holds each message's ancestor at distance 2^k. Joined with itself it doubles
    its reach; joined with the paths it doubles their length. Only ids are joined.
    """
    ids = messages.select("_conv", "node", "parent")
    known = ids.select("_conv", F.col("node").alias("parent"))
    reach = written(
        ids.join(known, ["_conv", "parent"], "left_semi").select(
            "_conv", "node", F.col("parent").alias("ancestor")
        ),
        "chat-reach",
    )
    parents = reach.select("_conv", F.col("ancestor").alias("node")).distinct()
    found = ids.join(parents, ["_conv", "node"], "left_anti").select(
        "_conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")
    )
    step, longest = 1, None
    while not reach.isEmpty():
        if step >= FIRST_LOOK and longest is None:
            longest = ids.groupBy("_conv").count().agg(F.max("count")).first()[0]
        if longest is not None and step > longest:
            # no chain is that long: what is still an ancestor lies on a circle of replies
            circles = reach.select("_conv", F.col("ancestor").alias("node")).distinct()
            on_one = circles.withColumn("_circle", F.lit(True))
            cut = F.when(F.col("_circle").isNull(), F.col("parent"))
            straight = ids.join(on_one, ["_conv", "node"], "left").withColumn("parent", cut)
            return paths(written(straight.drop("_circle"), "chat-straight"))
        further = found.join(reach, ["_conv", "node"]).select(
            "_conv", "leaf", F.col("ancestor").alias("node"), F.col("distance") + step
        )
        found = written(found.union(further), "chat-paths")
        again = reach.select("_conv", F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        reach = written(
            reach.join(again, ["_conv", "ancestor"]).select(
                "_conv", "node", F.col("far").alias("ancestor")
            ),
            "chat-reach",
        )
        step *= 2
    return found


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One row per chosen path: conv_id, leaf, rank, formatted text and loss spans.

    ``messages``: _conv, conv_id, node (unique in its _conv), parent, role, text, score.
    ``branches`` keeps the best paths of each tree set only where it is asked for.
    """
    steps = paths(messages)
    scored = steps.join(messages.select("_conv", "node", "score"), ["_conv", "node"])
    leaves = scored.groupBy("_conv", "leaf").agg(
        F.avg("score").alias("path_score"), F.max("distance").alias("_depth")
    )
    best = Window.partitionBy("_conv").orderBy(F.col("path_score").desc_nulls_last(), "leaf")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        leaves = leaves.where(F.col("rank") <= branches)

    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    pieces = messages.select("_conv", "conv_id", "node", "role", head.alias("_head"), escape(F.col("text")).alias("_body"))
    path = Window.partitionBy("_conv", "leaf").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    length = F.char_length("_head") + F.char_length("_body") + len(END)
    turns = (
        steps.join(leaves, ["_conv", "leaf"])
        .join(pieces, ["_conv", "node"])
        .withColumn("_pos", F.col("_depth") - F.col("distance"))
        .withColumn("_start", F.coalesce(F.sum(length).over(path), F.lit(0)) + F.char_length("_head"))
    )
    turn = F.struct(
        "_pos",
        F.concat("_head", "_body", F.lit(END)).alias("piece"),
        (F.col("role") == LEARNED_ROLE).alias("learned"),
        F.col("_start").cast("long").alias("start"),
        F.char_length("_body").cast("long").alias("length"),
    )
    gathered = turns.groupBy("_conv", "conv_id", "leaf", "rank", "path_score").agg(
        F.sort_array(F.collect_list(turn)).alias("_turns")
    )
    spans = F.transform(
        F.filter("_turns", lambda t: t.learned),
        lambda t: F.struct(t.start.alias("start"), t.length.alias("length")),
    )
    return gathered.select(
        "_conv",
        "conv_id",
        "leaf",
        "rank",
        "path_score",
        F.array_join(F.transform("_turns", lambda t: t.piece), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts of formatted conversations, from the output alone.

    The text is cut at the end marks. Where each turn's text lies follows from the lengths
    of the pieces before it; spans of the mask are matched with these places.
    """
    path = ["_conv", "leaf"]
    pieces = formatted.select(
        *path, F.posexplode(F.split("formatted", r"<\|end\|>\n", -1)).alias("_pos", "_piece")
    ).where("_piece != ''")
    before = Window.partitionBy(*path).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    pattern = r"(?s)^<\|(.*?)\|>\n(.*)$"
    turns = (
        pieces.withColumn("_role", F.regexp_extract("_piece", pattern, 1))
        .withColumn("_text", F.regexp_extract("_piece", pattern, 2))
        .withColumn(
            "start",
            F.coalesce(F.sum(F.char_length("_piece") + len(END)).over(before), F.lit(0))
            + F.char_length("_role")
            + 5,
        )
        .withColumn("length", F.char_length("_text").cast("long"))
    )
    mask = formatted.select(*path, F.explode("loss_spans").alias("_span")).select(
        *path, "_span.start", "_span.length", F.lit(True).alias("learned")
    )
    turn = F.struct(
        "_pos",
        unescape_role(F.col("_role")).alias("role"),
        unescape(F.col("_text")).alias("text"),
        F.coalesce("learned", F.lit(False)).alias("learned"),
    )
    read = (
        turns.join(mask, [*path, "start", "length"], "left")
        .groupBy(*path)
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    return formatted.select(*path, "conv_id", F.char_length("formatted").alias("formatted_chars")).join(read, path)


def digests(read: DataFrame) -> DataFrame:
    """The contract's columns of conversations that were read back."""
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""
    )
    learned = F.array_join(
        F.transform(F.filter("turns", lambda t: t.learned), lambda t: t.text), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
