"""Linking quotations to the messages they come from, and conversations in reply order.

DataFrame functions only. Lines are split by their quote marks into passages of one
level; a passage is known by the hash of its normalised text. The first message of a
conversation that holds a passage as its own text is the passage's origin. A message
answers the latest origin among its quotations of the lowest level that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablelearn.functions.columns import quoted
from tablelearn.session import store

# Quote marks at the start of a line, each with at most one blank behind it.
MARKS = r"^(?:[\x20\t]{0,3}>)+[\x20]?"


def line_level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, blanks of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def split_passages(messages: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``messages`` and ``passages``: array<struct<level, text>>.

    A passage is a longest run of lines of one level, without their marks. A null
    text has no passages.
    """
    lines = F.split(F.col(text), "\r\n|\n|\r", -1)
    levelled = messages.withColumn("__lines", lines).withColumn("__levels", F.transform("__lines", line_level))
    change = F.filter(
        F.sequence(F.lit(0), F.size("__levels") - 1),
        lambda i: (i == 0) | (F.get("__levels", i) != F.get("__levels", F.greatest(i - 1, F.lit(0)))),
    )
    marked = levelled.withColumn("__starts", F.when(F.size("__levels") > 0, change))
    passage = lambda start, k: F.struct(
        F.get("__levels", start).alias("level"),
        F.array_join(
            F.transform(
                F.slice("__lines", start + 1, F.coalesce(F.get("__starts", k + 1), F.size("__lines")) - start),
                lambda line: F.regexp_replace(line, MARKS, ""),
            ),
            "\n",
        ).alias("text"),
    )
    return marked.withColumn("passages", F.transform("__starts", passage)).drop("__lines", "__levels", "__starts")


def own_text(passages: str = "passages") -> Column:
    """The unquoted passages, one below the other, without blanks at the ends."""
    own = F.transform(F.filter(passages, lambda p: p["level"] == 0), lambda p: F.trim(F.regexp_replace(p["text"], r"^\s+|\s+$", "")))
    return F.array_join(F.filter(own, lambda t: t != ""), "\n")


def _key(text: Column) -> Column:
    clean = normalised(text)
    return F.when(clean != "", F.xxhash64(clean))


def _own_keys() -> Column:
    """Hashes of what others may quote of a message: its own text, its passages, their paragraphs and lines."""
    own = F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"])
    paragraphs = F.flatten(F.transform(own, lambda t: F.split(t, r"\n\s*\n", -1)))
    lines = F.flatten(F.transform(own, lambda t: F.split(t, "\n", -1)))
    units = F.concat(F.array(F.col("own")), own, paragraphs, lines)
    return F.array_compact(F.array_distinct(F.transform(units, _key)))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages without their quotations, linked to what they answer.

    ``messages``: conv_id, turn, role, text. Result: conv_id, turn, role, text (own
    text), n_quotes (quoted passages with text), n_linked (those with an origin),
    parent (turn that is answered, or null). An origin has a smaller turn in the same
    conversation; a quotation is matched as a whole, else by its first line. Equal
    rows are one message; rows that share conv_id and turn otherwise are all kept and
    linked each. Rows whose conv_id or turn is null are kept without links. Other
    columns are not read.
    """
    distinct = messages.select("conv_id", "turn", "role", "text").distinct()
    parsed = split_passages(distinct).withColumn("own", own_text())
    quoting = F.filter("passages", lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))
    parsed = store(
        parsed.select(
            "conv_id",
            "turn",
            "role",
            F.when(F.col("text").isNotNull(), F.col("own")).alias("text"),
            _own_keys().alias("keys"),
            F.transform(
                quoting,
                lambda p: F.struct(
                    p["level"].alias("level"),
                    _key(p["text"]).alias("whole"),
                    _key(F.get(F.split(F.trim(p["text"]), "\n", 2), F.lit(0))).alias("line"),
                ),
            ).alias("quotes"),
            # The text may be the only difference between rows with one place.
            F.xxhash64("role", "text").alias("row"),
        ),
        "messages",
    )
    # One row per passage of a conversation, however often it is said; written, so that
    # Spark can split large partitions of the join with it.
    origins = store(
        parsed.where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.explode("keys").alias("key"))
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("origin")),
        "origins",
    )
    asked = parsed.select("conv_id", "turn", "row", F.posexplode("quotes").alias("k", "quote")).select(
        "conv_id",
        "turn",
        "row",
        "k",
        F.col("quote.level").alias("level"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("rank"), F.col("quote.whole").alias("key")),
                F.struct(F.lit(1).alias("rank"), F.col("quote.line").alias("key")),
            )
        ).alias("try"),
    )
    hits = (
        asked.select("conv_id", "turn", "row", "k", "level", "try.rank", "try.key")
        .join(origins, ["conv_id", "key"])
        .where("origin < turn")
    )
    best = hits.groupBy("conv_id", "turn", "row", "k", "level").agg(F.min(F.struct("rank", "origin")).alias("best"))
    answers = best.groupBy("conv_id", "turn", "row").agg(
        F.count(F.lit(1)).alias("n_linked"),
        F.min(F.struct("level", (-F.col("best.origin")).alias("late"))).alias("answer"),
    )
    return parsed.join(answers, ["conv_id", "turn", "row"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.greatest(F.size("quotes"), F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        (-F.col("answer.late")).alias("parent"),
    )


def threads(linked: DataFrame) -> DataFrame:
    """conv_id, turn, thread (turn that the chain of answers began with), depth (answers in the chain).

    Chains are followed by doubling: each round a message takes over what the one it
    points to has reached, so a chain of n answers takes log2(n) rounds. Messages
    that have reached their beginning take no further part. Where rows share a place,
    the latest parent counts.
    """
    places = (
        linked.where("conv_id is not null and turn is not null")
        .groupBy("conv_id", "turn")
        .agg(F.max("parent").alias("parent"))
        .select(
            "conv_id",
            "turn",
            F.coalesce("parent", "turn").alias("at"),
            F.col("parent").isNotNull().cast("long").alias("depth"),
            F.col("parent").isNull().alias("done"),
        )
    )
    reached = store(places, "threads")
    while not reached.where("not done").isEmpty():
        targets = reached.select(
            "conv_id",
            F.col("turn").alias("at"),
            F.col("at").alias("next"),
            F.col("depth").alias("more"),
            F.col("done").alias("end"),
        )
        onward = (
            reached.where("not done")
            .join(targets, ["conv_id", "at"])
            .select("conv_id", "turn", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"))
        )
        reached = store(reached.where("done").union(onward), "threads")
    return reached.select("conv_id", "turn", F.col("at").alias("thread"), "depth")


def reply_order(messages: DataFrame) -> DataFrame:
    """Conversations in the order of replies, without quotations.

    The result of ``link_quotes`` with thread and depth, ordered by conversation, thread and
    turn: a message follows what it answers, threads stand together. The order is a
    range sort, so a conversation with most of the messages is spread over tasks.
    """
    linked = store(link_quotes(messages), "linked")
    joined = linked.join(threads(linked), ["conv_id", "turn"], "left")
    return joined.select(*[quoted(c) for c in linked.columns], "thread", "depth").orderBy("conv_id", "thread", "turn", "role", "text")
