"""Chat formatting: every assistant turn becomes an example of its own, all turns before it are its context.

A conversation is formatted once, as a stream of turn segments with running offsets. Because the context of an example is
everything before its reply, an example is a prefix of that stream: ``examples`` gives one row per assistant turn with the end
of its prefix and the one stretch of it that is trained on, and ``written`` writes every prefix out, n * n texts' worth for a
conversation of n turns, ``BLOCK`` of them at a time. ``digests`` reads those texts back. All of it is DataFrame functions.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, in roles
a line break becomes ``\\n`` as two characters; so ``<|`` in the stream always begins a mark, and ``unescape`` restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
#: Examples of a conversation that are written out in one place; a longer conversation's are spread over tasks.
BLOCK = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Pieces between doubled backslashes hold only ``<\\|`` for ``<|``."""
    return F.array_join(
        F.transform(F.split(text, r"\\\\", -1), lambda part: F.replace(part, F.lit("<\\|"), F.lit("<|"))), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(role, r"\\\\", -1),
            lambda part: F.replace(F.replace(part, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n")),
        ), "\\")


def segments(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: conv, position (from 0), trained, segment, start, end, loss_start, loss_end.

    Offsets count characters of the conversation's stream; ``end`` is the character after the segment. Turns are ordered by
    turn (null first), then role and text, so that equal turn numbers have a fixed order; repeated rows are turns of their own.
    Null roles and texts are empty; a null conversation id is a conversation of its own. Other columns are not read. An
    untrained turn has an empty stretch, both of its ends null.
    """
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    made = (
        rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
        .withColumn("segment", F.concat("head", "body", F.lit(CLOSE)))
        .withColumn("position", F.row_number().over(order) - 1)
        .withColumn("end", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.length("segment"))
    )
    trained = F.col("role") == TRAINED_ROLE
    loss_start = F.col("start") + F.length("head")
    return made.select(
        "conv", "position", trained.alias("trained"), "segment", "start", "end",
        F.when(trained, loss_start).alias("loss_start"), F.when(trained, loss_start + F.length("body")).alias("loss_end"),
    )


def examples(stream: DataFrame) -> DataFrame:
    """One row per assistant turn: conv, example (its position), context_turns, chars, loss_start, loss_end, reply.

    The example's text is the first ``chars`` characters of the conversation's stream, and only characters from ``loss_start``
    up to ``loss_end`` are trained on; ``reply`` holds just those, still escaped.
    """
    reply = F.substr("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return stream.where("trained").select(
        "conv", F.col("position").alias("example"), F.col("position").alias("context_turns"), F.col("end").alias("chars"),
        "loss_start", "loss_end", reply.alias("reply"),
    )


def written(stream: DataFrame) -> DataFrame:
    """conv, example (a row of ``examples`` without conv), turns, text: every example written out, all turns before its reply first.

    With a null example, once for each conversation, stands the text of all its turns; ``turns`` are the segments that were
    written. A block of a conversation's examples has the turns up to its last reply, and the last block has all of them.
    """
    conversation = Window.partitionBy("conv")
    before = F.count_if("trained").over(conversation.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    last = F.floor(F.greatest(F.count_if("trained").over(conversation) - 1, F.lit(0)) / BLOCK)
    turns = stream.select("conv", F.struct("position", "segment").alias("turn"), F.floor(before / BLOCK).alias("since"), last.alias("last"))
    turns = turns.select("conv", "turn", "last", F.explode(F.sequence(F.least("since", "last"), "last")).alias("block"))
    made = examples(stream)
    made = made.select(
        "conv", F.struct(*[c for c in made.columns if c != "conv"]).alias("target"),
        F.floor((F.row_number().over(conversation.orderBy("example")) - 1) / BLOCK).alias("block"))
    both = turns.select("conv", "block", "turn", (F.col("block") == F.col("last")).alias("whole")).unionByName(made, allowMissingColumns=True)
    # Rows lie by conversation already, which would do for the groups: blocks are dealt out all the same.
    grouped = both.repartition("conv", "block").groupBy("conv", "block").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.collect_list("target").alias("targets"), F.bool_or("whole").alias("whole"))
    nothing = F.lit(None).cast(made.schema["target"].dataType)
    wanted = F.when(F.col("whole"), F.array_append("targets", nothing)).otherwise(F.col("targets"))
    rows = grouped.select("conv", F.transform("turns", lambda t: t["segment"]).alias("turns"), F.explode(wanted).alias("example"))
    count = F.when(F.col("example").isNull(), F.size("turns")).otherwise(F.greatest(F.col("example.context_turns") + 1, F.lit(0))).cast("int")
    rows = rows.select("conv", "example", F.slice("turns", F.lit(1), count).alias("turns"))
    return rows.withColumn("text", F.array_join("turns", ""))


def example_texts(stream: DataFrame) -> DataFrame:
    """The examples written out: conv, example, text, loss_start, loss_end."""
    return written(stream).where("example is not null").select("conv", "example.example", "text", "example.loss_start", "example.loss_end")


def parse(segment: Column) -> Column:
    """A segment's role and text, read back from the template."""
    inner = F.substr(segment, F.lit(len(OPEN) + 1), F.length(segment) - len(OPEN) - len(CLOSE))
    cut = F.instr(inner, "\n")
    return F.struct(
        unescape_role(F.substr(inner, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substr(inner, cut + 1, F.length(inner) - cut)).alias("text"),
    )


def cut(text: Column) -> Column:
    """The segments of a written text, cut at its closing marks."""
    return F.transform(F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda piece: piece != ""), lambda piece: F.concat(piece, F.lit(CLOSE)))


def read_back(stream: DataFrame) -> DataFrame:
    """conv, position, segment, start, end, turn (role and text): what the conversations' written streams read back as.

    A stream is one text, cut at its closing marks; positions and offsets are those of the pieces found, not those of ``stream``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("position", "segment")))
    whole = stream.groupBy("conv").agg(F.array_join(F.transform(ordered, lambda t: t["segment"]), "").alias("text"))
    made = whole.select("conv", F.posexplode(cut(F.col("text"))).alias("position", "segment"))
    upto = Window.partitionBy("conv").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("segment").cast("long")).over(upto)
    return made.withColumn("end", end).withColumn("start", F.col("end") - F.length("segment")).withColumn("turn", parse(F.col("segment")))


def digests(stream: DataFrame) -> DataFrame:
    """Per conversation what reads back from the texts of ``written``: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``n_examples``, ``example_chars`` and the trained texts are those of the examples as they are written. One counts if its text
    reads back: cut at its closing marks it is the turns before the reply, ``context_turns`` of them, and the reply, ``chars``
    characters together, and the stretch from ``loss_start`` to ``loss_end`` is the reply and all that the last turn says. Turns are
    counted and digested from the text of the whole conversation, the one place where a digest needs them all.
    """
    rows = written(stream).select("conv", "turns", "example.*", "text", F.col("example").isNull().alias("whole"))
    rows = rows.withColumn("found", cut(F.col("text")))
    rows = rows.withColumn("closing", parse(F.try_element_at("found", F.lit(-1)))).withColumn(
        "span", F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = rows.withColumn("loss", unescape(F.col("span")))
    holds = (
        (F.col("found") == F.col("turns")) & (F.size("found") == F.col("context_turns") + 1) & (F.length("text") == F.col("chars"))
        & (F.col("closing.role") == TRAINED_ROLE) & (F.col("span") == F.col("reply")) & (F.col("loss") == F.col("closing.text"))
        & (F.col("loss_end") + len(CLOSE) == F.col("chars"))
    )
    said = F.transform(F.transform("found", parse), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = rows.select(
        "conv", "example", F.coalesce(~F.col("whole") & holds, F.lit(False)).alias("trained"), "loss", F.length("text").cast("long").alias("chars"),
        F.when(F.col("whole"), F.struct(
            F.size("found").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
            F.length("text").cast("long").alias("formatted_chars"))).alias("whole"),
    )
    grouped = rows.groupBy("conv").agg(
        F.max("whole").alias("whole"), F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("example", "loss")))).alias("losses"),
        F.coalesce(F.sum(F.when(F.col("trained"), F.length("loss").cast("long"))), F.lit(0)).cast("long").alias("loss_chars"),
        F.count_if("trained").alias("n_examples"),
        F.coalesce(F.sum(F.when(F.col("trained"), F.col("chars"))), F.lit(0)).cast("long").alias("example_chars"),
    )
    loss = F.array_join(F.transform("losses", lambda t: t["loss"]), "")
    return grouped.select(
        "conv", "whole.n_turns", "whole.turns_sha256", "loss_chars", F.sha2(loss, 256).alias("loss_sha256"),
        "whole.formatted_chars", "n_examples", "example_chars",
    )
