"""Operator 3: relational chat formatting, in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of one role become one block; texts and marks are joined into one
string.  A block is ``START role TEXT text (TURN text)* END``.

Texts and roles are escaped: a control string keeps its first character and
gets a backslash behind it (behind those already there), so no mark can come
out of a text, and removing one backslash restores it.

The loss mask comes as ``segments``: the lengths (code points) of the
formatted string's consecutive stretches and whether each counts for the
loss; only assistant texts do.

Defined results: null role or text: empty; turns with equal numbers are
ordered by role and text, rows without a number come first; repeated rows are
repeated turns; null conv_id is a conversation of its own; an empty table
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, TURN, END = "<|im_start|>", "<|im_text|>", "<|im_turn|>", "<|im_end|>"  # this template's marks
# Control strings of common chat templates, by what follows their first
# character; none of them holds '<', '[' or a backslash after it.
CONTROL = r"<(?=\\*(?:/?s>|\|[a-z_]+\|>|/?SYS>>))|\[(?=\\*/?INST\])"
ESCAPED = CONTROL.replace(r"(?=\\*", r"\\(?=\\*")
MARK = r"<\|im_(?:start|text|turn|end)\|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, f"({CONTROL})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED.replace("<", "(<)", 1).replace(r"|\[", r"|(\[)", 1), "$1$2")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text), in order."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return (conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
                    .alias("turns")))


def with_blocks(turns: DataFrame) -> DataFrame:
    """``turns`` with ``blocks``: array of (role, texts), adjacent turns of a
    role merged.  Work in proportion to the turns: block starts are found by
    comparing neighbours, and each block is one slice."""
    n, t = F.size("turns"), F.col("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(n))
    bounds = F.arrays_zip(F.col("starts").alias("from"), F.col("ends").alias("to"))
    return (turns.withColumn("starts", starts).withColumn("ends", ends).withColumn("blocks", F.transform(
        bounds, lambda b: F.struct(F.get(t, b["from"])["role"].alias("role"),
                                   F.slice(t, b["from"] + 1, b["to"] - b["from"])["text"].alias("texts"))))
            .drop("starts", "ends"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of (chars, in_loss))."""
    blocks = with_blocks(sorted_turns(conversations)).withColumn("blocks", F.transform("blocks", lambda b: F.struct(
        b["role"].alias("role"), escape(b["role"]).alias("shown"),
        F.transform(b["texts"], escape).alias("texts"))))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["shown"], F.lit(TEXT), F.array_join(b["texts"], TURN), F.lit(END))), "")

    def segment(chars, loss):
        return F.struct(chars.cast("int").alias("chars"), loss.alias("in_loss"))

    segments = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(segment(F.lit(len(START)), F.lit(False)), segment(F.char_length(b["shown"]), F.lit(False))),
        F.flatten(F.transform(b["texts"], lambda x, i: F.array(
            segment(F.when(i == 0, len(TEXT)).otherwise(len(TURN)), F.lit(False)),
            segment(F.char_length(x), b["role"] == "assistant")))),
        F.array(segment(F.lit(len(END)), F.lit(False))))))
    return blocks.select("conv_id", formatted.alias("formatted"),
                         F.filter(segments, lambda s: s["chars"] > 0).alias("segments"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of (role, text)) and loss_text, from the
    formatted string and its mask alone."""
    blocks = F.filter(F.split("formatted", F.lit(END.replace("|", r"\|"))), lambda b: b != "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, TEXT, -1), TURN.replace("|", r"\|")),
        lambda x: F.struct(unescape(F.substring(F.substring_index(b, TEXT, 1), len(START) + 1, 2**31 - 1)).alias("role"),
                           unescape(x).alias("text")))))
    parts = F.filter(F.split("formatted", f"(?={MARK})|(?<={MARK})"), lambda p: p != "")
    # where the parts are the mask's stretches, in order, those under it are read
    pairs = F.arrays_zip(F.col("parts").alias("part"), F.col("segments").alias("seg"))
    fits = F.forall(pairs, lambda p: F.char_length(p["part"]) == p["seg"]["chars"])
    loss = F.array_join(F.transform(F.filter(pairs, lambda p: p["seg"]["in_loss"]), lambda p: unescape(p["part"])), "")
    return chats.withColumn("parts", parts).select("conv_id", turns.alias("turns"),
                                                   F.when(fits, loss).alias("loss_text"), "formatted")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations and one probe
    conversation (id -7) whose texts hold control strings."""
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = read_back(format_chats(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
