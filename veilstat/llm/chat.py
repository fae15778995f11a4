"""Chat formatting with Spark expressions: rows of turns to one marked text for each conversation, and back.

Turns are sorted as structs (turn, role, text), neighbours of one role are merged into one block, and blocks are joined:

    <s>[INST]text[NEXT]text[/INST]</s>     user
    <s>text[NEXT]text</s>                  assistant
    <s>[ROLE]role[/ROLE]text</s>           any other role

``[NEXT]`` stands between merged turns. A control string inside a text or role gets a backslash after its first character, as
one more if it has some already; taking one away gives the text back, whatever it was.

The loss mask is a list of spans (start, length) in code points of the formatted text: every assistant text, without marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import let, running

CONTROL = r"/?(?:s>|(?:INST|ROLE|NEXT)\])"
TURNS = "array<struct<role:string,text:string>>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(rf"([<\[])(\\*)({CONTROL})"), F.lit(r"$1\\$2$3"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(rf"([<\[])\\(\\*)({CONTROL})"), F.lit("$1$2$3"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of start and length) from conv_id, turn, role, text.

    A null role or text is empty; equal turn numbers are ordered by role, then text, and repeated rows are turns of their own; null
    turn numbers come first; rows with a null conv_id are one conversation; other columns are ignored; an empty table gives
    none. A conversation is one row of output, so its turns are gathered in one place; there is no other shuffle.
    """
    empty = F.lit("")
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    got = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # Where blocks begin, then each block's slice of turns.
    cut = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    got = got.withColumn("cut", cut)
    blocks = F.transform(
        "cut",
        lambda a, k: F.struct(
            F.get("t", a)["role"].alias("role"),
            F.transform(F.slice("t", a + 1, F.coalesce(F.get("cut", k + 1), F.size("t")) - a), lambda x: escape(x["text"])).alias("texts"),
        ),
    )
    got = got.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.when(b["role"] == "user", "<s>[INST]").when(b["role"] == "assistant", "<s>").otherwise(F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]")))
    tail = lambda b: F.when(b["role"] == "user", "[/INST]</s>").otherwise("</s>")
    shown = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], "[NEXT]"), tail(b)))
    got = got.select("conv_id", "blocks", shown.alias("shown"))
    # Places: blocks by their lengths so far, texts of assistant blocks after their mark and one another.
    spans = "array<struct<start:int,length:int>>"

    def own(b: Column, at: Column) -> Column:
        ends = running(F.transform(b["texts"], lambda x: F.length(x) + 6))
        return let(ends, lambda e: F.transform(b["texts"], lambda x, j: F.struct((at + F.get(e, j) - F.length(x) - 3).alias("start"), F.length(x).alias("length"))))

    def loss(e: Column) -> Column:
        begin = lambda k: F.get(e, k) - F.length(F.get("shown", k))
        return F.flatten(F.transform("blocks", lambda b, k: F.when(b["role"] == "assistant", own(b, begin(k))).otherwise(F.array().cast(spans)))).cast(spans)

    walk = let(running(F.transform("shown", F.length)), loss)
    return got.select("conv_id", F.array_join("shown", "").alias("formatted"), walk.alias("loss"))


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, as they were before merging."""
    blocks = F.transform(F.filter(F.split(formatted, F.lit("</s>")), lambda b: b != ""), lambda b: F.substring(b, 4, F.length(b)))

    def turns(b: Column) -> Column:
        user, other = F.startswith(b, F.lit("[INST]")), F.startswith(b, F.lit("[ROLE]"))
        role = F.when(user, "user").when(other, unescape(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1))).otherwise("assistant")
        body = F.when(user, F.substring(b, 7, F.length(b) - 13)).when(other, F.regexp_replace(b, F.lit(r"(?s)^\[ROLE\].*?\[/ROLE\]"), F.lit(""))).otherwise(b)
        return F.transform(F.split(body, r"\[NEXT\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns)).cast(TURNS)


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def chat_digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    chats = format_chats(conversations)
    turns, own = parse_chats(F.col("formatted")), F.array_join(masked(F.col("formatted"), F.col("loss")), "")
    read = chats.select("conv_id", "formatted", turns.alias("turns"), own.alias("own"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("own").cast("long").alias("loss_chars"),
        F.sha2(F.col("own").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
