"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block, their texts
joined by a mark, so that reading back gives the turns as they were. Template:

    user        [INST]text[NEXT]text[/INST]
    assistant   [ANS]text[NEXT]text</s>
    any other   [ROLE]role[TEXT]text[NEXT]text[/ROLE]

with <s> in front of the whole. A control string inside a role or text, with any number of ! before its name, gets
one more !, so no text holds a control string, and taking one ! away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, running

#: The control strings' names.
BRACKETED, ANGLED = "INST|ANS|ROLE|TEXT|NEXT", "s"
BLOCK = r"(?s)\[INST\].*?\[/INST\]|\[ANS\].*?</s>|\[ROLE\].*?\[/ROLE\]"


def escaped(text: Column) -> Column:
    once = F.regexp_replace(text, rf"(\[/?)(!*)({BRACKETED})\]", "$1!$2$3]")
    return F.regexp_replace(once, rf"(</?)(!*)({ANGLED})>", "$1!$2$3>")


def unescaped(text: Column) -> Column:
    once = F.regexp_replace(text, rf"(\[/?)!(!*)({BRACKETED})\]", "$1$2$3]")
    return F.regexp_replace(once, rf"(</?)!(!*)({ANGLED})>", "$1$2$3>")


def _blocks(turns: Column) -> Column:
    """Runs of one role, as role and joined escaped texts."""

    def runs(starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            texts = F.transform(F.slice(turns, start + 1, end - start), lambda t: t["text"])
            return F.struct(turns[start]["role"].alias("role"), F.array_join(F.transform(texts, escaped), "[NEXT]").alias("body"))

        return F.transform(starts, one)

    first = lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != turns[i]["role"])
    return let(F.filter(F.sequence(F.lit(0), F.size(turns) - 1), first), runs)


def _pieces(block: Column) -> Column:
    """What stands before the body, the body, and what stands after."""
    head = F.when(block["role"] == "user", "[INST]").when(block["role"] == "assistant", "[ANS]").otherwise(F.concat(F.lit("[ROLE]"), escaped(block["role"]), F.lit("[TEXT]")))
    tail = F.when(block["role"] == "user", "[/INST]").when(block["role"] == "assistant", "</s>").otherwise("[/ROLE]")
    return F.struct(head.alias("head"), block["body"].alias("body"), tail.alias("tail"), (block["role"] == "assistant").alias("loss"))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, text, loss (array of from, to: byte ranges of text, one for each assistant block's body), n_blocks.

    Turns are in the order of turn, then role, then text, nulls first; null text and role count as empty. Rows that repeat
    are turns of their own. Rows without conv_id are one conversation. Columns besides conv_id, turn, role and
    text aren't read. An empty table gives an empty result. A conversation is one row, so it must fit in a task's memory.
    """
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = let(F.col("turns"), lambda t: F.transform(_blocks(t), _pieces))
    size = lambda p: F.octet_length(p["head"]) + F.octet_length(p["body"]) + F.octet_length(p["tail"])

    def laid_out(p: Column) -> Column:
        text = F.concat(F.lit("<s>"), F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], x["tail"])), ""))

        def places(before) -> Column:
            at = lambda x, i: let(before(i) + F.octet_length(x["head"]), lambda b: F.struct(b.alias("from"), (b + F.octet_length(x["body"])).alias("to"), x["loss"].alias("loss")))
            return F.transform(F.filter(F.transform(p, at), lambda s: s["loss"]), lambda s: s.dropFields("loss"))

        spans = running(F.transform(p, size), F.lit(3), lambda a, x: a + x, places)
        return F.struct(text.alias("text"), spans.alias("loss"), F.size(p).cast("long").alias("n_blocks"))

    return grouped.select("conv_id", let(pieces, laid_out).alias("x")).select("conv_id", "x.*")


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turns(block: Column) -> Column:
        role = F.when(block.startswith("[INST]"), "user").when(block.startswith("[ANS]"), "assistant").otherwise(unescaped(F.regexp_extract(block, r"(?s)\A\[ROLE\](.*?)\[TEXT\]", 1)))
        body = F.regexp_replace(F.regexp_replace(block, r"(?s)\A(?:\[INST\]|\[ANS\]|\[ROLE\].*?\[TEXT\])", ""), r"(?:\[/INST\]|</s>|\[/ROLE\])\z", "")
        return let(role, lambda r: F.transform(F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), turns))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks, all read back from formatted()."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = formatted(conversations)
    under = F.array_join(F.transform("loss", lambda s: F.regexp_replace(F.substring(F.col("text").cast("binary"), s["from"] + 1, s["to"] - s["from"]).cast("string"), r"\[NEXT\]", "")), "")
    rows = rows.select("conv_id", "n_blocks", F.length("text").cast("long").alias("formatted_chars"), unescaped(under).alias("under"), read_back(F.col("text")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), sha(F.col("under")).alias("loss_sha256"), "formatted_chars", "n_blocks")
