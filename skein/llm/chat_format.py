"""Chat formatting with Spark expressions only: sort turn structs, merge adjacent turns of a role, concatenate.

A block is ``### Role: text</turn>`` and a line end. Adjacent turns of one role share a block, their texts
parted by ``</part>``. Inside roles and texts the backslash and every control string are escaped, so that
blocks and parts can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, running

#: Fixed values of the template, and the escapes, undone in reverse order. Each backslash of an escaped text begins an escape.
OPEN, AFTER_ROLE, PART, CLOSE = "### ", ": ", "</part>", "</turn>\n"
ESCAPES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
CHUNK = 4096


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted (the whole text) and loss_mask, array of (start, len) in code points.

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. Null roles and
    texts are empty; a null conv_id is a conversation of its own; other columns are ignored. The mask covers the
    escaped text of each turn whose role is assistant. No row gives no conversation.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Where a role begins, by a look at the turn before; a block is the slice up to where the next one begins.
    begins = F.array_compact(F.transform("turns", lambda t, i: F.when(F.get("turns", i - 1)["role"] == t["role"], F.lit(None)).otherwise(i)))

    def block(begins: Column, at: Column, k: Column) -> Column:
        own = F.slice("turns", at + 1, F.coalesce(F.get(begins, k + 1), F.size("turns")) - at)
        role = F.get("turns", at)["role"]
        return F.struct(
            (role == "assistant").alias("learn"),
            F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"),
            F.transform(own, lambda t: escape(t["text"])).alias("parts"),
        )

    def part(b: Column, p: Column, i: Column) -> Column:
        """A part's length, and what stands between its begin and the end of the part before."""
        gap = F.when(i > 0, len(PART)).otherwise(F.length(b["head"]) + len(CLOSE))
        return F.struct(F.length(p).cast("long").alias("len"), gap.cast("long").alias("gap"), b["learn"].alias("learn"))

    def mask(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda p: p["len"] + p["gap"]), F.lit(0).cast("long"), lambda a, b: a + b)
        spans = let(ends, lambda ends: F.transform(parts, lambda p, i: F.when(p["learn"], F.struct((F.get(ends, i) - p["len"] - len(CLOSE)).alias("start"), p["len"].alias("len")))))
        return F.array_compact(spans)

    def made(shown: Column) -> Column:
        whole = F.array_join(F.transform(shown, lambda b: F.concat(b["head"], F.array_join(b["parts"], PART), F.lit(CLOSE))), "")
        parts = F.flatten(F.transform(shown, lambda b: F.transform(b["parts"], lambda p, i: part(b, p, i))))
        return F.struct(whole.alias("formatted"), let(parts, mask).alias("loss_mask"))

    shown = let(begins, lambda own: F.transform(own, lambda at, k: block(own, at, k)))
    return chats.select("conv_id", F.inline(F.array(let(shown, made))))


def read_chats(formatted: Column) -> Column:
    """The turns, array of (role, text), read back from a formatted text."""
    blocks = F.filter(F.split(formatted, F.lit("</turn>\n")), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring(F.substring_index(block, AFTER_ROLE, 1), F.lit(len(OPEN) + 1), F.length(block)), ROLE_ESCAPES)
        body = F.substring(block, F.length(F.substring_index(block, AFTER_ROLE, 1)) + len(AFTER_ROLE) + 1, F.length(block))
        return F.transform(F.split(body, F.lit(PART)), lambda part: F.struct(role.alias("role"), unescape(part).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between.

    A span is looked for in the pieces of CHUNK code points that it lies in: from the text's begin each span would cost as much as all before it.
    """

    def spans(chunks: Column) -> Column:
        def one(m: Column) -> Column:
            inner = m["start"] % CHUNK
            first, n = (m["start"] / CHUNK).cast("int") + 1, ((inner + m["len"]) / CHUNK).cast("int") + 1
            return unescape(F.substring(F.array_join(F.slice(chunks, first, n), ""), (inner + 1).cast("int"), m["len"].cast("int")))

        return F.array_join(F.transform(mask, one), "")

    return let(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), spans)
