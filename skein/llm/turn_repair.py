"""Conversation structure repair: the cheapest edits that bring a conversation's roles into the form (s?(ua)+)?.

Wu-Manber-style cost layers. For each turn, layer c is the bitset of the grammar's states from which the turns that
follow can be repaired at the cost c; all layers of a turn are one number, four bits a layer, and an edit of cost k
shifts it by k layers, for all states and costs at once. The first layer of the first turn that has the start state gives
the cost. From any state that can be repaired at cost c any other can at c + 7, so only a turn's first LAYERS layers are
kept, and a turn costs the same whatever the conversation's length. The least audit is traced through the bits, forward.

The states are start, after s, after u, after a. Each but u goes to u by u, and u to a by a; start goes to s by s. So the
number of letters tells all of them, and an audit names one result.

A conversation's audit and repaired text are one value each. For the audit a task needs a byte a turn, and for the text
one turn at a time: turns come sorted, those of different texts by hash, and are never gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.llm.common import BLANKS, without

#: Costs of the edits, and what an undeleted truncated turn adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Layers that are kept of a turn, and turns after which the trace keeps the layers (between, it makes them again).
LAYERS, STRIDE = 16, 1024
START, S, U, A = range(4)
_ALL, _STARTS = (1 << 4 * LAYERS) - 1, sum(1 << 4 * c for c in range(LAYERS + 8))
#: A turn as a byte: the letter of its role in two bits (0 if it has another), whether it must go, whether it is truncated.
LETTERS, MUST_GO, IS_TRUNCATED = {"s": S, "u": U, "a": A}, 4, 8
ROLES = {U: "user", A: "assistant"}


def _before(v: int, letter: int) -> int:
    """The states from which a letter leads into v, in all layers."""
    if letter == U:
        return ((v >> U) & _STARTS) * 0b1011
    if letter == A:
        return ((v >> A) & _STARTS) << U
    return (v >> S) & _STARTS if letter == S else 0


def _filled(v: int, base: int) -> tuple[int, int]:
    """v with what insertions reach, its first layers, and the cost of the first one."""
    for _ in range(2):
        v |= (_before(v, U) | _before(v, A)) << 4 * INSERT
    low = ((v & -v).bit_length() - 1) // 4
    return (v >> 4 * low) & _ALL, base + low


def _layered(turn: int, v: int, base: int) -> tuple[int, int]:
    """The layers of a turn from those of the one after it."""
    out = v << 4 * DELETE
    if not turn & MUST_GO:
        extra = TRUNCATED if turn & IS_TRUNCATED else 0
        out |= _before(v, turn & 3) << 4 * extra
        out |= (_before(v, U) | _before(v, A)) << 4 * (REROLE + extra)
    return _filled(out, base)


def cheapest(turns: bytes) -> tuple[int, str]:
    """Cost and least audit of a conversation: one of D, I, K and R an edit, in order."""
    n, v = len(turns), _filled(1 << START | 1 << A, 0)
    kept = {n: v}
    for i in range(n - 1, -1, -1):
        v = _layered(turns[i], *v)
        if i % STRIDE == 0:
            kept[i] = v
    out, state, left = bytearray(), START, kept[0][1] + ((kept[0][0] & _STARTS & -(kept[0][0] & _STARTS)).bit_length() - 1) // 4
    cost, near = left, {}

    def reached(i: int, state: int, c: int) -> bool:
        nonlocal near
        if i not in near:
            stop = min(n, (i // STRIDE + 1) * STRIDE)
            at, near = kept[stop], {stop: kept[stop]}
            for j in range(stop - 1, i - i % STRIDE - 1, -1):
                near[j] = at = _layered(turns[j], *at)
        word, base = near[i]
        return c >= base and word >> (4 * (c - base) + state) & 1 == 1

    i = 0
    while i < n or left or state not in (START, A):
        turn, grown = turns[i] if i < n else MUST_GO, A if state == U else U
        extra = TRUNCATED if turn & IS_TRUNCATED else 0
        letter = turn & 3
        follows = letter == grown or (letter == S and state == START)
        if i < n and reached(i + 1, state, left - DELETE):
            edit, left, i = "D", left - DELETE, i + 1
        elif reached(i, grown, left - INSERT):
            edit, left, state = "I", left - INSERT, grown
        elif not turn & MUST_GO and follows and reached(i + 1, letter, left - extra):
            edit, left, i, state = "K", left - extra, i + 1, letter
        else:
            edit, left, i, state = "R", left - REROLE - extra, i + 1, grown
        out += edit.encode()
    return cost, out.decode()


def illegal_pairs(turns: bytes) -> int:
    """Neighbours whose letters aren't su, ua or au."""
    return sum((x & 3, y & 3) not in ((S, U), (U, A), (A, U)) for x, y in zip(turns, turns[1:]))


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(chats: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) of chats after damage by crc32 of "conv_id:turn", modulo 20.

    0 drops a row, 1 empties its text, 2 takes . ! and ? out of it, 3 repeats the row, 4 makes its role user. Nulls are
    one space, but a null turn stays null in the result.
    """
    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    draw = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, without(F.col("text"), ".!?")).otherwise(F.col("text"))
    hit = rows.withColumn("draw", draw).filter("draw <> 0").withColumns({"text": text, "role": F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))})
    return hit.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _ordered(rows: DataFrame) -> DataFrame:
    """The rows with nulls as one space and said, a hash of role and text."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    return rows.withColumn("said", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _runs(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of the batches, one at a time."""
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def _batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 20, many: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of about so many bytes of text or rows."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= most or len(held) >= many:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def plans(chats: DataFrame) -> DataFrame:
    """Per conversation of chats: conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Turns are ordered by turn, nulls first, then role, then a hash of the text. A turn's first fault counts: blank (no
    character but blanks), duplicate (role and text are those of an earlier turn), truncated (the last character that
    isn't blank is none of . ! ?). Blank and duplicate turns must go (4); a turn whose role begins with s, u or a can be
    kept, or be made user or assistant (3), or go (4); user and assistant turns without a text can be put anywhere (3);
    a truncated turn that stays costs 3 more. A null role or text is one space; roles with other letters, and empty
    ones, can't be kept. gaps counts turn numbers missing between the first and the last. A null conv_id is a
    conversation as any other; other columns are ignored; no row gives no row.
    """
    rows = _ordered(chats)
    held = F.rtrim("text", F.lit(BLANKS))
    told = rows.select("conv_id", "turn", "role", "said", (without(F.col("text"), BLANKS) == "").alias("is_blank"), (~F.substring(held, -1, 1).isin(".", "!", "?")).alias("is_open"))
    copies = Window.partitionBy("conv_id", "role", "said").orderBy(F.col("turn").asc_nulls_first())
    faults = told.repartition("conv_id").withColumn("seen", F.row_number().over(copies))
    again = F.col("seen") > 1
    blank, copy = F.col("is_blank"), ~F.col("is_blank") & again
    is_open = ~F.col("is_blank") & ~again & F.col("is_open")
    letter = F.substring("role", 1, 1)
    code = F.when(letter == "s", S).when(letter == "u", U).when(letter == "a", A).otherwise(0) + F.when(blank | copy, MUST_GO).otherwise(0) + F.when(is_open, IS_TRUNCATED).otherwise(0)
    coded = faults.select("conv_id", "turn", "role", "said", "seen", blank.alias("blank"), copy.alias("duplicate"), is_open.alias("truncated"), code.cast("tinyint").alias("code"))
    kind = chats.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType())])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv, rows in groupby(_runs(batches, ("conv_id", "turn", "blank", "duplicate", "truncated", "code")), key=lambda r: r[0]):
                turns, sums, first, last, distinct = bytearray(), [0, 0, 0], None, None, 0
                for _, turn, *faults, code in rows:
                    turns.append(code)
                    sums = [a + b for a, b in zip(sums, faults)]
                    if turn is not None and turn != last:
                        first, last, distinct = turn if first is None else first, turn, distinct + 1
                gaps = last - first + 1 - distinct if distinct else 0
                yield (conv, gaps, *sums, illegal_pairs(turns), *cheapest(bytes(turns)))

        yield from _batched(found(), _arrow(schema))

    return coded.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "said", "seen").mapInArrow(plan, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired(chats: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits of found, the plans of chats: conv_id, place (from 0), edit, turn, role and text.

    Inserted turns have no turn and an empty text. A conversation's rows are in one partition, in order. Conversations
    without a plan, and those whose turns all go, have no rows.
    """
    kind = chats.schema["conv_id"].dataType
    null = F.lit(None)
    audits = found.select("conv_id", F.lit(0).alias("part"), null.cast("long").alias("turn"), null.cast("string").alias("role"), F.col("audit").alias("text"), null.cast("binary").alias("said"))
    rows = audits.unionByName(_ordered(chats).withColumn("part", F.lit(1)))
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, rows in groupby(_runs(batches, ("conv_id", "part", "turn", "role", "text")), key=lambda r: r[0]):
                _, part, _, _, audit = next(rows)
                if part:
                    continue
                # Letters alternate; the first is s if their number is odd.
                place, odd = 0, (len(audit) - audit.count("D")) % 2
                for letter in audit:
                    turn, role, text = next(rows)[2:] if letter != "I" else (None, None, "")
                    if letter == "D":
                        continue
                    yield (conv, place, letter, turn, role if letter == "K" else ROLES[A if (place - odd) % 2 else U], text)
                    place += 1

        yield from _batched(made(), _arrow(schema))

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "said").mapInArrow(edit, schema)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of repaired() turns: conv_id and sha256 of their "role:text", joined by line ends.

    Reads each turn once, where and in the order in which repaired() gives it.
    """
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def found() -> Iterator[tuple]:
            for conv, rows in groupby(_runs(batches, ("conv_id", "role", "text")), key=lambda r: r[0]):
                h = sha256()
                for i, (_, role, text) in enumerate(rows):
                    h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
                yield conv, h.hexdigest()

        yield from _batched(found(), _arrow(schema))

    return turns.mapInArrow(digest, schema)
