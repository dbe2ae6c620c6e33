"""Helpers shared by the training-data operators: words, shared work tables, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: blank and the control characters 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, in a session whose Arrow batches have at most so many rows: texts are long, and a task holds a batch several times over."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def text_of(column: str = "text") -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(text: Column, chars: str) -> Column:
    """The text without some characters, each removed by a search for its bytes."""
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def words_of(text: Column) -> Column:
    """Array of the words of a text, in order; empty for a text without words. Splits at one character, not a pattern."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where the optimizer copies the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes of zero and the values up to each one, an array of longs as long as values.

    An array that grows in a fold is copied at each step; here it grows in blocks of the root of the length only.
    """
    empty = F.array().cast("array<bigint>")

    def grown(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), empty.alias("out"))

        def step(state: Column, x: Column) -> Column:
            return let(op(state["at"], x), lambda y: F.struct(y.alias("at"), F.concat(state["out"], F.array(y)).alias("out")))

        return F.aggregate(block, begin, step)["out"]

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))
        firsts = lambda b: grown(F.transform(b, lambda x: F.aggregate(x, zero, lambda a, y: op(a, y))), zero)
        return let(let(blocks, lambda b: F.struct(b.alias("blocks"), firsts(b).alias("firsts"))), lambda t: F.flatten(F.transform(t["blocks"], lambda b, k: grown(b, F.coalesce(F.get(t["firsts"], k - 1), zero)))))

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(empty)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound so that a task's memory doesn't grow with the vocabulary."""

    LIMIT = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def lower_words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes.split() parts at exactly the blanks above."""
    return (text or b"").lower().split()


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of width words, in order; one for the whole sequence if it is shorter, none if empty."""
    n = len(word_hashes)
    width = min(width, n)
    if not n:
        return word_hashes
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _STEP + word_hashes[k : n - width + 1 + k]
        out ^= out >> np.uint64(31)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out
