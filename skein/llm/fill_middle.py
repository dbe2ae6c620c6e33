"""Fill-in-middle: a text is cut into prefix, middle and suffix at ends of units, and these are written in another order.

Where a cut lies comes from a run-length class encoding of the text: the maximal runs of one class of characters, with
the number of units that end before each. Of a cut after k units, a binary search finds the run in which the k-th unit
ends, and its place in the run is arithmetic. Only runs in which units end are stored:

* line: runs of line ends, each of which ends a unit (a run of other characters ends none, but the text's last one);
* word: runs of blanks, a unit each, that end the word before them, and the text's last word;
* char: runs of characters of as many bytes, each a unit.

Texts are handled as UTF-8, so a run is found by comparing neighbouring bytes. Tasks get texts in Arrow batches, which
Spark bounds by rows and bytes, and give three numbers a text; draws, output and the way back are Spark expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BYTES = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


@dataclass(frozen=True)
class Runs:
    """Runs in which units end: where each begins, units that end before it, and bytes of each of its units. n is all units."""

    begin: np.ndarray
    before: np.ndarray
    width: np.ndarray
    n: int

    def cut(self, k: int) -> int:
        """Bytes of the first k units."""
        if k <= 0:
            return 0
        r = int(np.searchsorted(self.before, k)) - 1
        return int(self.begin[r] + (k - self.before[r]) * self.width[r])


def encoded(data: np.ndarray, unit: str = "line") -> Runs:
    """The runs of a text's bytes."""
    if unit == "line":
        classes = data == 10
    elif unit == "word":
        classes = (data == 32) | ((data >= 9) & (data <= 13))
    else:
        classes = _BYTES[data]
        for _ in range(3):
            inner = np.flatnonzero(classes == 0)
            classes[inner] = classes[inner - 1]
    edges = np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [len(data)])) if len(data) else np.zeros(1, np.int64)
    begin, size = edges[:-1], np.diff(edges)
    kind = classes[begin] if len(begin) else np.zeros(0, np.uint8)
    last = np.arange(len(begin)) == len(begin) - 1
    if unit == "char":
        width, units = kind.astype(np.int64), size // np.maximum(kind, 1)
    elif unit == "line":
        width, units = np.where(kind, 1, size), np.where(kind, size, last)
    else:
        width, units = size, (kind | last).astype(np.int64)
    ends = units > 0
    units = units[ends]
    return Runs(begin[ends], np.cumsum(units) - units, width[ends], int(units.sum()))


def chars(data: np.ndarray) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cuts(data: np.ndarray, h1: int, h2: int, unit: str = "line") -> tuple[int, int, int]:
    """Units of a text, and the code points of its prefix and middle."""
    runs = encoded(data, unit)
    a, b = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    one, two = runs.cut(a), runs.cut(b)
    return runs.n, chars(data[:one]), chars(data[one:two])


def _udf(unit: str):
    @F.arrow_udf("struct<n: bigint, prefix: bigint, middle: bigint>")
    def found(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        text = text.cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        rows = [cuts(data[b:e], x, y, unit) for b, e, x, y in zip(at[:-1], at[1:], h1.to_pylist(), h2.to_pylist(), strict=True)]
        n, prefix, middle = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (n, prefix, middle)], ["n", "prefix", "middle"])

    return found


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n (units of the text), form, prefix_chars, middle_chars and output.

    The draws are the first four groups of eight digits of the SHA-256 of seed, colon and id: two cuts, each after any
    number of units, whether the text is cut at all (percent), and in which form. psm is <P>prefix<S>suffix<M>middle, spm
    <S>suffix<P>prefix<M>middle; plain, without numbers, is the text itself: empty ones, and those in which a marker occurs.
    A null text counts as empty and a null id as an empty one; equal ids draw alike, and repeated rows give equal rows.
    No row gives no row; other columns are ignored. A text must fit into a task a few times over; nothing is cut off.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("draw"))
    h = [F.conv(F.substring("draw", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), _udf(unit)("text", h[0], h[1]).alias("cut"))
    known = cut.select("doc_id", "text", "form", "cut.n", *[F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(f"{c}_chars") for c in ("prefix", "middle")])
    part = lambda begin, n: F.substring("text", (begin + 1).cast("int"), n.cast("int"))
    p, m = F.col("prefix_chars"), F.col("middle_chars")
    prefix, middle, suffix = part(F.lit(0), p), part(p, m), part(p + m, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return known.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from output and form. No marker occurs in a text that was cut, and none arises where a piece ends at another marker."""

    def between(text: Column, left: str, right: str | None) -> Column:
        rest = F.substring(text, F.locate(left, text) + len(left), F.length(text))
        return rest if right is None else F.substring(rest, F.lit(1), F.locate(right, rest) - 1)

    prefix = F.when(form == "psm", between(output, PREFIX, SUFFIX)).otherwise(between(output, PREFIX, MIDDLE))
    suffix = F.when(form == "psm", between(output, SUFFIX, MIDDLE)).otherwise(between(output, SUFFIX, PREFIX))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(output, MIDDLE, None), suffix))
