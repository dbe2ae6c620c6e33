"""Numeric functions: ids, costs, rounding, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.schema import INFERRED_COST, LEAST_CONFIDENCE


def edge_id(*parts: Column) -> Column:
    """E: and 16 hex digits of the SHA-256 of the compact JSON array of the parts."""
    return F.concat(F.lit("E:"), F.substring(F.sha2(F.to_json(F.array(*parts)), 256), 1, 16))


def round4(x: Column) -> Column:
    """Four decimals, halves of the exact binary value to the even neighbour.

    x * 10000 isn't exact in a double; what it loses is worked out from the halves of x, so that ties are true ties.
    """
    x = x.cast("double")
    split = x * F.lit(134217729.0)
    high = split - (split - x)
    p = x * F.lit(10000.0)
    lost = (high * F.lit(10000.0) - p) + (x - high) * F.lit(10000.0)
    low = F.floor(p).cast("double")
    over = (p - low - F.lit(0.5)) + lost
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) != 0))
    return (low + F.when(up, 1.0).otherwise(0.0)) / F.lit(10000.0)


def millionths(x: Column) -> Column:
    """A number as an integer of millionths: sums of it don't depend on their order."""
    return F.floor(x * 1_000_000 + 0.5).cast("long")


def finite(text: Column) -> Column:
    """A text as a finite number, null if it is none."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def edge_cost(confidence: Column, inferred: Column) -> Column:
    return -F.log(F.greatest(confidence, F.lit(LEAST_CONFIDENCE))) + F.when(inferred, INFERRED_COST).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if their lengths differ or one is empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
