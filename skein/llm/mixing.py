"""Mixing sources to target weights: tokens a source, repetition rates, floor(rate) copies and a Bernoulli one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import text_of, words_of
from skein.operators.work import saved

#: Bytes of source names up to which all targets are broadcast, and 1 / the share of rows of sources that always are.
BROADCAST_BYTES, HEAVY = 4 << 20, 1000
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with rank, from 1 by order, and for each name in sums what its column adds up to in the rows before.

    Rows are sorted in ranges. A range is one task's; what goes through one place is a line a range, not a row.
    """
    ranged = saved(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range").orderBy(*order)
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    every = ranged.groupBy("range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    offsets = every.select("range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_n", *[f"_{name}" for name in sums])])
    inner = ranged.withColumn("rank", F.row_number().over(own))
    inner = inner.withColumns({name: F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for name, c in sums.items()})
    joined = inner.join(F.broadcast(offsets), "range")
    return joined.select(*rows.columns, (F.col("rank") + F.col("_n")).alias("rank"), *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of sizes (source, source_size): source_size and target.

    The sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share `share` of all sizes. A
    target stops at `most` times its source's size; what is over goes to the others by weight. With level L,
    target = min(cap, L * weight); every level that takes the sources with the least cap a weight as capped is at
    most the right one, which is therefore the largest of them. No row gives no row.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    named = in_order(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], {}).withColumn("weight", weight)
    caps = named.select("source", "source_size", "weight", (most * F.col("source_size")).alias("cap"))
    caps = caps.withColumn("per_weight", F.col("cap") / F.col("weight"))
    ordered = saved(in_order(caps, [F.asc("per_weight"), F.col("source").asc_nulls_last()], {"capped": "cap", "weighed": "weight"}))
    whole = ordered.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = (share * F.col("all_size") - F.col("capped")) / (F.col("all_weight") - F.col("weighed"))
    top = ordered.join(F.broadcast(whole)).agg(F.max(level).alias("level"))
    return ordered.join(F.broadcast(top)).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def measured(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Per row of docs: doc (a struct of its columns), doc_id, source, size and chance.

    size is the number of words of the text (null: 0), chance a number in [0, 1) from an MD5 of seed, id and text.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_of())
    chance = F.conv(F.substring(F.md5(key), 1, 10), 16, 10).cast("long") / float(1 << 40)
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(text_of())).cast("long").alias("size"), chance.alias("chance"))


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs (source, size, chance, and others of measured()) with source_size, target and copies.

    A document is repeated floor(rate) times, and once more if its chance is below the fraction; rate is its
    source's target / size. A null source is a source, the last; a source without words has the rate 0. Repeated
    rows of one id and text take the same chance.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = saved(sizes)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = saved(targets(sizes, share, most))
    named = found.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name"), "source_size", "target", rate.alias("rate"))
    keyed = docs.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    size = named.agg(F.coalesce(F.sum(F.octet_length("name") + 24), F.lit(0))).head()[0]
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(named), "name")
    else:
        # Sources with a large part of the rows are few: they come by broadcast, under a hash of the name. No other is hot.
        keyed, named = (t.withColumn("name", F.sha2("name", 256)) for t in (keyed, named))
        total = sizes.agg(F.sum("n")).head()[0]
        hot = sizes.filter(F.col("n") * HEAVY > total).select(F.sha2(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), 256).alias("name"))
        large = F.broadcast(named.join(hot, "name", "left_semi"))
        joined = keyed.join(large, "name").unionByName(keyed.join(F.broadcast(hot), "name", "left_anti").join(named, "name"))
    copies = F.floor("rate") + (F.col("chance") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies.cast("long")).drop("name", "rate")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The doc of each row as often as copies says."""
    return mixed.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
