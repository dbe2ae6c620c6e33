"""Exact dedup with DataFrame functions only: a content sort.

Sampled splitters part the documents into ranges of their normalised bytes, an external sort places equal texts next
to each other, and a comparison of whole neighbouring texts tells where a group ends. A splitter is a key of bounded
length, the first bytes and a 64-bit hash of the whole normalised text, so that what the sample brings to the driver
doesn't depend on how long texts are. Equal texts have equal keys; the comparison that decides is of whole texts.

A text that a large part of the rows has is sorted in pieces, each a range of its own; the first rows of the pieces
are then compared with each other. Texts with over 1 / HEAVY of the rows are under HEAVY, and so are told to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import BLANKS, text_of, without
from skein.operators.work import saved

#: 1 / the share of the rows from which the copies of a text are sorted in pieces of about that share, and the bytes of a splitter.
HEAVY, BEGIN = 1000, 16


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept and text_sha256 (hex, of the normalised text).

    Texts are equal if they are identical without blanks and the control characters 0x09-0x0D. Of equal texts the row
    with the most code points stays, then that with the smallest id, a null id after all others; of repeated rows
    just one. A null text counts as empty, and empty texts and texts of blanks alone are a group as any other. No row
    gives no row; other columns are ignored, whatever their names.
    """
    text = text_of(text_col)
    norm = without(text, BLANKS).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), norm.alias("norm")).withColumn("hash", F.xxhash64("norm"))
    total = max(docs.count(), 1)
    hot = saved(rows.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") * HEAVY > total).select("hash", F.ceil(F.col("n") * HEAVY / total).alias("pieces")))
    named = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(hot), "hash", "left")
    keyed = named.select("doc_id", "chars", "norm", "hash", "row", F.substring("norm", 1, BEGIN).alias("begin"), F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(-1)).alias("piece"))
    key = ("begin", "hash", "piece")
    group = Window.partitionBy(*key, "norm").orderBy(F.desc("chars"), F.col("doc_id").asc_nulls_last(), "row")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranged = keyed.repartitionByRange(*key)
    found = ranged.withColumns({"first": F.first("row").over(whole), "first_id": F.first("doc_id").over(whole), "n": F.count("*").over(whole)})
    leads = (F.col("piece") >= 0) & (F.col("row") == F.col("first"))
    told = saved(found.select("doc_id", "row", "first", "first_id", "n", F.sha2("norm", 256).alias("text_sha256"), "chars", F.when(leads, F.col("norm")).alias("norm")))
    # The pieces of a text: under 2 * HEAVY first rows in all, of which each text's best and the sum of their groups are taken.
    pieces = told.filter("norm is not null").groupBy("norm").agg(F.min(F.struct(-F.col("chars"), F.isnull("doc_id"), "doc_id", "row")).alias("best"), F.sum("n").alias("all"), F.collect_list("row").alias("firsts"))
    joined = told.drop("norm").join(F.broadcast(pieces.select("best.row", F.col("best.doc_id").alias("best_id"), "all", F.explode("firsts").alias("first")).withColumnRenamed("row", "best_row")), "first", "left")
    parted = F.col("all").isNotNull()
    return joined.select(
        "doc_id",
        F.when(parted, F.col("best_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("all", "n").alias("group_size"),
        (F.col("row") == F.coalesce("best_row", "first")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, without the copies that exact_groups() drops."""
    numbered = saved(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    kept = exact_groups(numbered.select(F.struct(F.col(f"doc.{id_col}"), "row").alias("id"), F.col(f"doc.{text_col}").alias("text")), "id").filter("kept")
    return numbered.join(kept.select("doc_id.row"), "row", "left_semi").select("doc.*")
