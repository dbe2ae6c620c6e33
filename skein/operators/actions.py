"""What to do next: related diseases by tier, reusable assets, the next experiment; and paths with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.similarity import shared_pairs


def related(edges: DataFrame) -> DataFrame:
    """Pairs of diseases (a, b) with the least tier that relates them: 1 a shared cause, 2 a mechanism of their causes."""
    causes = edges.filter("relation = 'caused_by'").select(F.col("source_id").alias("disease"), F.col("target_id").alias("gene")).distinct()
    takes = edges.filter("relation = 'participates_in'").select(F.col("source_id").alias("gene"), F.col("target_id").alias("mechanism"))
    through = causes.select("disease", F.col("gene").alias("item"), F.lit(1).alias("tier")).union(causes.join(takes, "gene").select("disease", "mechanism", F.lit(2)).distinct())
    features = through.select(F.col("disease").alias("thing"), F.col("item").alias("feature"), "tier", F.lit(1).alias("weight"))
    met = shared_pairs(features, ["tier"]).withColumnRenamed("feature", "item")
    return met.groupBy("a", "b").agg(F.min("tier").alias("tier")).join(met.groupBy("a", "b", "tier").agg(F.count_distinct("item").alias("n_shared")), ["a", "b", "tier"])


def next_study(studies: DataFrame) -> DataFrame:
    """Per disease of studies (disease, study, is_open, size): open ones first, then the largest, ties by id."""
    order = Window.partitionBy("disease").orderBy(F.desc("is_open"), F.desc("size"), "study")
    return studies.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def hydrated(paths: DataFrame, edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """Per path (path_id, edge_ids): its edges in order, least confidence, and whether any is inferred or contradicted."""
    hops = paths.select("path_id", F.posexplode("edge_ids").alias("pos", "id"))
    against = disputes.select("source_id", "relation", "target_id").distinct().withColumn("against", F.lit(True))
    found = hops.join(edges, "id").join(against, ["source_id", "relation", "target_id"], "left")
    return found.groupBy("path_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]), ",").alias("edge_ids"),
        F.min("confidence").alias("least_confidence"),
        F.bool_or(F.col("evidence_type") == "inferred").alias("has_inferred"),
        F.bool_or(F.coalesce("against", F.lit(False)) | (F.col("relation") == "contradicts")).alias("has_contradiction"),
        F.count("*").alias("n_hops"),
    )
