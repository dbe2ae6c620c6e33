"""An index of names for free-text conditions, and the studies mapped by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import registry_name

#: Kinds of match, the strongest first, and the confidence of an edge by each.
KINDS = {"label": 0.75, "synonym": 0.75, "alias": 0.65}


def name_index(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, node_id, kind): names as a registry's conditions are compared. nodes: id, label, synonyms; aliases: name, node_id.

    A label has precedence over a synonym, and that over an alias. Of several nodes of one label the smallest id has it, and of several aliases too;
    a synonym of several nodes is none. Names without a word are left out.
    """
    rows = [
        nodes.select(registry_name(F.col("label")).alias("name"), F.col("id").alias("node_id"), F.lit(0).alias("rank")),
        nodes.select(F.explode("synonyms").alias("s"), F.col("id").alias("node_id")).select(registry_name(F.col("s")).alias("name"), "node_id", F.lit(1).alias("rank")),
        aliases.select(registry_name(F.col("name")).alias("name"), "node_id", F.lit(2).alias("rank")),
    ]
    # An aggregate a name, combined before the shuffle: first and last id tell whether a synonym has one target.
    by_kind = rows[0].union(rows[1]).union(rows[2]).filter("name <> '' and node_id is not null").groupBy("name", "rank").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("last"))
    sure = by_kind.filter("rank <> 1 or node_id = last")
    best = sure.groupBy("name").agg(F.min(F.struct("rank", "node_id")).alias("b"))
    return best.select("name", "b.node_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("b.rank") + 1).alias("kind"))


def ambiguous(nodes: DataFrame) -> DataFrame:
    """(name, n) of synonyms that several nodes have."""
    said = nodes.select("id", F.explode("synonyms").alias("s")).select("id", registry_name(F.col("s")).alias("name")).filter("name <> ''")
    return said.groupBy("name").agg(F.count_distinct("id").alias("n")).filter("n > 1")


def mapped(studies: DataFrame, index: DataFrame) -> DataFrame:
    """(study_id, condition, node_id, kind) of studies (study_id, conditions); node_id and kind are null where no name fits."""
    each = studies.select("study_id", F.explode("conditions").alias("condition")).withColumn("name", registry_name(F.col("condition")))
    return each.join(index, "name", "left").select("study_id", "condition", "node_id", "kind")


def unmapped(found: DataFrame) -> DataFrame:
    """(condition, n) of mapped() conditions without a node."""
    return found.filter("node_id is null").groupBy("condition").agg(F.count("*").alias("n"))


def kept_studies(studies: DataFrame, found: DataFrame, seed: str = "seed") -> DataFrame:
    """The studies with a mapped condition, and those that the seed query found (queries: array), whatever their conditions."""
    known = found.filter("node_id is not null").select("study_id").distinct().withColumn("known", F.lit(True))
    return studies.join(known, "study_id", "left").filter(F.coalesce("known", F.lit(False)) | F.coalesce(F.array_contains("queries", seed), F.lit(False))).drop("known")


def condition_edges(found: DataFrame, status: DataFrame) -> DataFrame:
    """Evidence of mapped conditions, one a study and node: by the strongest kind, then the first condition. status: study_id, status."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = found.filter("node_id is not null").groupBy("study_id", "node_id").agg(F.min(F.struct(rank.alias("r"), "condition", "kind")).alias("b"))
    confidence = F.coalesce(*[F.when(F.col("b.kind") == k, F.lit(v)) for k, v in KINDS.items()])
    rows = best.join(status, "study_id", "left")
    return rows.select(
        F.col("study_id").alias("source_id"), F.lit("studies_condition").alias("relation"), F.col("node_id").alias("target_id"), F.lit("clinicaltrials").alias("source"), F.col("study_id").alias("record_id"),
        confidence.alias("confidence"), F.lit("observed").alias("evidence_type"), F.col("b.kind").alias("qualifier"), F.col("b.condition").alias("condition"), "status",
    )
