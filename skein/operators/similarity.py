"""Similarity of things by the features they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numeric import millionths, round4
from skein.operators.work import saved
from skein.schema import IC_FLOOR

#: Things under one feature from which its list is dealt over several tasks.
HEAVY = 2000


def informative(annotations: DataFrame, things: DataFrame, floor: float = IC_FLOOR) -> DataFrame:
    """Annotations (thing, feature) as (thing, feature, weight): weight = -ln(things that have it / all things), in
    millionths; features below the floor, which many things have, are left out."""
    total = things.agg(F.count("*").alias("total"))
    n = annotations.distinct().groupBy("feature").agg(F.count("*").alias("n"))
    ic = n.join(F.broadcast(total)).select("feature", (-F.log(F.col("n") / F.col("total"))).alias("ic")).filter(F.col("ic") >= floor)
    return annotations.distinct().join(ic.select("feature", millionths(F.col("ic")).alias("weight")), "feature").select("thing", "feature", "weight")


def profiles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(thing, kind, feature, weight) of all diseases: informative phenotypes, genes by both relations, mechanisms of the genes."""
    diseases = nodes.filter("type = 'disease'").select(F.col("id").alias("thing"))
    genes = nodes.filter("type = 'gene'").select(F.col("id").alias("feature"))
    notes = edges.filter("relation = 'has_phenotype'").select(F.col("source_id").alias("thing"), F.col("target_id").alias("feature"))
    caused = edges.filter("relation = 'caused_by'").select(F.col("source_id").alias("thing"), F.col("target_id").alias("feature"))
    risks = edges.filter("relation = 'risk_factor_for'").select(F.col("target_id").alias("thing"), F.col("source_id").alias("feature"))
    linked = caused.union(risks).distinct().join(genes, "feature", "left_semi").join(diseases, "thing", "left_semi")
    takes = edges.filter("relation = 'participates_in'").select(F.col("source_id").alias("gene"), F.col("target_id").alias("feature"))
    through = linked.withColumnRenamed("feature", "gene").join(takes, "gene").select("thing", "feature").distinct()
    parts = [
        informative(notes.join(diseases, "thing", "left_semi"), diseases).select("thing", F.lit("phenotype").alias("kind"), "feature", "weight"),
        linked.select("thing", F.lit("gene"), "feature", F.lit(1).cast("long")),
        through.select("thing", F.lit("mechanism"), "feature", F.lit(1).cast("long")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def shared_pairs(features: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs a < b of things under one feature: (*keys, feature, weight, a, b), and each of more of both as _a and _b.

    A list of over HEAVY things is dealt by one side and repeated for the other, so no task has a whole one.
    """
    sizes = features.groupBy(*keys, "feature").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / HEAVY).cast("int")
    sized = features.join(sizes.select(*keys, "feature", parts.alias("parts")), [*keys, "feature"])
    of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in more]
    one = sized.select(*keys, "feature", "weight", F.col("thing").alias("a"), *of("a"), F.pmod(F.xxhash64("thing"), F.col("parts")).cast("int").alias("part"))
    two = sized.select(*keys, "feature", F.col("thing").alias("b"), *of("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return one.join(two, [*keys, "feature", "part"]).filter("a < b").drop("part")


def weighted_jaccard(features: DataFrame, *keys: str) -> DataFrame:
    """Pairs a < b of features (*keys, thing, feature, weight: integer) that share one: n_shared, shared, total and
    score = shared / total, per value of keys.

    An inverted index: only things under one feature meet. Sums are of integers, so the score doesn't depend on their order.
    What a thing weighs goes with its features, so pairs, of which there are most, are shuffled once.
    """
    k = list(keys)
    own = features.groupBy(*k, "thing").agg(F.sum("weight").alias("own"))
    met = shared_pairs(features.join(own, [*k, "thing"]), k, ("own",)).withColumn("both", F.col("own_a") + F.col("own_b"))
    sums = met.groupBy(*k, "a", "b").agg(F.sum("weight").alias("shared"), F.count("*").alias("n_shared"), F.max("both").alias("both"))
    return sums.withColumn("total", F.col("both") - F.col("shared")).select(*k, "a", "b", "n_shared", "shared", "total", (F.col("shared") / F.col("total")).alias("score"))


def scored_pairs(profile: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Pairs of profiles (thing, kind, feature, weight) with a score a kind, 0 where they share none, their weighted sum as
    score if it is above 0, all in four decimals, and n_shared of each kind."""
    found = weighted_jaccard(profile, "kind")
    wide = found.groupBy("a", "b").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in weights], *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n_shared"))), F.lit(0)).cast("long").alias(f"n_{k}") for k in weights])
    total = sum((w * F.col(k) for k, w in list(weights.items())[1:]), F.col(next(iter(weights))) * next(iter(weights.values())))
    out = wide.withColumn("score", round4(total)).filter("score > 0")
    return out.select("a", "b", *[round4(F.col(k)).alias(k) for k in weights], *[f"n_{k}" for k in weights], "score")


def top_shared(features: DataFrame, most: int = 5) -> DataFrame:
    """Per pair of things the features they share with the most weight, then by name: (a, b, rank, feature)."""
    order = Window.partitionBy("a", "b").orderBy(F.desc("weight"), "feature")
    return shared_pairs(features, []).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("a", "b", "rank", "feature")


def link_text(left: Column, right: Column) -> Column:
    """How two things link to one feature, from the sorted relations of each."""
    return F.when(left == right, left).otherwise(F.concat(left, F.lit(" vs "), right))


def cluster_ids(members: DataFrame) -> DataFrame:
    """members (id, label) as (id, cluster): C1, C2, ... by size, the largest first, then by the smallest id.

    Groups are numbered, one row each, not their members.
    """
    groups = saved(members.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    numbered = groups.withColumn("cluster", F.concat(F.lit("C"), F.row_number().over(Window.orderBy(F.desc("n"), "first"))))
    return members.join(numbered.select("label", "cluster"), "label").select("id", "cluster")
