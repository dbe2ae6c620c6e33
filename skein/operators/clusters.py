"""What makes a cluster: its shared features, its label, its bridges to others and the cases that speak against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.work import saved

TOP, MOST_BRIDGES, MOST_COUNTEREXAMPLES, BRIDGE_FLOOR, LEAST_SHARED = 5, 6, 8, 0.05, 2
MEMBERS = 50


def features(profile: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster and kind the first features that at least two members share: (cluster, kind, rank, feature, n).

    Genes by holders; mechanisms by holders and then how rare they are among all; phenotypes by weight, then holders.
    """
    own = profile.join(clusters.withColumnRenamed("id", "thing"), "thing")
    held = own.groupBy("cluster", "kind", "feature").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).filter(F.col("n") >= LEAST_SHARED)
    everywhere = profile.groupBy("kind", "feature").agg(F.count("*").alias("all"))
    phenotype, mechanism = F.col("kind") == "phenotype", F.col("kind") == "mechanism"
    order = [F.when(phenotype, -F.col("weight")).otherwise(0), -F.col("n"), F.when(mechanism, F.col("all")).otherwise(0), F.col("feature")]
    ranked = held.join(everywhere, ["kind", "feature"]).withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "kind").orderBy(*order)))
    return ranked.filter(F.col("rank") <= TOP).select("cluster", "kind", "rank", "feature", "n")


def labels(found: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, size, label): the first gene and mechanism, else the first phenotype, else the first member's label."""
    named = found.filter("rank = 1").join(nodes.select(F.col("id").alias("feature"), "label"), "feature")
    first = named.groupBy("cluster").agg(*[F.max(F.when(F.col("kind") == k, F.col("label"))).alias(k) for k in ("gene", "mechanism", "phenotype")])
    members = clusters.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("id")).join(nodes.select("id", F.col("label").alias("member")), "id")
    both = F.nullif(F.concat_ws(" · ", "gene", "mechanism"), F.lit(""))
    label = F.coalesce(both, F.concat(F.lit("shared phenotype: "), "phenotype"), "member")
    return members.join(first, "cluster", "left").select("cluster", "size", label.alias("label"))


def bridges(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster its pairs into others of at least BRIDGE_FLOOR, the best first: (cluster, rank, member, other, other_cluster, score)."""
    a, b = (clusters.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}")) for x in ("a", "b"))
    crossing = pairs.filter(F.col("score") >= BRIDGE_FLOOR).join(a, "a").join(b, "b").filter("ca <> cb")
    ends = [F.struct(F.col(f"c{x}").alias("cluster"), F.col(x).alias("member"), F.col(y).alias("other"), F.col(f"c{y}").alias("other_cluster")) for x, y in (("a", "b"), ("b", "a"))]
    each = crossing.select("a", "b", "score", F.explode(F.array(*ends)).alias("e")).select("e.*", "a", "b", "score")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "a", "b")))
    return ranked.filter(F.col("rank") <= MOST_BRIDGES).select("cluster", "rank", "member", "other", "other_cluster", "score")


def counterexamples(profile: DataFrame, pairs: DataFrame, clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members that share a gene with a thing of another cluster: (cluster, rank, gene, member, other, other_cluster, score),
    by the gene's label, the best scores first."""
    genes = profile.filter("kind = 'gene'").join(clusters.withColumnRenamed("id", "thing"), "thing").select("feature", "thing", "cluster")
    one = genes.withColumnsRenamed({"thing": "member"})
    two = genes.withColumnsRenamed({"thing": "other", "cluster": "other_cluster"})
    met = one.join(two, "feature").filter("cluster <> other_cluster").join(nodes.select(F.col("id").alias("feature"), F.col("label").alias("gene")), "feature")
    scored = met.withColumns({"a": F.least("member", "other"), "b": F.greatest("member", "other")}).join(pairs.select("a", "b", "score"), ["a", "b"], "left").na.fill(0.0, ["score"])
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("gene", F.desc("score"), "member", "other")))
    return ranked.filter(F.col("rank") <= MOST_COUNTEREXAMPLES).select("cluster", "rank", "gene", "member", "other", "other_cluster", "score")


def details(nodes: DataFrame, profile: DataFrame, pairs: DataFrame, clusters: DataFrame, like: float) -> DataFrame:
    """One row a cluster: its label, size, first members, shared features by kind, pairs inside, bridges and counterexamples.

    Of members the first MEMBERS by id are listed and all are counted; the other lists are bounded by rank.
    """
    found = saved(features(profile, clusters))
    first = lambda *what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", *what).alias("x")))), lambda r: r["x"]), ", ")
    kinds = found.join(nodes.select(F.col("id").alias("feature"), "label"), "feature").groupBy("cluster", "kind").agg(first("label").alias("names"))
    wide = kinds.groupBy("cluster").agg(*[F.max(F.when(F.col("kind") == k, F.col("names"))).alias(f"{k}s") for k in ("gene", "mechanism", "phenotype")])
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    members = clusters.withColumn("rank", place).filter(F.col("rank") <= MEMBERS).groupBy("cluster").agg(first("id").alias("members"))
    a, b = (clusters.select(F.col("id").alias(x), F.col("cluster").alias(y)) for x, y in (("a", "cluster"), ("b", "cb")))
    within = pairs.filter(F.col("score") >= like).join(a, "a").join(b, "b").filter("cluster = cb").groupBy("cluster").agg(F.count("*").alias("n_within"))
    over = bridges(pairs, clusters).groupBy("cluster").agg(first("member", "other", "other_cluster").alias("bridges"))
    against = counterexamples(profile, pairs, clusters, nodes).groupBy("cluster").agg(first("gene", "member", "other", "other_cluster").alias("counterexamples"))
    out = labels(found, clusters, nodes)
    for part in (members, wide, within, over, against):
        out = out.join(part, "cluster", "left")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("genes", "mechanisms", "phenotypes", "bridges", "counterexamples")]
    return out.select("cluster", "label", "size", "members", F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"), *texts)
