"""What is known and what is missing about each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.schema import STRONG


def coverage(nodes: DataFrame, edges: DataFrame, of_type: str, relations: dict[str, str]) -> DataFrame:
    """Per node of a type: for each name in relations the edges of that relation at it, the missing names, and a status.

    supported: nothing is missing and a strong edge exists; gap: nothing is there; weak otherwise. An edge is
    strong if it isn't inferred and its confidence is at least 0.4.
    """
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), "relation", "confidence", "evidence_type")
    strong = (F.col("evidence_type") != "inferred") & (F.col("confidence") >= STRONG)
    counted = ends.groupBy("id").agg(*[F.count_if(F.col("relation") == r).alias(name) for name, r in relations.items()], F.count_if(strong).alias("n_strong"))
    out = nodes.filter(F.col("type") == of_type).select("id", "label").join(counted, "id", "left").na.fill(0)
    missing = F.array_compact(F.array(*[F.when(F.col(name) == 0, F.lit(name)) for name in relations]))
    status = F.when(F.size(missing) == len(relations), "gap").when((F.size(missing) == 0) & (F.col("n_strong") > 0), "supported").otherwise("weak")
    return out.select("id", "label", *relations, "n_strong", F.array_join(missing, ",").alias("missing"), status.alias("status"))


def counts_of(known: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """All keys of known with their count, 0 where counted has none, and the keys that only counted has."""
    n = counted.groupBy(key).agg(F.count("*").alias("n"))
    return known.select(key).distinct().join(n, key, "full").na.fill(0, ["n"])


def extraction_metrics(predicted: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Precision, recall and F1 of predicted against gold rows, 0 where a denominator is 0."""
    p, g = predicted.select(*key).distinct(), gold.select(*key).distinct()
    one = p.intersect(g).agg(F.count("*").alias("tp")).join(p.agg(F.count("*").alias("p"))).join(g.agg(F.count("*").alias("g")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = one.select(F.col("tp"), F.col("p").alias("n_predicted"), F.col("g").alias("n_gold"), ratio("tp", "p").alias("precision"), ratio("tp", "g").alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)
