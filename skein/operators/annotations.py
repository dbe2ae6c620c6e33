"""Annotations of things with terms of an ontology, kept and grouped by a list of terms that they are below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.trust import ELECTRONIC
from skein.operators.work import saved

#: Confidence of a term with evidence that isn't electronic alone, and of others; names that are listed; labels of frequencies.
EXPERIMENTAL, ELECTRONIC_ONLY, LISTED = 0.9, 0.7, 8
FREQUENCIES = {
    "HP:0040280": "Obligate (100%)", "HP:0040281": "Very frequent (99-80%)", "HP:0040282": "Frequent (79-30%)", "HP:0040283": "Occasional (29-5%)", "HP:0040284": "Very rare (<4-1%)", "HP:0040285": "Excluded (0%)",
}


def closures(ancestors: DataFrame) -> DataFrame:
    """(term, closure): the ancestors (id, ancestor) of each term, itself among them, as a sorted array, bounded by the ontology's depth and width."""
    return ancestors.groupBy(F.col("id").alias("term")).agg(F.array_sort(F.collect_set("ancestor")).alias("closure"))


def matched(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The rows (term, closure, ...) whose closure or own term has a wanted term, with matched: those terms, sorted.

    The list is stated, so it is part of the plan: rows are filtered where they are read, and none is shuffled.
    """
    own = F.array_union(F.coalesce("closure", F.array().cast("array<string>")), F.array("term"))
    return rows.withColumn("matched", F.array_sort(F.array_intersect(own, F.array(*[F.lit(w) for w in sorted(set(wanted))]).cast("array<string>")))).filter(F.size("matched") > 0)


def _first(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Per thing and term the first LISTED different values of a column, joined: values are made distinct before they are ranked."""
    once = rows.select("thing", "target", F.explode(column).alias("v")).filter("v is not null and v <> ''").distinct()
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("thing", "target").orderBy("v"))).filter(F.col("r") <= LISTED)
    return ranked.groupBy("thing", "target").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias(name))


def grouped(rows: DataFrame) -> DataFrame:
    """Per thing and matched term of matched() rows (thing, term, codes, publications): evidence_codes, the first annotated_terms
    and publications, annotation_count and confidence, which is lower if all evidence is electronic."""
    each = saved(rows.select("thing", F.explode("matched").alias("target"), F.array("term").alias("terms"), "codes", "publications"))
    # Of lists of codes there are few different ones.
    codes = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set("codes")))))
    out = each.groupBy("thing", "target").agg(F.count("*").alias("annotation_count"), codes.alias("codes"))
    out = out.select("thing", "target", "annotation_count", F.array_join("codes", ",").alias("evidence_codes"), F.exists("codes", lambda c: c != ELECTRONIC).alias("other"))
    for part in (_first(each, "terms", "annotated_terms"), _first(each, "publications", "publications")):
        out = out.join(part, ["thing", "target"], "left")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("evidence_codes", "annotated_terms", "publications")]
    return out.select("thing", "target", "annotation_count", *texts, F.when(F.coalesce("other", F.lit(False)), EXPERIMENTAL).otherwise(ELECTRONIC_ONLY).alias("confidence"))


def frequency(code: Column) -> Column:
    """The label of a frequency; other texts as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in FREQUENCIES.items() for x in pair])[code], code)
