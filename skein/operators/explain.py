"""Explanations of edges from templates, their caveats and keys, and the check of given ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import literal_map, numbers
from skein.operators.trust import KNOWLEDGE_SOURCES
from skein.schema import LOW

#: The sentence of each relation, the prefix of inferred ones, and the caveats.
PHRASES = {
    "caused_by": "{source} is caused by changes in {target}.",
    "risk_factor_for": "Changes in {source} are a risk factor for {target}.",
    "has_variant": "{source} has the variant {target}.",
    "variant_associated_with": "The variant {source} is associated with {target}.",
    "has_mechanism": "{source} involves the biological mechanism {target}.",
    "participates_in": "{source} takes part in {target}.",
    "has_phenotype": "{source} can show the feature {target}.",
    "shares_mechanism_with": "{source} shares a biological mechanism with {target}.",
    "similar_phenotype_to": "{source} has features similar to {target}.",
    "mentions": "{source} mentions {target}.",
    "claims": "{source} reports the finding {target}.",
    "authored_by": "{source} was written by {target}.",
    "studies_condition": "The study {source} focuses on {target}.",
    "tests_intervention": "The study {source} tests {target}.",
    "investigates": "{source} investigates {target}.",
    "funds": "{source} funds {target}.",
    "works_on": "{source} works on {target}.",
    "represents": "{source} represents people affected by {target}.",
    "operates": "{source} runs {target}.",
    "contradicts": "{source} contradicts {target}.",
}
HYPOTHESIS = "Hypothesis (inferred, not directly observed): "
ADVICE = "Research context only, not medical advice: a clinician or researcher must verify each link before acting on it."
INFERRED = "Some links are inferred (for example extracted from text), not curated."
TEMPLATE = "Written from a fixed template because the AI explanation is unavailable."
VERSION = "template-v1"


def citation(source: Column, record: Column, qualifier: Column) -> Column:
    """Readable source of a citation."""
    known = literal_map(KNOWLEDGE_SOURCES)[qualifier]
    return (
        F.when(source == "monarch", F.coalesce(F.concat(known, F.lit(" via Monarch")), F.lit("Monarch Initiative")))
        .when(source == "go", "Gene Ontology annotation")
        .when(source == "clinicaltrials", F.concat(F.lit("ClinicalTrials.gov "), record))
        .when(source == "pubmed", F.concat(F.lit("PubMed "), record))
        .when(source == "curated", "team-curated, cited source")
        .otherwise(F.concat(source, F.lit(" "), record))
    )


def sentences(edges: DataFrame, nodes: DataFrame, audience: str = "family") -> DataFrame:
    """The edges with sentence. An end without a node is named by its id; researchers are told source and confidence too."""
    parts = {r: (p.split("{source}")[0], p.split("{source}")[1].split("{target}")[0]) for r, p in PHRASES.items()}
    named = edges
    for end in ("source", "target"):
        named = named.join(nodes.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), f"{end}_id", "left")
    a, b = F.coalesce("source_label", "source_id"), F.coalesce("target_label", "target_id")
    before, middle = literal_map({r: x for r, (x, _) in parts.items()})[F.col("relation")], literal_map({r: x for r, (_, x) in parts.items()})[F.col("relation")]
    text = F.concat(before, a, middle, b, F.lit("."))
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    if audience == "researcher":
        cited = citation(F.col("source"), F.col("record_id"), F.col("qualifier"))
        text = F.concat(text, F.lit(" (Source: "), cited, F.lit("; "), F.col("evidence_type"), F.format_string(", confidence %.2f)", "confidence"))
    text = F.when(F.col("evidence_type") == "inferred", F.concat(F.lit(HYPOTHESIS), text)).otherwise(text)
    return named.select(*edges.columns, "source_label", "target_label", text.alias("sentence"))


def path_ends(hops: Column) -> Column:
    """Start and end of a chain of edges (source_id, target_id), whatever the direction of each; null for none."""
    first, second, before, last = F.get(hops, F.lit(0)), F.get(hops, F.lit(1)), F.get(hops, F.size(hops) - 2), F.element_at(hops, -1)
    touches = lambda x, e: (x == e["source_id"]) | (x == e["target_id"])
    start = F.when(touches(first["target_id"], second), first["source_id"]).otherwise(first["target_id"])
    end = F.when(touches(last["source_id"], before), last["target_id"]).otherwise(last["source_id"])
    one = F.struct(first["source_id"].alias("start"), first["target_id"].alias("end"))
    return F.when(F.size(hops) == 1, one).when(F.size(hops) > 1, F.struct(start.alias("start"), end.alias("end")))


def explanations(asked: DataFrame, edges: DataFrame, nodes: DataFrame, disputed: DataFrame, audience: str = "family") -> DataFrame:
    """Per explanation of asked (explanation_id, pos, edge_id): its summary, steps and caveats, one a line, and key.

    disputed: ids of contradicted edges. Unknown edges are left out. An explanation has a bounded number of edges.
    """
    chosen = asked.join(edges.withColumnRenamed("id", "edge_id"), "edge_id").withColumnRenamed("edge_id", "id")
    said = sentences(chosen, nodes, audience).join(disputed.select("id").distinct().withColumn("disputed", F.lit(True)), "id", "left")
    step = F.struct("pos", "id", "source_id", "target_id", F.coalesce("source_label", "source_id").alias("source_label"), F.coalesce("target_label", "target_id").alias("target_label"), "sentence", "confidence", "evidence_type", F.coalesce("disputed", F.lit(False)).alias("disputed"))
    whole = said.groupBy("explanation_id").agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumn("ends", path_ends(F.col("steps")))
    both = lambda s: F.array(F.struct(s["source_id"].alias("id"), s["source_label"].alias("label")), F.struct(s["target_id"].alias("id"), s["target_label"].alias("label")))
    label = lambda end: F.get(F.filter(F.flatten(F.transform("steps", both)), lambda n: n["id"] == F.col("ends")[end]), F.lit(0))["label"]
    ids = lambda keep: F.array_join(F.transform(F.filter("steps", keep), lambda s: s["id"]), ", ")
    low, against = ids(lambda s: s["confidence"] < LOW), ids(lambda s: s["disputed"])
    caveats = F.array_compact(
        F.array(
            F.lit(ADVICE),
            F.when(F.exists("steps", lambda s: s["evidence_type"] == "inferred"), F.lit(INFERRED)),
            F.when(low != "", F.concat(F.lit("Lower-confidence links (below 0.7): "), low, F.lit("."))),
            F.when(against != "", F.concat(F.lit("Other evidence contradicts: "), against, F.lit("."))),
            F.lit(TEMPLATE),
        )
    )
    summary = F.concat(F.lit("This path links "), label("start"), F.lit(" to "), label("end"), F.format_string(" through %d recorded fact(s).", F.size("steps")))
    return whole.select("explanation_id", F.size("steps").alias("n_steps"), summary.alias("summary"), F.array_join(F.transform("steps", lambda s: s["sentence"]), "\n").alias("steps"), F.array_join(caveats, "\n").alias("caveats"), key(F.transform("steps", lambda s: s["id"]), audience).alias("key"))


def key(edge_ids: Column, audience: str) -> Column:
    """Key of an explanation: of its edges in order, the audience and the version of the templates."""
    return F.sha2(F.concat_ws("\n", F.lit(VERSION), F.lit(audience), F.array_join(edge_ids, ",")), 256)


def content_hash(edges: DataFrame) -> DataFrame:
    """(id, hash) of what an explanation says about an edge; it is out of date when that changes."""
    content = F.concat_ws("\n", "id", "source_id", "relation", "target_id", "evidence_type", F.format_string("%.4f", "confidence"))
    return edges.select("id", F.sha2(content, 256).alias("hash"))


def explained(asked: DataFrame, cache: DataFrame, written: DataFrame) -> DataFrame:
    """asked (explanation_id, key) from the cache (key, text) if it is there, else as written from the templates (explanation_id, text)."""
    found = asked.join(cache.select("key", F.col("text").alias("cached")), "key", "left").join(written.select("explanation_id", F.col("text").alias("template")), "explanation_id", "left")
    return found.select("explanation_id", F.coalesce("cached", "template").alias("text"), F.when(F.col("cached").isNotNull(), "cache").otherwise("template").alias("origin"))


def caveats(edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """Per relation: its edges that are inferred, of low confidence, and disputed, and a text of what there is."""
    triple = ["source_id", "relation", "target_id"]
    marked = edges.join(disputes.select(*triple).distinct().withColumn("disputed", F.lit(True)), triple, "left")
    found = marked.groupBy("relation").agg(F.count_if(F.col("evidence_type") == "inferred").alias("n_inferred"), F.count_if(F.col("confidence") < LOW).alias("n_low"), F.count_if(F.coalesce("disputed", F.lit(False))).alias("n_disputed"))
    parts = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}"))) for c, word in (("n_inferred", "inferred"), ("n_low", "of low confidence"), ("n_disputed", "disputed"))]
    return found.withColumn("caveats", F.array_join(F.array_compact(F.array(*parts)), "; "))


def valid(explanations: DataFrame) -> DataFrame:
    """explanations (text, cited, asked: arrays of edge ids, disputed: of them, context) with problem, null if there is none."""
    unseen = F.filter(numbers(F.col("text")), lambda n: ~F.contains("context", n))
    problem = F.when(F.size(F.array_except("cited", "asked")) > 0, "cites others").when(F.size(F.array_except("disputed", "cited")) > 0, "omits a dispute").when(F.size(unseen) > 0, "unseen number")
    return explanations.withColumn("problem", problem)
