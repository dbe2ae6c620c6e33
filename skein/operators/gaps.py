"""Reports of what is known, weak or missing at every node, with the questions that follow and the sources that were searched.

Tables: nodes (id, type, label), edges, seeds (id, kind) and searches (id, searched, closest, not_searched: arrays of text), which
say what was looked for and not found. Everything is an aggregate per node, combined before the shuffle, and only ends at diseases meet
the node at the other end; weak leads, which a hub has many of, are rows of their own and only counted in the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.work import saved
from skein.schema import STRONG

#: Results and their status, kinds of seeds, what is never searched, and the sentences of the report.
STATUS = {"supported": "supported", "weak_routes_only": "weak", "no_supported_route": "gap"}
UNSTUDIED, UNTERMED, GAP = "seed_diseases_without_studies", "go_genes_without_whitelisted_terms", "gap_disease"
NOT_SEARCHED = (
    "omim (license not obtained)",
    "orphanet (not ingested in this snapshot)",
    "nih_reporter (only the slice's text searches, fiscal years 2019-2026)",
    "pubmed (only team-curated citations, no systematic search)",
)
PUBLICATION_LEAD, LOW_LEAD = "single publication, not a study or a partner", "low confidence"
NO_STUDY, NO_PARTNER, SEARCHED = "No ClinicalTrials.gov study or reusable asset is linked to %s", "No patient organisation or funder is linked to %s", " (searched: %s)"
NO_PROJECT, NO_GENE, NO_TERM = "No NIH RePORTER project or investigator is linked to %s", "No causal or risk gene is annotated for %s", "No whitelisted GO mechanism term for %s"
UNMAPPED = "%s is unmapped: no edges in this snapshot"
ASK_STUDY = "Would a study on another %s-linked disease accept %s patients, samples or natural-history data?"
ASK_PARTNER, CLOSEST = "Is there a registry or family network for %s?", " Closest communities: %s."
ASK_GENE, ASK_TERM, ASK_SOURCE = "Which gene or variant explains %s?", "Which lysosomal or autophagy process does %s act through?", "Which source would connect %s to a disease?"
ROLES = {"study": "study", "asset": "study", "patient_group": "partner", "funder": "partner", "gene": "gene", "publication": "publication"}


def _ends(edges: DataFrame) -> DataFrame:
    """An edge at each of its ends, once at a loop: id, other_id, relation, confidence, strong, and edge_id if edges have ids."""
    ends = F.array_distinct(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other_id")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other_id"))))
    strong = (F.col("evidence_type") != "inferred") & (F.col("confidence") >= STRONG)
    named = [F.col("id").alias("edge_id")] if "id" in edges.columns else []
    return edges.select(F.explode(ends).alias("e"), *named, "relation", "confidence", strong.alias("strong")).select("e.*", *[c for c in ("edge_id",) if named], "relation", "confidence", "strong")


def _at(diseases: DataFrame, nodes: DataFrame, ends: DataFrame, *roles: str) -> DataFrame:
    """The ends at diseases (id, ...) whose other end is a node of one of the roles (none: of any), with role. Types of other nodes are met at diseases only."""
    types = {kind: role for kind, role in ROLES.items() if role in (roles or ROLES.values())}
    role = reduce(lambda found, pair: found.when(F.col("type") == pair[0], pair[1]), types.items(), F.when(F.lit(False), ""))
    others = nodes.filter(F.col("type").isin(*types)).select(F.col("id").alias("other_id"), role.alias("role"))
    return ends.join(diseases, "id").join(others, "other_id")


def _texts(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def report(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, searches: DataFrame, projects_searched: bool) -> DataFrame:
    """Per node: id, type, result, status, missing and questions and not_searched (arrays of text), n_edges, n_leads.

    A disease is supported by a strong edge to a study, asset or partner, unless it is seeded as the gap; any other node by any
    strong edge. The names of genes in a question are collected only for diseases without a study.
    """
    ends = _ends(edges)
    role = lambda name: F.col("role") == name
    diseases = nodes.filter("type = 'disease'").select("id")
    counted = ends.groupBy("id").agg(F.count("*").alias("n_edges"), F.count_if("strong").alias("n_strong"), F.count_if(F.col("relation") == "investigates").alias("n_projects"))
    route = role("study") | role("partner")
    routes = _at(diseases, nodes, ends).groupBy("id").agg(
        F.count_if(role("study")).alias("n_studies"), F.count_if(role("partner")).alias("n_partners"), F.count_if(role("gene")).alias("n_genes"), F.count_if(role("publication")).alias("n_publications"),
        F.count_if(route).alias("n_routes"), F.count_if(route & F.col("strong")).alias("n_strong_routes"),
    )
    routes = saved(routes)
    marks = seeds.groupBy("id").agg(*[F.bool_or(F.col("kind") == kind).alias(name) for name, kind in (("unstudied", UNSTUDIED), ("untermed", UNTERMED), ("is_gap", GAP))])
    told = searches.dropDuplicates(["id"])
    base = nodes.join(counted, "id", "left").join(routes, "id", "left").join(marks, "id", "left").join(told.withColumn("told", F.lit(True)), "id", "left").na.fill(0).na.fill(False, ["unstudied", "untermed", "is_gap", "told"])
    open_ = diseases.join(routes.filter("n_genes > 0"), "id").join(marks, "id", "left").filter("n_studies = 0 or unstudied").select("id").distinct()
    genes = _at(open_, nodes, ends, "gene").select("id", "other_id").distinct().join(nodes.select(F.col("id").alias("other_id"), F.col("label").alias("gene")), "other_id")
    labels = genes.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("other_id", "gene"))), lambda g: g["gene"]), ", ").alias("genes"))
    base = base.join(labels, "id", "left")
    label, disease = F.col("label"), F.col("type") == "disease"
    says = lambda text, *values: F.format_string(text, *(values or (label,)))
    joined = lambda name: F.coalesce(F.array_join(name, ", "), F.lit(""))
    tail = lambda text, value: F.when(value != "", F.format_string(text, value)).otherwise("")
    no_study, no_partner, no_gene = disease & ((F.col("n_studies") == 0) | F.col("unstudied")), disease & (F.col("n_partners") == 0), disease & (F.col("n_genes") == 0)
    untermed, unmapped = ~disease & F.col("untermed"), ~disease & (F.col("n_edges") == 0)
    missing = _texts(
        F.when(no_study, says(NO_STUDY)), F.when(no_partner, F.concat(says(NO_PARTNER), tail(SEARCHED, joined("searched")))), F.when(disease & (F.col("n_projects") == 0) & F.lit(projects_searched), says(NO_PROJECT)),
        F.when(no_gene, says(NO_GENE)), F.when(untermed, says(NO_TERM)), F.when(unmapped, says(UNMAPPED)),
    )
    questions = _texts(
        F.when(no_study & F.col("genes").isNotNull(), says(ASK_STUDY, F.col("genes"), label)), F.when(no_partner, F.concat(says(ASK_PARTNER), tail(CLOSEST, joined("closest")))),
        F.when(no_gene, says(ASK_GENE)), F.when(untermed, says(ASK_TERM)), F.when(unmapped, says(ASK_SOURCE)),
    )
    some, strong = F.when(disease, F.col("n_routes")).otherwise(F.col("n_edges")), F.when(disease, F.when(F.col("is_gap"), 0).otherwise(F.col("n_strong_routes"))).otherwise(F.col("n_strong"))
    result = F.when(strong > 0, "supported").when(some > 0, "weak_routes_only").otherwise("no_supported_route")
    status = reduce(lambda found, pair: found.when(result == pair[0], pair[1]), list(STATUS.items())[1:], F.when(result == "supported", "supported"))
    n_leads = F.when(disease, F.col("n_publications")).otherwise(F.lit(0)) + F.when(result == "weak_routes_only", some).otherwise(F.lit(0))
    beyond = F.array_distinct(F.concat(F.array(*map(F.lit, NOT_SEARCHED)), F.coalesce("not_searched", F.array().cast("array<string>"))))
    return base.select("id", "type", result.alias("result"), status.alias("status"), missing.alias("missing"), questions.alias("questions"), beyond.alias("not_searched"), "n_edges", n_leads.alias("n_leads"))


def leads(nodes: DataFrame, edges: DataFrame, reported: DataFrame) -> DataFrame:
    """(id, edge_id, confidence, why) of what is weak: a disease's publications, and where only weak routes exist, these."""
    ends, weak = _ends(edges), F.col("result") == "weak_routes_only"
    diseases = saved(reported.filter("type = 'disease'").select("id", weak.alias("weak")))
    # Where only weak routes exist there is no strong edge, but at a disease that is seeded as the gap.
    other = ends.filter(~F.coalesce("strong", F.lit(False))).join(reported.filter(weak & (F.col("type") != "disease")).select("id"), "id")
    found = [
        (_at(diseases.select("id"), nodes, ends, "publication"), PUBLICATION_LEAD),
        (_at(diseases.filter("weak").select("id"), nodes, ends, "study", "partner"), LOW_LEAD),
        (other, LOW_LEAD),
    ]
    return reduce(DataFrame.union, [at.select("id", "edge_id", "confidence", F.lit(why).alias("why")) for at, why in found])


def sources(nodes: DataFrame, edges: DataFrame, searched: dict[str, str | None]) -> DataFrame:
    """(id, source, version, n): the records found at each node in every source that was searched (name: version), 0 where none were, and in others."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"), "source")
    found = ends.groupBy("id", "source").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(v).cast("string").alias("version")) for s, v in searched.items()])
    asked = nodes.select("id", F.explode(names).alias("s")).select("id", "s.*")
    own = found.join(nodes.select("id"), "id", "left_semi")
    return asked.join(own, ["id", "source"], "full").select("id", "source", "version", F.coalesce("n", F.lit(0)).alias("n"))


def instead(pairs: DataFrame, answered: DataFrame, reported: DataFrame) -> DataFrame:
    """For pairs (from_id, to_id) without an answer (same columns): the report of the target, or of the source if the target is supported."""
    left = pairs.join(answered.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    result = reported.select("id", "result")
    target = left.join(result.withColumnsRenamed({"id": "to_id", "result": "to_result"}), "to_id", "left")
    about = F.when(F.col("to_result") == "supported", F.col("from_id")).otherwise(F.col("to_id"))
    return target.select("from_id", "to_id", about.alias("id")).join(reported, "id", "left")
