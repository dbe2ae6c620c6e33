"""Merging, trust and validation of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.fields import listed
from skein.functions.numeric import edge_id, round4
from skein.functions.text import literal_map
from skein.schema import BONUS_MOST, BONUS_STEP, DISPUTE_COST, INFERRED_MOST, SCORE_LEAST, SCORE_MOST

TRIPLE = ("source_id", "relation", "target_id")
#: The rubric's rules, each with its base and what it says; names of knowledge sources.
RULES = {
    "kb_gene_disease": (0.90, "curated KB gene-disease"),
    "kb_phenotype": (0.90, "curated KB phenotype annotation (HPO)"),
    "go_experimental": (0.85, "curated GO annotation, non-IEA evidence"),
    "go_iea": (0.80, "curated GO annotation, electronic (IEA) only"),
    "team_curated": (0.80, "team-curated with cited source (needs human check)"),
    "ctgov_record": (0.75, "ClinicalTrials.gov record, condition matched"),
    "reporter_record": (0.75, "NIH RePORTER project record"),
    "ctgov_alias": (0.65, "ClinicalTrials.gov record, condition matched by alias"),
    "org_page_read": (0.60, "org verified on its own site"),
    "org_url_resolves": (0.50, "org url resolves, scope page not read"),
    "curated_unverified": (0.50, "team-curated, key claim unverified [U]"),
    "inferred_high": (0.45, "OpenAI Extract claim, certainty high (hypothesis)"),
    "inferred_medium": (0.35, "OpenAI Extract claim, certainty medium (hypothesis)"),
    "inferred_low": (0.25, "OpenAI Extract claim or mention, low (hypothesis)"),
}
COMPUTED = "inferred_computed"
KNOWLEDGE_SOURCES = {"infores:omim": "OMIM", "infores:orphanet": "Orphanet"}
ELECTRONIC = "ECO:0000501"
EDGE = ("id", *TRIPLE, "source", "record_id", "confidence", "evidence_type", "qualifier")


def with_ids(evidence: DataFrame) -> DataFrame:
    """Evidence with id, hashed from triple, source and record."""
    return evidence.select(edge_id(*[F.col(c) for c in (*TRIPLE, "source", "record_id")]).alias("id"), "*")


def one_per_id(edges: DataFrame) -> DataFrame:
    """The most confident row of each id. Edges of other sources with the same triple stay: they are its provenance.

    The id tells the triple, so grouping by both is the same, and a filter on the triple reaches the scans below.
    """
    best = edges.groupBy("id", *TRIPLE).agg(F.max_by(F.struct(*EDGE[4:]), F.struct("confidence", "evidence_type", F.coalesce("qualifier", F.lit("")))).alias("b"))
    return best.select("id", *TRIPLE, "b.*")


def independent_source(source: Column, record: Column, qualifier: Column) -> Column:
    """What tells two assertions apart as independent: the knowledge source of monarch rows, the publication of extracted
    ones, the registry or publication that a curated row copies, else the source."""
    return (
        F.when(source == "monarch", F.coalesce(qualifier, F.lit("monarch")))
        .when(F.startswith(source, F.lit("openai:")), record)
        .when((source == "curated") & F.startswith(record, F.lit("NCT")), F.lit("clinicaltrials"))
        .when((source == "curated") & F.startswith(record, F.lit("PMID:")), record)
        .otherwise(source)
    )


def _plain_source(name: Column) -> Column:
    return F.regexp_replace(name, "^infores:", "")


def rule(source: Column, relation: Column, evidence_type: Column, qualifier: Column) -> Column:
    """The rubric's rule of an edge; null if it has none. The qualifier of extracted rows is the claim's certainty."""
    has_other = F.size(F.filter(listed(qualifier), lambda c: c != ELECTRONIC)) > 0
    extracted = F.when(relation == "mentions", "inferred_low").otherwise(F.concat(F.lit("inferred_"), F.coalesce(qualifier, F.lit("low"))))
    curated = F.when(qualifier == "page_read", "org_page_read").when(qualifier == "url_resolves", "org_url_resolves").when(qualifier == "unverified", "curated_unverified").otherwise("team_curated")
    known = (
        F.when(source == "monarch", F.when(relation == "has_phenotype", "kb_phenotype").otherwise("kb_gene_disease"))
        .when(source == "go", F.when(has_other, "go_experimental").otherwise("go_iea"))
        .when(source == "clinicaltrials", F.when(qualifier == "alias", "ctgov_alias").otherwise("ctgov_record"))
        .when(source == "reporter", "reporter_record")
        .when(source == "curated", curated)
    )
    return F.when(evidence_type == "inferred", F.when(F.startswith(source, F.lit("openai:")), extracted).otherwise(COMPUTED)).otherwise(known)


def _by_source(edges: DataFrame) -> DataFrame:
    """Per triple and independent source, by: n, its records."""
    own = independent_source(F.col("source"), F.col("record_id"), F.col("qualifier"))
    return edges.groupBy(*TRIPLE, own.alias("by")).agg(F.count("*").alias("n"))


def _names() -> Column:
    return F.array_join(F.array_sort(F.collect_set(_plain_source(F.col("by")))), ", ")


def corroboration(edges: DataFrame) -> DataFrame:
    """Independent sources of each triple: their number, the records, and the names, at most one a source."""
    return _by_source(edges).groupBy(*TRIPLE).agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_records"), _names().alias("sources"))


def _backing(edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """Per triple n_sources, n_disputes, the bonus and, of several sources, backed: what is said of them.

    One aggregate counts both. A join would not do: the relation of disputes is a constant, so what was dealt by triple would be dealt again by its ends.
    """
    against = disputes.groupBy(*TRIPLE).agg(F.count("*").alias("n_disputes"))
    found = _by_source(edges).withColumn("backs", F.lit(True)).unionByName(against, allowMissingColumns=True)
    counted = found.groupBy(*TRIPLE).agg(F.count_if("backs").alias("n_sources"), F.coalesce(F.sum("n_disputes"), F.lit(0)).alias("n_disputes"), _names().alias("sources"))
    several = F.col("n_sources") >= 2
    bonus = F.when(several, F.least(BONUS_STEP * (F.col("n_sources") - 1), F.lit(BONUS_MOST))).otherwise(0.0)
    backed = F.when(several, F.format_string("+%.2f corroborated by %d sources (%s)", bonus, "n_sources", "sources"))
    return counted.select(*TRIPLE, "n_sources", "n_disputes", bonus.alias("bonus"), backed.alias("backed"))


def rescored(edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """Each edge with rule, score and reasons. disputes (triple, record_id): the records that contradict a triple.

    The rule's base, or the edge's own confidence without one, plus a bonus for further independent sources, less a
    cost for each contradicting record (none for edges that contradict), inside the limits. Corroboration and
    disputes are counted and worded before they are joined, so what is joined is a row a triple. Every edge has the names
    of all sources of its triple, which grows with the square of these: edges get them last, so they are nowhere shuffled, sorted or spilled with edges.
    """
    marked = edges.join(_backing(edges, disputes), list(TRIPLE))
    marked = marked.withColumn("n_disputes", F.when(F.col("relation") == "contradicts", 0).otherwise(F.col("n_disputes")).cast("long"))
    marked = marked.withColumn("rule", rule(F.col("source"), F.col("relation"), F.col("evidence_type"), F.col("qualifier")))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, (v, _) in RULES.items() for x in (k, v)]), F.col("rule")), F.col("confidence"))
    said = literal_map({k: label for k, (_, label) in RULES.items()})[F.col("rule")]
    known = F.coalesce(literal_map(KNOWLEDGE_SOURCES)[F.col("qualifier")], _plain_source(F.col("qualifier")))
    via = F.when((F.col("source") == "monarch") & F.col("qualifier").isNotNull(), F.concat(F.lit(" ("), known, F.lit(" via Monarch)"))).otherwise("")
    first = (
        F.when(F.col("rule") == COMPUTED, F.format_string("computed analytics value %.2f", "confidence"))
        .when(said.isNull(), F.concat(F.lit("no rubric row for "), F.col("source"), F.lit("; ingest value")))
        .otherwise(F.concat(said, via, F.format_string(" %.2f", base)))
    )
    n, inferred = F.col("n_disputes"), F.col("evidence_type") == "inferred"
    value = base + F.col("bonus") - DISPUTE_COST * n
    reasons = F.array_compact(
        F.array(
            first,
            F.col("backed"),
            F.when(n > 0, F.concat(F.format_string("-%.2f contradicted by %d record", DISPUTE_COST * n, n), F.when(n == 1, "").otherwise("s"))),
            F.when(inferred & (value > INFERRED_MOST), F.lit("capped at 0.49: inferred stays below curated")),
        )
    )
    most = F.when(inferred, INFERRED_MOST).otherwise(SCORE_MOST)
    score = round4(F.least(F.greatest(value, F.lit(SCORE_LEAST)), most))
    return marked.select(*EDGE[:4], "evidence_type", "confidence", "rule", "n_sources", "n_disputes", score.alias("score"), F.array_join(reasons, "; ").alias("reasons"))


def contradiction_edges(edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """An edge of relation contradicts for each contradicting record, from it to the target of what it contradicts."""
    rows = disputes.join(edges.select(*TRIPLE).distinct(), list(TRIPLE), "left_semi")
    record = F.concat(F.lit("record:"), "record_id")
    made = rows.select(record.alias("source_id"), F.lit("contradicts").alias("relation"), "target_id", F.lit("registry").alias("source"), "record_id", F.lit(0.8).alias("confidence"), F.lit("curated").alias("evidence_type"), F.lit(None).cast("string").alias("qualifier"))
    return one_per_id(with_ids(made))


def contradicted_by(edges: DataFrame, disputes: DataFrame) -> DataFrame:
    """Per edge that is contradicted: the number of the edges that contradict it and the first five of their ids.

    An edge of a triple that many records dispute keeps a bounded list; the number is of all.
    """
    rows = disputes.select(*TRIPLE, F.concat(F.lit("record:"), "record_id").alias("from"), "record_id")
    by = edge_id(F.col("from"), F.lit("contradicts"), F.col("target_id"), F.lit("registry"), F.col("record_id"))
    named = rows.select(*TRIPLE, by.alias("by")).distinct()
    rank = F.row_number().over(Window.partitionBy(*TRIPLE).orderBy("by"))
    first = named.withColumn("r", rank).filter("r <= 5").groupBy(*TRIPLE).agg(F.array_join(F.array_sort(F.collect_list("by")), ",").alias("contradicted_by"))
    counts = named.groupBy(*TRIPLE).agg(F.count("*").alias("n"))
    return edges.select("id", *TRIPLE).join(counts.join(first, list(TRIPLE)), list(TRIPLE)).select("id", "n", "contradicted_by")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, subject): repeated ids, one id of several types, ends without a node, values out of range."""
    repeated_nodes = nodes.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("type").alias("t"))
    repeated_edges = edges.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    found = [
        repeated_nodes.filter("n > 1").select(F.lit("duplicate_node").alias("rule"), F.col("id").alias("subject")),
        repeated_nodes.filter("t > 1").select(F.lit("conflicting_type"), "id"),
        repeated_edges.select(F.lit("duplicate_edge"), "id"),
        ends.join(nodes.select("id"), "id", "left_anti").select(F.lit("dangling_end"), "id"),
        edges.filter("confidence < 0 or confidence > 1 or confidence is null").select(F.lit("confidence_range"), "id"),
        edges.filter("source_id = target_id").select(F.lit("self_loop"), "id"),
    ]
    return reduce(DataFrame.union, found)


def missing_support(edges: DataFrame, supports: DataFrame) -> DataFrame:
    """Rows of supports (id, supporting_id) whose supporting edge doesn't exist."""
    return supports.join(edges.select(F.col("id").alias("supporting_id")), "supporting_id", "left_anti").select("id", "supporting_id")


def error_report(found: DataFrame, most: int = 10) -> DataFrame:
    """One row (n, report) of violations (rule, subject): the first `most` by rule and subject, and how many more there are."""
    line = F.concat_ws(": ", "rule", "subject")
    first = found.orderBy("rule", "subject").limit(most).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    counted = found.agg(F.count("*").alias("n")).join(F.broadcast(first))
    more = F.when(F.col("n") > most, F.format_string(" (+%d more)", F.col("n") - most)).otherwise("")
    return counted.select("n", F.concat(F.array_join("lines", "; "), more).alias("report"))


def merged_nodes(rows: DataFrame) -> DataFrame:
    """Nodes (id, rank, type, label) merged by id: the first row by rank gives type and label, other labels are synonyms."""
    first = F.min_by(F.struct("type", "label"), F.struct("rank", "label")).alias("f")
    merged = rows.groupBy("id").agg(first, F.array_sort(F.collect_set("label")).alias("labels"))
    return merged.select("id", "f.type", "f.label", F.array_join(F.array_remove("labels", F.col("f.label")), "|").alias("synonyms"))


def latest(rows: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The last row of each key by order, as an aggregate."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("v")).select(*key, "v.*")


def capped(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each key, by a window whose limit Spark applies before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= most)
