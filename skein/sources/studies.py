"""Registered studies: nested records read by the leaves that are used, as flat rows, attributes and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import clipped, squeezed

#: The address of a study's page, the prefix of its node, the length of a summary.
PAGE, PREFIX, SUMMARY_MOST = "https://clinicaltrials.gov/study/", "clinicaltrials:", 400
#: Where each field is in a record, and its type; no other leaf is parsed.
LEAVES = {
    "nct_id": ("identificationModule.nctId", "string"), "brief_title": ("identificationModule.briefTitle", "string"), "acronym": ("identificationModule.acronym", "string"),
    "status": ("statusModule.overallStatus", "string"), "why_stopped": ("statusModule.whyStopped", "string"), "start_date": ("statusModule.startDateStruct.date", "string"), "primary_completion": ("statusModule.primaryCompletionDateStruct.date", "string"),
    "phases": ("designModule.phases", "array<string>"), "study_type": ("designModule.studyType", "string"), "enrollment": ("designModule.enrollmentInfo.count", "bigint"), "enrollment_type": ("designModule.enrollmentInfo.type", "string"),
    "conditions": ("conditionsModule.conditions", "array<string>"), "interventions": ("armsInterventionsModule.interventions", "array<struct<type:string,name:string>>"), "sponsor": ("sponsorCollaboratorsModule.leadSponsor.name", "string"),
    "brief_summary": ("descriptionModule.briefSummary", "string"),
}


def _tree() -> dict:
    tree: dict = {}
    for path, kind in LEAVES.values():
        *above, leaf = path.split(".")
        at = tree
        for name in above:
            at = at.setdefault(name, {})
        at[leaf] = kind
    return tree


def _ddl(tree: dict) -> str:
    return ", ".join(f"{name}: {kind if isinstance(kind, str) else f'struct<{_ddl(kind)}>'}" for name, kind in tree.items())


#: The schema of a record: what LEAVES names and nothing else.
RECORD = f"protocolSection struct<{_ddl(_tree())}>, hasResults boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Flat studies of files with a record a line; a malformed line is a row without an id, which is dropped."""
    return flat(spark.read.schema(RECORD).json(path)).filter("nct_id is not null")


def flat(records: DataFrame) -> DataFrame:
    """One column a field; arrays are empty, has_results false where a record says nothing; the summary is squeezed and clipped. Other columns stay."""
    fields = [F.coalesce(F.col(f"protocolSection.{path}"), F.array().cast(kind)).alias(name) if kind.startswith("array") else F.col(f"protocolSection.{path}").alias(name) for name, (path, kind) in LEAVES.items()]
    others = [c for c in records.columns if c not in ("protocolSection", "hasResults", "has_results", *LEAVES)]
    out = records.select(*fields, F.coalesce("hasResults", F.lit(False)).alias("has_results"), *others)
    return out.withColumn("brief_summary", clipped(F.coalesce(squeezed(F.col("brief_summary")), F.lit("")), SUMMARY_MOST))


def _named(items: Column, field: str) -> Column:
    return F.filter(F.transform(items, lambda i: i[field]), lambda v: F.coalesce(v, F.lit("")) != "")


def attributes(studies: DataFrame) -> Column:
    """The map of a study's attributes, texts all, blank ones left out. matched_queries (an array) is told where there is one."""
    phase = F.array_join(F.transform("phases", lambda p: F.replace(p, F.lit("PHASE"), F.lit(""))), "/")
    told = {
        "nct_id": F.col("nct_id"), "url": F.concat(F.lit(PAGE), "nct_id"), "phase": phase, "enrollment": F.col("enrollment").cast("string"), "conditions": F.array_join("conditions", "; "),
        "interventions": F.array_join(_named(F.col("interventions"), "name"), "; "), "intervention_types": F.array_join(F.array_sort(F.array_distinct(_named(F.col("interventions"), "type"))), "; "),
        "has_results": F.col("has_results").cast("string"), "description": F.col("brief_summary"),
    }
    told |= {c: F.col(c) for c in ("acronym", "status", "why_stopped", "study_type", "enrollment_type", "sponsor", "start_date", "primary_completion")}
    if "matched_queries" in studies.columns:
        told["matched_queries"] = F.array_join("matched_queries", ",")
    pairs = F.create_map(*[x for name in sorted(told) for x in (F.lit(name), told[name])])
    return F.map_filter(pairs, lambda _, v: F.coalesce(v, F.lit("")) != "")


def nodes(studies: DataFrame) -> DataFrame:
    """(id, type, label, synonyms, attributes) of flat studies with an id; a study without a title has its id as label."""
    title, acronym = squeezed(F.coalesce("brief_title", F.lit(""))), squeezed(F.coalesce("acronym", F.lit("")))
    known = studies.filter("nct_id is not null")
    synonyms = F.filter(F.array(acronym, F.col("nct_id")), lambda s: s != "")
    return known.select(F.concat(F.lit(PREFIX), "nct_id").alias("id"), F.lit("study").alias("type"), F.coalesce(F.nullif(title, F.lit("")), F.col("nct_id")).alias("label"), synonyms.alias("synonyms"), attributes(known).alias("attributes"))
