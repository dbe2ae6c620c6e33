"""Readers of source payloads: ontologies, annotation tables, JSON records and XML abstracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSOCIATION = "subject string, predicate string, object string, subject_label string, object_label string, primary_knowledge_source string, negated boolean, publications array<string>"
STUDY = "nct_id string, brief_title string, status string, phases array<string>, enrollment bigint, conditions array<string>, interventions array<struct<type:string,name:string>>"
PROJECT = "core_project_num string, appl_id bigint, fiscal_year int, project_title string, principal_investigators array<struct<profile_id:bigint,full_name:string>>"
CLAIM = "pmid string, subject_id string, relation string, object_id string"


def json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Records with a stated schema, so that no pass over the files infers one; malformed lines become null rows."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an OBO file: id, name, parents, alt_ids. Obsolete terms and other stanzas are left out.

    Stanzas are read as records, so a file of any size is split between tasks.
    """
    stanza = spark.read.option("lineSep", "\n[").text(path).filter(F.startswith("value", F.lit("Term]")))
    stanza = stanza.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))

    def tag(name: str) -> Column:
        return F.regexp_extract_all("value", F.lit(rf"(?m)^{name}: ([^\n!]*[^\n! ])"), F.lit(1))

    live = stanza.filter(~F.regexp_like("value", F.lit(r"(?m)^is_obsolete: true")))
    return live.select(F.get(tag("id"), F.lit(0)).alias("id"), F.get(tag("name"), F.lit(0)).alias("name"), tag("is_a").alias("parents"), tag("alt_id").alias("alt_ids")).filter("id is not null")


def term_parents(terms: DataFrame) -> DataFrame:
    """(child, parent) of an ontology, alternative ids replaced by the terms that have them."""
    known = terms.select(F.explode("alt_ids").alias("parent"), F.col("id").alias("live"))
    pairs = terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))
    return pairs.join(known, "parent", "left").select("child", F.coalesce("live", "parent").alias("parent"))


def annotations(spark: SparkSession, path: str, terms: DataFrame | None = None) -> DataFrame:
    """(thing, term) of a tab-separated annotation table with comments above its header: phenotype rows that aren't negated."""
    columns = "database_id string, disease_name string, qualifier string, hpo_id string, reference string, evidence string, onset string, frequency string, sex string, modifier string, aspect string, biocuration string"
    rows = spark.read.schema(columns).option("sep", "\t").option("comment", "#").csv(path).filter("database_id <> 'database_id'")
    kept = rows.filter((F.col("aspect") == "P") & ~F.col("qualifier").eqNullSafe("NOT")).select(F.col("database_id").alias("thing"), F.col("hpo_id").alias("term"))
    if terms is not None:
        kept = kept.join(terms.select(F.explode("alt_ids").alias("term"), F.col("id").alias("live")), "term", "left").select("thing", F.coalesce("live", "term").alias("term"))
    return kept.distinct()


def abstracts(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract (its parts joined) and year of an XML set of articles."""
    schema = "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>>>"
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select("MedlineCitation.*")
    date = F.col("Article.Journal.JournalIssue.PubDate")
    year = F.coalesce(date["Year"], F.nullif(F.regexp_extract(date["MedlineDate"], "([0-9]{4})", 1), F.lit("")))
    return rows.select(F.col("PMID._VALUE").alias("pmid"), F.col("Article.ArticleTitle").alias("title"), F.array_join("Article.Abstract.AbstractText", " ").alias("abstract"), year.cast("int").alias("year"))


def associations(rows: DataFrame) -> DataFrame:
    """Evidence rows of gene-disease associations that aren't negated.

    'causes' runs from disease to gene as caused_by; a mere association is upgraded to it where the same pair also
    has a cause, and is a risk factor otherwise.
    """
    live = rows.filter(~F.coalesce("negated", F.lit(False)))
    causes = live.filter("predicate = 'biolink:causes'").select("subject", "object").distinct().withColumn("cause", F.lit(True))
    marked = live.join(causes, ["subject", "object"], "left").withColumn("cause", F.coalesce("cause", F.lit(False)))
    source = F.regexp_replace(F.coalesce("primary_knowledge_source", F.lit("unknown")), "^infores:", "")
    return marked.select(
        F.when(F.col("cause"), F.col("object")).otherwise(F.col("subject")).alias("source_id"),
        F.when(F.col("cause"), "caused_by").otherwise("risk_factor_for").alias("relation"),
        F.when(F.col("cause"), F.col("subject")).otherwise(F.col("object")).alias("target_id"),
        source.alias("source"),
        F.concat_ws("|", source, "subject", "predicate", "object").alias("record_id"),
    ).distinct()


def latest_projects(projects: DataFrame) -> DataFrame:
    """A row per investigator and project: its latest record by fiscal year and application."""
    latest = projects.groupBy("core_project_num").agg(F.max_by(F.struct("project_title", "fiscal_year", "principal_investigators"), F.struct("fiscal_year", "appl_id")).alias("p"))
    return latest.select("core_project_num", "p.project_title", "p.fiscal_year", F.explode("p.principal_investigators").alias("pi")).filter("pi.profile_id is not null").select("pi.profile_id", "pi.full_name", "core_project_num", "project_title", "fiscal_year")


def matched_studies(studies: dict[str, DataFrame]) -> DataFrame:
    """Union of bounded queries (name: rows) keyed by study, with the sorted names of the queries that found it."""
    every = None
    for name, rows in studies.items():
        tagged = rows.withColumn("query", F.lit(name))
        every = tagged if every is None else every.unionByName(tagged)
    columns = [c for c in every.columns if c not in ("nct_id", "query")]
    return every.groupBy("nct_id").agg(F.min_by(F.struct(*columns), "query").alias("s"), F.array_sort(F.collect_set("query")).alias("matched")).select("nct_id", "s.*", "matched")
