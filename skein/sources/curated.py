"""Curated files: entries of YAML or JSON documents, rules that put bad ones into rejects with a reason, and the nodes and edges of the rest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import squeezed
from skein.operators.trust import with_ids
from skein.schema import RELATIONS

ENTRIES = "file string, section string, seq long, entry string, problem string"
#: Sections and prefixes of ids, kinds of organizations that fund, confidences, and forms of ids.
ASSETS, ORGANIZATIONS, MECHANISMS, ALIASES, CONTRADICTIONS, SEEDS = "assets", "organizations", "mechanisms", "aliases", "contradictions", "no_dedicated_org_found"
STUDY_PREFIX, ASSET_PREFIX, ORG_PREFIX = "clinicaltrials:", "asset:", "org:"
FUNDERS = ("research_funder_program", "research_charity")
CURATED, PAGE_READ, URL_RESOLVES = 0.8, 0.6, 0.5
VERIFICATIONS = ("verified", "unverified")
IS_STUDY, IS_PUBLICATION, IS_TERM, IS_SLUG, IS_EDGE = r"^NCT[0-9]{8}$", r"^PMID:[0-9]+$", r"^GO:[0-9]{7}$", r"^[a-z0-9]+(-[a-z0-9]+)*$", r"^E:[0-9a-f]{16}$"
READ = r"\b(page|homepage) read\b"

ENTRY = (
    "id string, name string, type string, url string, retrieved string, curator string, notes string, verified string, source_record_id string, disease_id string, summary string, verification string, "
    "disease_ids array<string>, funds array<string>, operates array<string>, searched array<string>, closest_communities array<string>, not_searched array<string>, attributes map<string,string>, "
    "contradicts struct<source_id:string,target_id:string>, bears_on array<struct<edge_id:string,source_id:string,relation:string,target_id:string>>, evidence array<struct<url:string,quote:string,retrieved:string>>"
)


def _documents(text: str) -> Iterator[object]:
    """The documents of a text: JSON if it is that, else YAML, where there is a parser for it."""
    try:
        yield json.loads(text)
        return
    except ValueError:
        pass
    import yaml

    yield from yaml.safe_load_all(text)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, seq, entry as JSON, problem) of each entry of each list in the mappings at the top of the documents of path.

    A file is read by one task, files by many. What isn't a mapping, or can't be read, is one row with a problem; dates are ISO texts.
    """

    def entries(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in ENTRIES.split(", ")]
        for batch in files:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    for document in _documents(bytes(content).decode()):
                        if document is not None and not isinstance(document, dict):
                            rows.append((file, None, 0, None, "not a mapping"))
                            continue
                        for section, items in (document or {}).items():
                            rows += [(file, str(section), len(rows) + i, json.dumps(item, default=str, ensure_ascii=False), None) for i, item in enumerate(items if isinstance(items, list) else [])]
                except Exception as error:  # noqa: BLE001: any fault of a file is told, not raised
                    rows = [(file, None, 0, None, f"not readable: {type(error).__name__}")]
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, ENTRIES)


def _blank(column: str) -> Column:
    return F.coalesce(squeezed(F.col(column)), F.lit("")) == ""


def _linked(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit("^https?://")), F.lit(False))


def _dated(day: Column) -> Column:
    return F.substring(day, 1, 10).try_cast("date")


def checked(entries: DataFrame) -> DataFrame:
    """entries with their fields and problem, null if an entry is good; the first rule broken is named.

    Fields are read by one schema. Assets, organizations and mechanisms need id, url and a date, and links of an organization must
    name assets of the same table; aliases need name, disease_id and url; contradictions are judged by all their parts. Slugs of
    contradictions are unique: the first by file and seq stays. Other sections are carried without a rule.
    """
    rows = entries.withColumn("e", F.from_json("entry", ENTRY)).select("file", "section", "seq", "problem", "e.*")
    base = F.col("section").isin(ASSETS, ORGANIZATIONS, MECHANISMS)
    slugs = rows.filter(F.col("section") == ASSETS).select(F.col("id").alias("slug")).distinct()
    links = rows.filter(F.col("section") == ORGANIZATIONS).select("file", "seq", F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("funds", "operates")])).alias("slug"))
    lost = links.join(slugs, "slug", "left_anti").groupBy("file", "seq").agg(F.min("slug").alias("lost"))
    first = rows.filter(F.col("section") == CONTRADICTIONS).groupBy(F.col("id").alias("slug")).agg(F.min(F.struct("file", "seq")).alias("first"))
    joined = rows.join(lost, ["file", "seq"], "left").join(first, (F.col("section") == CONTRADICTIONS) & (F.col("id") == F.col("slug")), "left")
    against = F.col("section") == CONTRADICTIONS
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) < 1
    triple = lambda b: b["source_id"].isNotNull() & b["target_id"].isNotNull() & F.coalesce(b["relation"].isin(*RELATIONS), F.lit(False))
    bad_bearing = F.coalesce(F.exists("bears_on", lambda b: F.when(b["edge_id"].isNotNull(), ~F.regexp_like(b["edge_id"], F.lit(IS_EDGE))).otherwise(~triple(b))), F.lit(False))
    bad_evidence = F.coalesce(F.exists("evidence", lambda v: ~_linked(v["url"]) | (F.coalesce(squeezed(v["quote"]), F.lit("")) == "") | _dated(v["retrieved"]).isNull()), F.lit(True))
    rules = [
        (base & (_blank("id") | _blank("url") | _blank("retrieved")), "needs id, url and retrieved"), (base & ~_linked(F.col("url")), "url isn't http(s)"), (base & _dated(F.col("retrieved")).isNull(), "bad date"),
        (F.col("section").isin(ASSETS, ORGANIZATIONS) & _blank("name"), "needs a name"), (F.col("lost").isNotNull(), "unknown asset"),
        ((F.col("section") == MECHANISMS) & ~F.regexp_like("id", F.lit(IS_TERM)), "not a term id"), ((F.col("section") == ALIASES) & (_blank("name") | _blank("disease_id") | _blank("url")), "needs name, disease_id and url"),
        (against & ~F.coalesce(F.regexp_like("id", F.lit(IS_SLUG)), F.lit(False)), "id isn't a slug"), (against & (F.struct("file", "seq") != F.col("first")), "id isn't unique"),
        (against & ~F.coalesce(F.col("verification").isin(*VERIFICATIONS), F.lit(False)), "bad verification"), (against & (F.col("contradicts.source_id").isNull() | F.col("contradicts.target_id").isNull()), "needs both ends"),
        (against & (_blank("summary") | _blank("curator")), "needs summary and curator"), (against & none("evidence"), "needs evidence"), (against & bad_evidence, "bad evidence"), (against & bad_bearing, "bad bears_on"),
    ]
    return joined.withColumn("problem", F.coalesce("problem", *[F.when(bad, F.lit(why)) for bad, why in rules])).drop("lost", "slug", "first")


def asset_node(record: Column, kind: Column, slug: Column) -> tuple[Column, Column]:
    """Id and type of an asset's node: of a registered study, of a publication, or its own."""
    study = F.coalesce(F.regexp_like(record, F.lit(IS_STUDY)), F.lit(False))
    paper = F.coalesce(F.regexp_like(record, F.lit(IS_PUBLICATION)) & F.startswith(kind, F.lit("publication")), F.lit(False))
    return F.when(study, F.concat(F.lit(STUDY_PREFIX), record)).when(paper, record).otherwise(F.concat(F.lit(ASSET_PREFIX), slug)), F.when(study, "study").when(paper, "publication").otherwise("asset")


def graph(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, attributes) and evidence with ids of the good rows of checked(): assets and organizations.

    Of two assets with one slug, links go to the node of the last by file and seq. A node that several entries name comes once an entry;
    links to an asset that was rejected are left out with it.
    """
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown"))
    node_id, node_type = asset_node(F.col("source_record_id"), F.col("type"), F.col("id"))
    shared = {"url": F.col("url"), "curated_retrieved": F.col("retrieved"), "curator": squeezed(F.col("curator")), "curated_notes": squeezed(F.col("notes"))}

    def attributes(more: dict[str, Column]) -> Column:
        pairs = F.create_map(*[x for name, value in (shared | more).items() for x in (F.lit(name), value)])
        return F.map_filter(pairs, lambda _, v: F.coalesce(v, F.lit("")) != "")

    assets = good.filter(F.col("section") == ASSETS).select("*", node_id.alias("node_id"), node_type.alias("node_type"), kind.alias("kind"))
    own = F.transform_keys(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("curated_"), k))
    asset_nodes = assets.select(F.col("node_id").alias("id"), F.col("node_type").alias("type"), squeezed(F.col("name")).alias("label"), F.map_concat(attributes({"asset_slug": F.col("id"), "asset_type": F.col("kind")}), own).alias("attributes"))
    orgs = good.filter(F.col("section") == ORGANIZATIONS).select("*", F.concat(F.lit(ORG_PREFIX), "id").alias("node_id"), kind.alias("kind"), F.coalesce(F.regexp_like("verified", F.lit(READ)), F.lit(False)).alias("page_read"))
    org_nodes = orgs.select(F.col("node_id").alias("id"), F.when(F.col("kind").isin(*FUNDERS), "funder").otherwise("patient_group").alias("type"), squeezed(F.col("name")).alias("label"), attributes({"org_type": F.col("kind"), "verified": squeezed(F.col("verified"))}).alias("attributes"))
    row = lambda relation, target, record, confidence, qualifier: [F.col("node_id").alias("source_id"), relation.alias("relation"), target.alias("target_id"), F.lit("curated").alias("source"), record.alias("record_id"), confidence.alias("confidence"), F.lit("curated").alias("evidence_type"), qualifier.alias("qualifier")]
    about = assets.withColumn("disease", F.explode("disease_ids")).select(*row(F.when(F.col("node_type") == "publication", "mentions").otherwise("studies_condition"), F.col("disease"), F.coalesce(F.nullif(F.col("source_record_id"), F.lit("")), F.col("id")), F.lit(CURATED), F.lit("cited")))
    stands = orgs.withColumn("disease", F.explode("disease_ids")).select(*row(F.lit("represents"), F.col("disease"), F.col("id"), F.when(F.col("page_read"), PAGE_READ).otherwise(URL_RESOLVES), F.when(F.col("page_read"), "page_read").otherwise("url_resolves")))
    to = assets.groupBy(F.col("id").alias("slug")).agg(F.max_by("node_id", F.struct("file", "seq")).alias("asset"))

    def links(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda s: F.struct(F.lit(name).alias("link"), s.alias("slug")))

    pairs = F.explode(F.concat(links("funds"), links("operates")))
    linked = orgs.withColumn("l", pairs).select("*", "l.link", "l.slug").join(to, "slug").select(*row(F.col("link"), F.col("asset"), F.concat_ws("|", "id", "link", "slug"), F.lit(CURATED), F.lit("cited")))
    return asset_nodes.unionByName(org_nodes), with_ids(about.unionByName(stands).unionByName(linked))


def latest(good: DataFrame) -> DataFrame:
    """One row (records, retrieved_at): how many assets and organizations there are, and the latest day one was read, at midnight."""
    kept = good.filter(F.col("section").isin(ASSETS, ORGANIZATIONS))
    day = F.coalesce(F.max(F.substring("retrieved", 1, 10)), F.lit("1970-01-01"))
    return kept.agg(F.count("*").alias("records"), F.concat(day, F.lit("T00:00:00Z")).alias("retrieved_at"))


def selectors(good: DataFrame) -> DataFrame:
    """(slug, edge_id, source_id, relation, target_id) of all edges that good contradictions bear on, by id or by triple."""
    return good.filter(F.col("section") == CONTRADICTIONS).select(F.col("id").alias("slug"), F.explode("bears_on").alias("b")).select("slug", "b.*")
