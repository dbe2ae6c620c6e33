"""Extracted claims: checked against the vocabulary and the text, then claim edges, mention edges and publication nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import squeezed
from skein.operators.trust import EDGE, TRIPLE, with_ids
from skein.operators.work import saved

#: Types of the vocabulary, what a claim may say, confidences, the version of the prompt.
CANDIDATE_TYPES = ("gene", "disease", "mechanism")
CLAIM_RELATIONS = ("caused_by", "risk_factor_for", "participates_in", "has_mechanism", "shares_mechanism_with", "claims", "mentions")
POLARITIES, CERTAINTIES = ("supports", "contradicts"), {"high": 0.6, "medium": 0.45, "low": 0.3}
MENTION_CONFIDENCE, PROMPT_VERSION, PUBLICATION = 0.3, "extract-v1", "PMID:"
#: Hex digits of the hashes by which the vocabulary is dealt, so that no task hashes all of it.
BUCKET_DIGITS = 3


def publication_id(doc: Column) -> Column:
    """PMID: and the number, whether or not it has the prefix."""
    text = doc.cast("string")
    return F.when(F.startswith(text, F.lit(PUBLICATION)), text).otherwise(F.concat(F.lit(PUBLICATION), text))


def _judged(raw: DataFrame, docs: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Claims with squeezed quote and problem, as checked() has them, but for repeated ones.

    The quote is looked up before ids are, so texts go no further. The vocabulary is written, so a small one is known to be.
    """
    said = raw.withColumn("quote", squeezed(F.col("quote")))
    if docs is not None:
        said = said.hint("shuffle_hash").join(docs.select("doc_id", squeezed(F.col("text")).alias("text")), "doc_id", "left")
    found = said.withColumn("_found", F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).drop("text")
    known = saved(nodes.filter(F.col("type").isin(*CANDIDATE_TYPES)).select("id").distinct())
    for end in ("subject", "object"):
        found = found.join(known.select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"{end}_known")), f"{end}_id", "left")
    fine = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(F.col("subject_known").isNull() | F.col("object_known").isNull(), "unknown id")
        .when(~fine(F.col("subject_id") != F.col("object_id")), "self")
        .when(~fine(F.col("relation").isin(*CLAIM_RELATIONS)), "relation")
        .when(~fine(F.col("polarity").isin(*POLARITIES)), "polarity")
        .when(~fine(F.col("certainty").isin(*CERTAINTIES)), "certainty")
        .when(~fine(F.col("quote") != ""), "no quote")
        .when(~F.col("_found"), "quote not found")
    )
    return found.select(*[c for c in raw.columns if c != "text"], problem.alias("problem"))


def _place(*also: Column) -> Column:
    return F.row_number().over(Window.partitionBy("doc_id", "model", "subject_id", "relation", "object_id", *also).orderBy("seq"))


def checked(raw: DataFrame, docs: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Claims (doc_id, model, seq, subject_id, relation, object_id, quote, polarity, certainty) with problem, null if they hold.

    In this order: unknown id, self, relation, polarity, certainty, no quote, quote not found, repeated. An id is known if a
    node of the vocabulary's types has it. A quote is found if the text of its document holds it verbatim, both with
    white space squeezed; a claim of a document that isn't there has none. Of the claims of a document and model that hold and say the
    same triple the first by seq stays. Texts meet claims by document id only: each is shuffled once, and never sorted, since a
    document's claims are what is looked up. docs is None if claims come with their document's text, squeezed, which then isn't shuffled at all.
    """
    judged = _judged(raw, docs, nodes)
    again = F.col("problem").isNull() & (F.col("_n") > 1)
    placed = judged.withColumn("_n", _place(F.isnull("problem")))
    return placed.select(*judged.columns[:-1], F.when(again, "repeated").otherwise(F.col("problem")).alias("problem"))


def holding(raw: DataFrame, docs: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """The claims of checked() without a problem. The others are dropped where they are found, so only these are shuffled."""
    return _judged(raw, docs, nodes).filter("problem is null").drop("problem").withColumn("_n", _place()).filter("_n = 1").drop("_n")


def claim_edges(valid: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges of claims that hold, with polarity and quote: one a claim, and a mention of each of its ends by its publication.

    All are inferred, by source openai:<model>, on record of the publication; the qualifier is the certainty, which the rubric
    reads. A mention has the quote of the first claim by triple that names it. existing (id): edges that are there already and aren't made again.
    """
    record, source = publication_id(F.col("doc_id")), F.concat(F.lit("openai:"), "model")
    confidence = F.coalesce(*[F.when(F.col("certainty") == c, F.lit(v)) for c, v in CERTAINTIES.items()])
    inferred = F.lit("inferred").alias("evidence_type")
    claims = valid.select(F.col("subject_id").alias("source_id"), "relation", F.col("object_id").alias("target_id"), source.alias("source"), record.alias("record_id"), confidence.alias("confidence"), inferred, F.col("certainty").alias("qualifier"), "polarity", "quote")
    ends = valid.select("doc_id", "model", "quote", F.struct("subject_id", "relation", "object_id").alias("triple"), F.explode(F.array("subject_id", "object_id")).alias("target_id"))
    first = ends.groupBy("doc_id", "model", "target_id").agg(F.min_by("quote", "triple").alias("quote"))
    mentions = first.select(record.alias("source_id"), F.lit("mentions").alias("relation"), "target_id", source.alias("source"), record.alias("record_id"), F.lit(MENTION_CONFIDENCE).alias("confidence"), inferred, F.lit(None).cast("string").alias("qualifier"), F.lit(None).cast("string").alias("polarity"), "quote")
    made = with_ids(claims.unionByName(mentions)).select(*EDGE, "polarity", "quote")
    return made if existing is None else made.join(existing.select("id"), "id", "left_anti")


def publications(valid: DataFrame, docs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Nodes (id, type, label, attributes) of the documents with a claim that holds; docs has title, and what else it has of
    year, journal and authors (an array) are attributes. existing (id): nodes that are there already and aren't made again."""
    made = docs.join(valid.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("id", publication_id(F.col("doc_id")))
    title = F.nullif(squeezed(F.coalesce("title", F.lit(""))), F.lit(""))
    given = {"title": title} | {c: F.col(c).cast("string") for c in ("year", "journal") if c in docs.columns} | ({"authors": F.array_join("authors", "; ")} if "authors" in docs.columns else {})
    known = F.map_filter(F.create_map(*[x for name, value in given.items() for x in (F.lit(name), value)]), lambda _, v: v != "")
    out = made.select("id", F.lit("publication").alias("type"), F.coalesce(title, F.col("id")).alias("label"), known.alias("attributes"))
    return out if existing is None else out.join(existing.select("id"), "id", "left_anti")


def vocabulary_hash(nodes: DataFrame) -> DataFrame:
    """One row (hash, n): a hash of the ids and labels of the vocabulary in any order.

    Rows are dealt by their own hash into 16 ** BUCKET_DIGITS buckets, sorted and hashed there; the hash of the buckets'
    hashes, in order, is of bounded length, so nothing that grows with the vocabulary is in one place.
    """
    row = F.sha2(F.to_json(F.array("id", "label")), 256)
    own = nodes.filter(F.col("type").isin(*CANDIDATE_TYPES)).select(row.alias("h")).distinct()
    buckets = own.groupBy(F.substring("h", 1, BUCKET_DIGITS).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"), F.count("*").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",")
    return buckets.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def claim_keys(docs: DataFrame, nodes: DataFrame, model: str) -> DataFrame:
    """(doc_id, key): the key of a document's extraction, hashed from model, prompt version, document and vocabulary."""
    return docs.select("doc_id").join(F.broadcast(vocabulary_hash(nodes))).select("doc_id", F.sha2(F.to_json(F.array(F.lit(model), F.lit(PROMPT_VERSION), F.col("doc_id").cast("string"), "hash")), 256).alias("key"))


def cached(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """The rows of a cache (key, ...) under the current keys (doc_id, key), with doc_id; the rest are of other prompts or vocabularies."""
    return keys.join(cache, "key")


def stage_report(judged: DataFrame) -> DataFrame:
    """Per model of checked() claims: documents, documents with a claim that holds, claims that hold, and claims by problem."""
    holds = F.col("problem").isNull()
    return judged.groupBy("model").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct(F.when(holds, F.col("doc_id"))).alias("n_records"), F.count_if(holds).alias("n_claims"), F.count_if(~holds).alias("n_dropped"), F.count_if(F.col("problem") == "repeated").alias("n_repeated"), F.count_if(F.col("problem") == "quote not found").alias("n_unquoted"))


def predicted(valid: DataFrame) -> DataFrame:
    """(publication, subject_id, relation, object_id) of claims that hold, distinct, to compare with gold ones."""
    return valid.select(publication_id(F.col("doc_id")).alias("publication"), "subject_id", "relation", "object_id").distinct()


def contradicted(edges: DataFrame) -> DataFrame:
    """Triples that claims both support and contradict: (triple, n_for, n_against), counted by publication."""
    by = edges.filter("polarity is not null").groupBy(*TRIPLE, "record_id").agg(F.max(F.col("polarity") == "contradicts").alias("against"))
    return by.groupBy(*TRIPLE).agg(F.count_if(~F.col("against")).alias("n_for"), F.count_if("against").alias("n_against")).filter("n_for > 0 and n_against > 0")
