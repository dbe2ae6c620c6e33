"""Canonical nodes: duplicates by identifier, cross-reference or name become one, and edges are rewritten to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import content, with_tokens
from skein.operators.components import components
from skein.operators.trust import EDGE, TRIPLE, one_per_id, with_ids
from skein.operators.work import saved

#: Identifier prefixes by type, the most authoritative first.
AUTHORITY = {
    "disease": ("MONDO", "ORPHA", "OMIM", "DOID", "MESH"),
    "gene": ("HGNC", "NCBIGene", "ENSEMBL", "OMIM"),
    "phenotype": ("HP",),
    "mechanism": ("GO", "REACT"),
}
#: Synonyms and cross-references that a canonical node lists; all are counted, and all are in long form in texts().
LISTED = 50


def authority(kind: Column, id_: Column) -> Column:
    """Place of an id's prefix among those of its type, after all of them if it is none."""
    prefix, rank = F.substring_index(id_, ":", 1), F.lit(0)
    for name, prefixes in AUTHORITY.items():
        place = F.array_position(F.array(*map(F.lit, prefixes)), prefix)
        rank = F.when(kind == name, F.when(place > 0, place - 1).otherwise(len(prefixes))).otherwise(rank)
    return rank.cast("int")


def groups(nodes: DataFrame) -> DataFrame:
    """(id, head, rank) of nodes (id, type, label, xrefs): nodes of one type that share an id or cross-reference, whatever its
    case, or a match key, also through others, are one group; its head is the most authoritative, then the smallest id.

    Nodes link to the smallest one under a key, a row a node and key, never a pair of nodes. Keys are made once and written.
    """
    named = with_tokens(nodes.select("id", "type", "label", "xrefs"), F.col("label"), "w")
    ids = F.transform(F.concat(F.array("id"), F.coalesce("xrefs", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("i:"), F.upper(x)))
    named, name = named.withColumn("name", F.array_join(content(F.col("w")), " ")), F.col("name")
    keyed = named.select("id", "type", F.explode(F.concat(ids, F.when(name != "", F.array(F.concat(F.lit("l:"), name))).otherwise(F.array().cast("array<string>")))).alias("k"))
    keyed = saved(keyed)
    first = keyed.groupBy("type", "k").agg(F.min("id").alias("first"))
    links = keyed.join(first, ["type", "k"]).filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(links)
    ranked = nodes.select("id", authority(F.col("type"), F.col("id")).alias("rank")).join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    heads = ranked.groupBy("comp").agg(F.min_by("id", F.struct("rank", "id")).alias("head"))
    return saved(ranked.join(heads, "comp").select("id", "head", "rank"))


def texts(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, kind, place, text): the synonyms and cross-references of each canonical node, each once, in order: of the members by
    rank and id, a member's label or id before its synonyms or cross-references. The head's own label and id are none."""
    none = F.array().cast("array<string>")
    own = nodes.join(grouped, "id").join(nodes.select(F.col("id").alias("head"), F.col("label").alias("head_label")), "head")
    parts = [
        own.select("head", F.lit("synonym").alias("kind"), "rank", "id", F.col("head_label").alias("not"), F.posexplode(F.concat(F.array("label"), F.coalesce("synonyms", none))).alias("pos", "text")),
        own.select("head", F.lit("xref").alias("kind"), "rank", "id", F.col("head").alias("not"), F.posexplode(F.concat(F.array("id"), F.coalesce("xrefs", none))).alias("pos", "text")),
    ]
    once = parts[0].union(parts[1]).filter("text is not null and text <> not").groupBy("head", "kind", "text").agg(F.min(F.struct("rank", "id", "pos")).alias("at"))
    return once.select(F.col("head").alias("id"), "kind", F.row_number().over(Window.partitionBy("head", "kind").orderBy("at")).alias("place"), "text")


def canonical(nodes: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row a group: id, type, label, n_members, synonyms and xrefs (the first LISTED, and n_synonyms and n_xrefs of all) and
    attributes, of which a member's value wins over those of members after it."""
    listed = saved(texts(nodes, grouped))
    first = listed.filter(F.col("place") <= LISTED).groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("texts"))
    sides = first.join(listed.groupBy("id", "kind").agg(F.count("*").alias("n")), ["id", "kind"])
    wide = sides.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(name) for k, c, name in (("synonym", "texts", "synonyms"), ("synonym", "n", "n_synonyms"), ("xref", "texts", "xrefs"), ("xref", "n", "n_xrefs"))])
    values = nodes.join(grouped, "id").select("head", "rank", "id", F.explode("attributes").alias("key", "value"))
    kept = values.groupBy("head", "key").agg(F.min_by("value", F.struct("rank", "id")).alias("value"))
    known = kept.groupBy(F.col("head").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    sizes = grouped.groupBy(F.col("head").alias("id")).agg(F.count("*").alias("n_members"))
    out = nodes.select("id", "type", "label").join(sizes, "id").join(wide, "id", "left").join(known, "id", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    lists = [F.coalesce(c, none).alias(c) for c in ("synonyms", "xrefs")]
    return out.select("id", "type", "label", "n_members", lists[0], F.coalesce("n_synonyms", zero).alias("n_synonyms"), lists[1], F.coalesce("n_xrefs", zero).alias("n_xrefs"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))


def aliases(grouped: DataFrame) -> DataFrame:
    """(id, canonical_id) of all nodes that were merged away."""
    return grouped.filter("id <> head").select("id", F.col("head").alias("canonical_id"))


def rewritten(evidence: DataFrame, merged: DataFrame) -> DataFrame:
    """Evidence rows with both ends canonical, with new ids; merged is aliases(). Rows that would run from a node to itself are marked: is_loop."""
    out = evidence
    for end in ("source_id", "target_id"):
        out = out.join(merged.withColumnsRenamed({"id": end, "canonical_id": f"{end}_to"}), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
    return with_ids(out.select(*EDGE[1:])).withColumn("is_loop", F.col("source_id") == F.col("target_id"))


def merged_edges(evidence: DataFrame, merged: DataFrame) -> DataFrame:
    """The edges between canonical nodes: rewritten evidence without loops, the most confident row of each id.

    Rows of one id have one source and record, so few fall together: they are dealt by id and sorted once, not before that too.
    """
    return one_per_id(rewritten(evidence, merged).filter("not is_loop").drop("is_loop").repartition("id"))


def merge_report(nodes: DataFrame, grouped: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: nodes before and after, evidence rows, loops, edges after, rows that fell together, and ends without a node (none)."""
    # An edge is an id with its triple: which of its rows is the best isn't asked, so they are counted, not sorted.
    rows = saved(rewritten(evidence, aliases(grouped)).select("id", *TRIPLE, "is_loop"))
    kept = rows.filter("not is_loop").select("id", *TRIPLE)
    heads = grouped.select(F.col("head").alias("id")).distinct()
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(heads, "id", "left_anti")
    counts = [nodes.agg(F.count("*").alias("n_nodes")), heads.agg(F.count("*").alias("n_canonical")), rows.agg(F.count("*").alias("n_rows"), F.count_if("is_loop").alias("n_loops")), kept.distinct().agg(F.count("*").alias("n_edges")), ends.agg(F.count("*").alias("n_dangling"))]
    out = counts[0]
    for one in counts[1:]:
        out = out.join(F.broadcast(one))
    return out.select("n_nodes", "n_canonical", "n_rows", "n_loops", "n_edges", (F.col("n_rows") - F.col("n_loops") - F.col("n_edges")).alias("n_merged"), "n_dangling")
