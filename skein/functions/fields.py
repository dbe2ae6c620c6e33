"""Small functions of record fields: ids, lists in a text, labels, dates, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import literal_map, squeezed

#: Prefixes of cross-references as written here, by how sources write them.
XREF_PREFIXES = {"ORPHA": "Orphanet", "Orphanet": "Orphanet", "OMIM": "OMIM", "UMLS": "UMLS", "MESH": "MESH", "DOID": "DOID"}
CURIE = r"^[A-Za-z][A-Za-z0-9_.-]*:[^\s]+$"


def curie_prefix(id_: Column) -> Column:
    return F.substring_index(id_, ":", 1)


def xref(id_: Column) -> Column:
    """A cross-reference with its prefix as written here; null if it isn't one."""
    prefix = curie_prefix(id_)
    named = F.concat(F.coalesce(literal_map(XREF_PREFIXES)[prefix], prefix), F.lit(":"), F.substring(id_, F.length(prefix) + 2, F.length(id_)))
    return F.when(F.regexp_like(id_, F.lit(CURIE)), named)


def xrefs(ids: Column) -> Column:
    """Distinct cross-references in order, malformed ones dropped."""
    return F.array_distinct(F.array_compact(F.transform(ids, xref)))


def synonyms(label: Column, values: Column) -> Column:
    """Distinct squeezed values in order, without blanks and what equals the label but for case."""
    clean = F.transform(values, squeezed)
    return F.array_distinct(F.filter(clean, lambda v: (v != "") & (F.lower(v) != F.lower(label))))


def listed(text: Column) -> Column:
    """Parts of a comma-separated text, trimmed, blanks dropped; none for null."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def clean_ids(ids: Column, most: int = 12) -> Column:
    """Trimmed distinct ids in order; null if one is blank or over 64 characters or there are none or over `most`."""
    trimmed = F.array_distinct(F.transform(ids, lambda i: F.trim(i)))
    bad = F.exists(trimmed, lambda i: (i == "") | (F.length(i) > 64)) | (F.size(trimmed) < 1) | (F.size(trimmed) > most)
    return F.when(~bad, trimmed)


def without_blanks(attributes: Column) -> Column:
    """A map without entries that are null or blank, by key."""
    kept = F.map_filter(attributes, lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def merged_maps(first: Column, second: Column) -> Column:
    """Entries of both maps by key; first has precedence."""
    extra = F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(first), F.map_entries(extra))))


def asset_id(record: Column, kind: Column, name: Column) -> Column:
    """Node id of a curated record: a registered study, a publication, or an asset of its own."""
    study = F.regexp_like(record, F.lit(r"^NCT[0-9]{8}$"))
    return F.when(study, F.concat(F.lit("NCT:"), record)).when(F.startswith(record, F.lit("PMID:")) & (kind == "publication"), record).otherwise(F.concat(F.lit("asset:"), name))


def stub_label(label: Column, id_: Column) -> Column:
    """The squeezed label, or the id if there is none."""
    return F.coalesce(F.nullif(squeezed(label), F.lit("")), id_)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def spelt(code: Column) -> Column:
    """A code as words: underscores as blanks, the first letter upper-case."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, F.length(words))))


def instant(text: Column) -> Column:
    """A time in ISO form, Z as UTC."""
    return F.to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def client_key(forwarded: Column, peer: Column) -> Column:
    """First hop of a forwarding header, else the peer, else unknown."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), peer, F.lit("unknown"))


def tokens_used(used: Column, older: Column) -> Column:
    """A count of tokens under its present or its older name, 0 if there is neither."""
    return F.coalesce(used, older, F.lit(0))
