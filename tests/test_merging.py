"""Canonical merging and the index of conditions on tables made by hand."""

from __future__ import annotations

import pytest

from skein.operators import canonical, conditions

NODE = "id string, type string, label string, synonyms array<string>, xrefs array<string>, attributes map<string,string>"
NODES = [
    ("OMIM:1", "disease", "Red fever", ["Rf"], ["UMLS:C1"], {"a": "omim", "b": "omim"}),
    ("MONDO:9", "disease", "Red Fever Disease", ["Fever, red", "Rf"], [], {"a": "mondo"}),
    ("X:5", "disease", "Other name", [None, "Red fever"], ["umls:c1", "mondo:9"], {"c": "x"}),
    ("MONDO:2", "disease", "Blue fever", [], [], {}),
    ("HGNC:1", "gene", "Red fever", [], ["UMLS:C1"], None),
    ("X:6", "disease", "--", [], None, {}),
    ("X:7", "disease", "--", None, None, {}),
]
EVIDENCE = "source_id string, relation string, target_id string, source string, record_id string, confidence double, evidence_type string, qualifier string"
ROWS = [
    ("OMIM:1", "caused_by", "HGNC:1", "s", "r", 0.5, "curated", None), ("X:5", "caused_by", "HGNC:1", "s", "r", 0.9, "curated", "q"), ("MONDO:9", "caused_by", "HGNC:1", "s", "other", 0.7, "curated", None),
    ("OMIM:1", "similar_phenotype_to", "X:5", "s", "r", 0.5, "inferred", None), ("MONDO:2", "caused_by", "HGNC:1", "s", "r", 0.5, "curated", None),
]


@pytest.fixture
def tables(spark):
    nodes = spark.createDataFrame(NODES, NODE)
    return nodes, canonical.groups(nodes), spark.createDataFrame(ROWS, EVIDENCE)


def test_groups_have_the_most_authoritative_head(tables):
    nodes, grouped, _ = tables
    assert {r["id"]: r["head"] for r in grouped.collect()} == {"OMIM:1": "MONDO:9", "MONDO:9": "MONDO:9", "X:5": "MONDO:9", "MONDO:2": "MONDO:2", "HGNC:1": "HGNC:1", "X:6": "X:6", "X:7": "X:7"}
    assert {tuple(r) for r in canonical.aliases(grouped).collect()} == {("OMIM:1", "MONDO:9"), ("X:5", "MONDO:9")}


def test_unions_keep_order_and_the_head_wins(tables):
    nodes, grouped, _ = tables
    found = {r["id"]: r for r in canonical.canonical(nodes, grouped).collect()}
    head = found["MONDO:9"]
    assert (head["label"], head["n_members"], head["attributes"]) == ("Red Fever Disease", 3, {"a": "mondo", "b": "omim", "c": "x"})
    assert head["synonyms"] == ["Fever, red", "Rf", "Red fever", "Other name"] and head["xrefs"] == ["OMIM:1", "UMLS:C1", "X:5", "umls:c1", "mondo:9"]
    assert (head["n_synonyms"], head["n_xrefs"]) == (4, 5) and len(found) == 5
    assert (found["X:7"]["synonyms"], found["X:7"]["xrefs"], found["X:7"]["attributes"]) == ([], [], {})


def test_edges_are_rewritten_and_counted(tables):
    nodes, grouped, evidence = tables
    edges = {(r["source_id"], r["target_id"], r["record_id"]): (r["confidence"], r["qualifier"]) for r in canonical.merged_edges(evidence, canonical.aliases(grouped)).collect()}
    assert edges == {("MONDO:9", "HGNC:1", "r"): (0.9, "q"), ("MONDO:9", "HGNC:1", "other"): (0.7, None), ("MONDO:2", "HGNC:1", "r"): (0.5, None)}
    assert tuple(canonical.merge_report(nodes, grouped, evidence).head()) == (7, 5, 5, 1, 3, 1, 0)
    lost = canonical.merge_report(nodes.filter("id <> 'HGNC:1'"), grouped.filter("id <> 'HGNC:1'"), evidence).head()
    assert lost["n_dangling"] == 1


def test_precedence_of_names(spark):
    nodes = spark.createDataFrame([("d1", "Gaucher's disease", ["GD type II", "glucosylceramidosis", ""]), ("d2", "GD type 2", ["Shared"]), ("d3", "Third", ["shared", "Third one"]), ("d4", "Third", [])], "id string, label string, synonyms array<string>")
    aliases = spark.createDataFrame([("third one", "d9"), ("Shared", "d8"), ("New name", "d7"), ("new-name", "d6")], "name string, node_id string")
    found = {r["name"]: (r["node_id"], r["kind"]) for r in conditions.name_index(nodes, aliases).collect()}
    assert found == {
        "gaucher disease": ("d1", "label"), "gd type 2": ("d2", "label"), "third": ("d3", "label"), "glucosylceramidosis": ("d1", "synonym"), "third one": ("d3", "synonym"), "shared": ("d8", "alias"), "new name": ("d6", "alias"),
    }
    assert [tuple(r) for r in conditions.ambiguous(nodes).collect()] == [("shared", 2)]


def test_studies_by_conditions(spark):
    index = spark.createDataFrame([("red fever", "d1", "label"), ("rf", "d1", "alias"), ("blue", "d2", "alias")], "name string, node_id string, kind string")
    studies = spark.createDataFrame([("s1", ["RF", "Red Fever", "Unknown"], ["wide"]), ("s2", ["Unknown"], ["seed"]), ("s3", ["Unknown", "none"], ["wide"]), ("s4", [], None), ("s5", None, ["seed"])], "study_id string, conditions array<string>, queries array<string>")
    found = conditions.mapped(studies, index)
    assert {tuple(r) for r in conditions.unmapped(found).collect()} == {("Unknown", 3), ("none", 1)}
    assert {r["study_id"] for r in conditions.kept_studies(studies, found).collect()} == {"s1", "s2", "s5"}
    edges = conditions.condition_edges(found, spark.createDataFrame([("s1", "OPEN")], "study_id string, status string")).collect()
    assert [(e["source_id"], e["target_id"], e["confidence"], e["qualifier"], e["condition"], e["status"]) for e in edges] == [("s1", "d1", 0.75, "label", "Red Fever", "OPEN")]
