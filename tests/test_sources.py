from __future__ import annotations

import json

from skein.operators import resolve, snapshot
from skein.operators.graph import closure, information_content
from skein.sources import records

OBO = """format-version: 1.2

[Term]
id: T:1
name: all

[Term]
id: T:2
name: left ! side
alt_id: T:20
is_a: T:1 ! all

[Term]
id: T:3
name: leaf
is_a: T:20 ! left
is_a: T:1 ! all

[Term]
id: T:4
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""
HEAD = "database_id\tdisease_name\tqualifier\thpo_id\treference\tevidence\tonset\tfrequency\tsex\tmodifier\taspect\tbiocuration"


def row(thing, term, qualifier="", aspect="P"):
    return "\t".join([thing, "x", qualifier, term, "", "", "", "", "", "", aspect, ""])


def test_ontology_and_information_content(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    terms = records.ontology(spark, str(tmp_path / "o.obo"))
    assert {r["id"]: (r["parents"], r["alt_ids"]) for r in terms.collect()} == {"T:1": ([], []), "T:2": (["T:1"], ["T:20"]), "T:3": (["T:20", "T:1"], [])}
    up = records.term_parents(terms)
    assert {tuple(r) for r in up.collect()} == {("T:2", "T:1"), ("T:3", "T:2"), ("T:3", "T:1")}
    (tmp_path / "a.tsv").write_text("\n".join(["#comment", HEAD, row("D:1", "T:3"), row("D:2", "T:20"), row("D:3", "T:1"), row("D:3", "T:3", "NOT"), row("D:3", "T:3", aspect="I")]))
    notes = records.annotations(spark, str(tmp_path / "a.tsv"), terms)
    assert {tuple(r) for r in notes.collect()} == {("D:1", "T:3"), ("D:2", "T:2"), ("D:3", "T:1")}
    ic = {r["term"]: (r["n"], round(r["ic"], 4)) for r in information_content(notes, closure(up)).collect()}
    assert ic == {"T:1": (3, 0.0), "T:2": (2, 0.4055), "T:3": (1, 1.0986)}


def test_associations_are_upgraded(spark, tmp_path):
    rows = [dict(subject="G:1", predicate=p, object="D:1", primary_knowledge_source="infores:x", negated=n) for p, n in (("biolink:causes", False), ("biolink:gene_associated_with", False))]
    rows += [dict(subject="G:2", predicate=p, object="D:1", negated=n) for p, n in (("biolink:causes", True), ("biolink:gene_associated_with", None))]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    found = records.associations(records.json_records(spark, str(tmp_path / "a.json"), records.ASSOCIATION)).collect()
    assert sorted((r["source_id"], r["relation"], r["target_id"], r["source"]) for r in found) == [("D:1", "caused_by", "G:1", "x"), ("D:1", "caused_by", "G:1", "x"), ("G:2", "risk_factor_for", "D:1", "unknown")]


def test_abstracts(spark, tmp_path):
    one = "<PubmedArticle><MedlineCitation><PMID Version='1'>{}</PMID><Article><Journal><JournalIssue><PubDate>{}</PubDate></JournalIssue></Journal><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a b.</AbstractText><AbstractText>c.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "x.xml").write_text("<PubmedArticleSet>" + one.format(7, "<Year>2020</Year>") + one.format(8, "<MedlineDate>1999 Jan</MedlineDate>") + "</PubmedArticleSet>")
    found = {r["pmid"]: (r["abstract"], r["year"]) for r in records.abstracts(spark, str(tmp_path / "x.xml")).collect()}
    assert found == {"7": ("a b. c.", 2020), "8": ("a b. c.", 1999)}


def test_projects_and_studies(spark):
    projects = spark.createDataFrame([("P1", 1, 2020, "old", [(1, "A")]), ("P1", 2, 2021, "new", [(1, "A"), (None, "B")])], records.PROJECT)
    assert [tuple(r) for r in records.latest_projects(projects).collect()] == [(1, "A", "P1", "new", 2021)]
    study = spark.createDataFrame([("N1", "t")], "nct_id string, brief_title string")
    assert [tuple(r) for r in records.matched_studies({"b": study, "a": study}).collect()] == [("N1", "t", ["a", "b"])]


def test_snapshot_hash_ignores_order(spark, tmp_path):
    a = spark.createDataFrame([("1", "r"), ("2", "r")], "id string, relation string")
    assert snapshot.content_hash(a).first() == snapshot.content_hash(a.orderBy("id", ascending=False)).first() != snapshot.content_hash(a.limit(1)).first()
    snapshot.write(a, a, str(tmp_path / "s"))
    nodes, edges = snapshot.read(spark, str(tmp_path / "s"))
    assert nodes.count() == edges.count() == 2


def test_cascade(spark):
    nodes = spark.createDataFrame([("1", "Gaucher disease"), ("2", "Pick syndrome"), ("3", "Pick"), ("4", "blue heart failure")], "id string, label string")
    mentions = spark.createDataFrame([("Pick",), ("gaucher  DISEASE",), ("the Gaucher",), ("heart failure",), ("none",)], "mention string")
    found = {r["mention"]: (r["node_id"], r["stage"]) for r in resolve.cascade(mentions, nodes).collect()}
    assert found == {"Pick": ("3", "exact"), "gaucher  DISEASE": ("1", "plain"), "the Gaucher": ("1", "key"), "heart failure": (None, "ask"), "none": (None, "none")}
