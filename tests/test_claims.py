"""Checks of claims one by one, and the edges, mentions and publications that the good ones give."""

from __future__ import annotations

import pytest

from skein.operators import claims

RAW = "doc_id string, model string, seq long, subject_id string, relation string, object_id string, quote string, polarity string, certainty string"
GOOD = ("d", "caused_by", "g", "it  is\n so", "supports", "high")


def claim(seq, doc="1", model="m", **other):
    names = ("subject_id", "relation", "object_id", "quote", "polarity", "certainty")
    return (doc, model, seq, *(dict(zip(names, GOOD, strict=True)) | other).values())


ROWS = [
    (claim(0), None), (claim(1), "repeated"), (claim(2, subject_id="x"), "unknown id"), (claim(3, object_id=None), "unknown id"), (claim(4, object_id="d"), "self"), (claim(5, relation="knows"), "relation"),
    (claim(6, polarity=None), "polarity"), (claim(7, certainty="sure"), "certainty"), (claim(8, quote=" \n"), "no quote"), (claim(9, quote=None), "no quote"), (claim(10, quote="it isn't"), "quote not found"),
    (claim(11, subject_id="p"), "unknown id"), (claim(0, doc="2"), "quote not found"), (claim(0, doc="3"), "quote not found"), (claim(0, doc="PMID:4", polarity="contradicts", certainty="low"), None),
    (claim(0, model="n"), None), (claim(12, object_id="m", relation="has_mechanism", quote="so it"), None),
]


@pytest.fixture
def tables(spark):
    raw = spark.createDataFrame([r for r, _ in ROWS], RAW)
    docs = spark.createDataFrame([("1", "Then it is \t so it is.", "A title", ["B", "C"]), ("2", None, None, None), ("PMID:4", "it is so", " ", []), ("5", "it is so", "None", [])], "doc_id string, text string, title string, authors array<string>")
    nodes = spark.createDataFrame([("d", "disease"), ("d", "disease"), ("g", "gene"), ("m", "mechanism"), ("p", "publication")], "id string, type string").selectExpr("id", "type", "id AS label")
    return raw, docs, nodes


def test_each_problem(tables):
    raw, docs, nodes = tables
    found = {(x["doc_id"], x["model"], x["seq"]): x["problem"] for x in claims.checked(raw, docs, nodes).collect()}
    assert found == {r[:3]: problem for r, problem in ROWS}
    assert claims.checked(raw.limit(0), docs, nodes).count() == 0 and claims.checked(raw, docs.limit(0), nodes).filter("problem is null").count() == 0


def test_edges_and_publications(tables):
    raw, docs, nodes = tables
    valid = claims.checked(raw, docs, nodes).filter("problem is null")
    made = claims.claim_edges(valid)
    found = {(x["source_id"], x["relation"], x["target_id"], x["source"], x["record_id"]): (x["confidence"], x["qualifier"], x["polarity"], x["quote"]) for x in made.collect()}
    one, four = ("openai:m", "PMID:1"), ("openai:m", "PMID:4")
    assert found[("d", "caused_by", "g", *one)] == (0.6, "high", "supports", "it is so") and found[("d", "caused_by", "g", *four)] == (0.3, "low", "contradicts", "it is so")
    assert found[("PMID:1", "mentions", "d", *one)] == (0.3, None, None, "it is so") and found[("PMID:1", "mentions", "m", *one)][3] == "so it"
    assert len(found) == made.count() == 4 + 3 + 2 + 2 and made.select("id").distinct().count() == len(found)
    there = made.filter("relation = 'mentions' and source = 'openai:m'")
    assert claims.claim_edges(valid, there).count() == len(found) - 5
    pubs = {x["id"]: (x["label"], x["attributes"]) for x in claims.publications(valid, docs).collect()}
    assert pubs == {"PMID:1": ("A title", {"title": "A title", "authors": "B; C"}), "PMID:4": ("PMID:4", {})}
    assert [tuple(x) for x in claims.contradicted(made).collect()] == [("d", "caused_by", "g", 1, 1)]
    assert [tuple(x) for x in claims.stage_report(claims.checked(raw, docs, nodes)).orderBy("model").collect()] == [("m", 4, 2, 3, 13, 1, 3), ("n", 1, 1, 1, 0, 0, 0)]


def test_keys_depend_on_the_vocabulary_not_on_its_order(tables):
    _, docs, nodes = tables
    key = lambda n: {x["doc_id"]: x["key"] for x in claims.claim_keys(docs, n, "m").collect()}
    assert key(nodes) == key(nodes.orderBy("type").repartition(3)) == key(nodes.filter("type <> 'publication'"))
    assert not set(key(nodes).values()) & set(key(nodes.filter("id <> 'm'")).values())
    cache = docs.sparkSession.createDataFrame([(key(nodes)["1"], "kept"), ("other", "stale")], "key string, summary string")
    assert [(x["doc_id"], x["summary"]) for x in claims.cached(claims.claim_keys(docs, nodes, "m"), cache).collect()] == [("1", "kept")]
