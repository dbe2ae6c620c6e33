"""Reports of gaps on a graph that has each of their cases."""

from __future__ import annotations

import pytest

from skein.operators import gaps

EDGE = "id string, source_id string, relation string, target_id string, source string, confidence double, evidence_type string"
NODES = [("d1", "disease", "One"), ("d2", "disease", "Two"), ("d3", "disease", "Three"), ("d4", "disease", "Four"), ("g1", "gene", "G1"), ("g2", "gene", "G2"), ("s", "study", "S"), ("f", "funder", "F"), ("i", "investigator", "I"), ("p", "publication", "P"), ("x", "phenotype", "X")]
EDGES = [
    ("e1", "s", "studies_condition", "d1", "ct", 0.75, "observed"), ("e2", "f", "represents", "d1", "curated", 0.6, "curated"), ("e3", "i", "investigates", "d1", "reporter", 0.75, "observed"), ("e4", "d1", "caused_by", "g1", "kb", 0.9, "curated"),
    ("e5", "s", "studies_condition", "d2", "ct", 0.3, "observed"), ("e6", "p", "mentions", "d2", "openai:m", 0.3, "inferred"), ("e7", "d2", "caused_by", "g2", "kb", 0.9, "curated"), ("e8", "g1", "risk_factor_for", "d2", "kb", 0.9, "curated"),
    ("e9", "f", "funds", "d4", "curated", 0.8, "curated"), ("e10", "d4", "similar_phenotype_to", "d4", "x", 0.9, "inferred"), ("e11", "p", "mentions", "p", "x", 0.2, "curated"),
]


@pytest.fixture
def graph(spark):
    nodes, edges = spark.createDataFrame(NODES, "id string, type string, label string"), spark.createDataFrame(EDGES, EDGE)
    seeds = spark.createDataFrame([("d2", gaps.UNSTUDIED), ("g2", gaps.UNTERMED), ("d4", gaps.GAP), ("none", gaps.GAP)], "id string, kind string")
    searches = spark.createDataFrame([("d3", ["a", "b"], ["c"], [gaps.NOT_SEARCHED[1], "z"])], "id string, searched array<string>, closest array<string>, not_searched array<string>")
    return nodes, edges, seeds, searches


def test_results_and_sentences(graph):
    found = {r.id: r for r in gaps.report(*graph, projects_searched=True).collect()}
    assert {k: r.result for k, r in found.items()} == {
        "d1": "supported", "d2": "weak_routes_only", "d3": "no_supported_route", "d4": "weak_routes_only", "g1": "supported", "g2": "supported",
        "s": "supported", "f": "supported", "i": "supported", "p": "weak_routes_only", "x": "no_supported_route",
    }
    assert (found["d1"].missing, found["d1"].questions, found["d1"].status) == ([], [], "supported")
    assert found["d2"].missing == [gaps.NO_STUDY % "Two", gaps.NO_PARTNER % "Two", gaps.NO_PROJECT % "Two"]
    assert found["d2"].questions == [gaps.ASK_STUDY % ("G1, G2", "Two"), gaps.ASK_PARTNER % "Two"]
    assert found["d3"].missing == [gaps.NO_STUDY % "Three", "No patient organisation or funder is linked to Three (searched: a, b)", gaps.NO_PROJECT % "Three", gaps.NO_GENE % "Three"]
    assert found["d3"].questions == ["Is there a registry or family network for Three? Closest communities: c.", gaps.ASK_GENE % "Three"]
    assert found["d3"].not_searched == [*gaps.NOT_SEARCHED, "z"] and found["d1"].not_searched == list(gaps.NOT_SEARCHED)
    assert found["g2"].missing == [gaps.NO_TERM % "G2"] and found["x"].missing == [gaps.UNMAPPED % "X"]
    assert {k: (r.n_edges, r.n_leads) for k, r in found.items() if k in ("d2", "d4", "p", "x")} == {"d2": (4, 2), "d4": (2, 1), "p": (2, 2), "x": (0, 0)}
    assert not any(gaps.NO_PROJECT % "Two" in r.missing for r in gaps.report(*graph, projects_searched=False).collect())


def test_leads_are_what_the_report_counts(graph):
    reported = gaps.report(*graph, projects_searched=True)
    found = sorted(tuple(r) for r in gaps.leads(*graph[:2], reported).collect())
    assert found == [("d2", "e5", 0.3, gaps.LOW_LEAD), ("d2", "e6", 0.3, gaps.PUBLICATION_LEAD), ("d4", "e9", 0.8, gaps.LOW_LEAD), ("p", "e11", 0.2, gaps.LOW_LEAD), ("p", "e6", 0.3, gaps.LOW_LEAD)]


def test_sources_and_answers_instead(graph):
    nodes, edges = graph[:2]
    found = {(r.id, r.source): (r.version, r.n) for r in gaps.sources(nodes, edges, {"kb": "3", "omim": None}).collect()}
    assert found["d1", "kb"] == ("3", 1) and found["x", "omim"] == (None, 0) and found["d2", "ct"] == (None, 1) and ("x", "ct") not in found
    pairs = nodes.sparkSession.createDataFrame([("i", "d1"), ("i", "d2"), ("x", "g1"), ("x", "nowhere")], "from_id string, to_id string")
    told = gaps.instead(pairs, pairs.filter("to_id = 'd1'"), gaps.report(*graph, projects_searched=True))
    assert {(r.from_id, r.to_id): (r.id, r.result) for r in told.collect()} == {("i", "d2"): ("d2", "weak_routes_only"), ("x", "g1"): ("x", "no_supported_route"), ("x", "nowhere"): ("nowhere", None)}


def test_empty_tables(graph):
    empty = [df.limit(0) for df in graph]
    assert gaps.report(*empty, projects_searched=True).count() == 0
    assert {r.result for r in gaps.report(graph[0], *empty[1:], projects_searched=True).collect()} == {"no_supported_route"}
