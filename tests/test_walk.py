"""The typed walk against a plain breadth-first search, and what it leads to on a graph made by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import trust, walk

EDGE = "id string, source_id string, relation string, target_id string, confidence double"
NODE = "id string, type string, label string"


def plain_walk(nodes, edges, start, depth, studies):
    """First path to each node, with a queue."""
    kinds, reached, queue = {n[0]: n[1] for n in nodes}, {start: ()}, [start]
    while queue:
        here = queue.pop(0)
        if len(reached[here]) >= depth or (here != start and kinds[here] in walk.LEAF_TYPES):
            continue
        for e in sorted((e for e in edges if here in (e[1], e[3])), key=lambda e: (e[1], e[2], e[3], e[0])):
            other = e[3] if e[1] == here else e[1]
            study = studies and here == start and e[2] == "studies_condition" and kinds[other] == "study"
            if other not in reached and (study or (e[2] in walk.BRIDGES and kinds[other] in walk.BRIDGE_TYPES)):
                reached[other] = (*reached[here], e[0])
                queue.append(other)
    return reached


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_equals_a_plain_search(spark, seed):
    r = random.Random(seed)
    nodes = [(f"{t[0]}{i}", t, f"{t} {i}") for t, n in (("disease", 6), ("gene", 5), ("mechanism", 3), ("study", 4), ("patient_group", 2)) for i in range(n)]
    relations = [*walk.BRIDGES, "studies_condition", "has_phenotype"]
    edges = [(f"E{i:02}", r.choice(nodes)[0], r.choice(relations), r.choice(nodes)[0], r.random()) for i in range(50)]
    starts = [n[0] for n in nodes if n[1] == "disease"]
    n, e, s = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in starts] * 2, "start_id string")
    for depth, studies in ((4, False), (2, True)):
        found = {(x["start_id"], x["id"]): tuple(h["id"] for h in x["path"]) for x in walk.walk(n, e, s, depth, studies).collect()}
        assert found == {(a, b): path for a in starts for b, path in plain_walk(nodes, edges, a, depth, studies).items()}


NODES = [("d1", "disease", "One"), ("d2", "disease", "Two"), ("d3", "disease", "Three"), ("d4", "disease", "Four"), ("g1", "gene", "GA"), ("g2", "gene", "GB"), ("m1", "mechanism", "Mech")]
NODES += [("s1", "study", "Trial one"), ("s2", "study", "Trial two"), ("s3", "study", "Trial three"), ("p1", "patient_group", "Group"), ("f1", "funder", "Fund"), ("a1", "asset", "Tool")]
EDGES = [("e1", "d1", "caused_by", "g1", 0.9), ("e2", "d2", "caused_by", "g1", 0.8), ("e3", "g1", "participates_in", "m1", 0.8), ("e4", "g2", "participates_in", "m1", 0.7), ("e5", "d3", "caused_by", "g2", 0.9)]
EDGES += [("e6", "s1", "studies_condition", "d2", 0.75), ("e7", "s2", "studies_condition", "d1", 0.7), ("e8", "s3", "studies_condition", "d3", 0.6), ("e9", "p1", "represents", "d2", 0.5), ("e10", "f1", "funds", "s2", 0.6), ("e11", "f1", "funds", "m1", 0.9), ("e12", "d1", "mentions", "a1", 0.4)]
KNOWN = [
    ("s1", {"status": "TERMINATED", "why_stopped": "no funds", "phase": "2", "enrollment": "40", "conditions": "Twoness"}),
    ("s2", {"curated_dose": "5 mg", "curated_notes": "Long. Reusable: the dose table. More.", "asset_slug": "x"}),
    ("s3", {"status": "RECRUITING", "enrollment": "7", "study_type": "OBSERVATIONAL", "interventions": "Drug"}),
    ("a1", {"description": "A tool. For all."}),
]


@pytest.fixture
def graph(spark):
    known = spark.createDataFrame(KNOWN, "id string, attributes map<string,string>")
    return spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, EDGE), spark.createDataFrame([("d1",), ("d4",)], "start_id string"), known


def test_partners(graph):
    n, e, s, _ = graph
    found = [tuple(x) for x in walk.partners(n, e, s).orderBy("start_id", "rank").select("start_id", "rank", "partner", "n_edges", "least", "edge_ids", "why").collect()]
    assert found == [("d1", 1, "f1", 2, 0.6, "e7,e10", "Funds Trial two, a study of One"), ("d1", 2, "p1", 3, 0.5, "e1,e2,e9", "Represents Two, linked to One through GA")]


def test_assets_and_next_step(graph):
    n, e, s, known = graph
    told = walk.described(walk.assets(n, e, s, known), n, e, known)
    rows = {x["asset"]: x for x in told.collect()}
    assert [(a, rows[a]["tier"], rows[a]["rank"], rows[a]["edge_ids"]) for a in sorted(rows)] == [("a1", 0, 2, "e12"), ("s1", 1, 3, "e1,e2,e6"), ("s2", 0, 1, "e7"), ("s3", 2, 4, "e1,e3,e4,e5,e8")]
    assert rows["s2"]["reusable"] == "Reusable: the dose table." and rows["a1"]["reusable"] == "A tool."
    assert rows["s1"]["reusable"] == "Clinical study, phase 2, terminated, 40 participants. Protocol, safety data and outcome measures may transfer."
    assert rows["s3"]["reusable"].startswith("Observational study, recruiting, 7 participants; interventions: Drug. ")
    assert rows["s2"]["differs"] == "Already linked to One; check scope and eligibility before reuse. This asset: dose 5 mg."
    assert rows["s1"]["differs"] == (
        "Studies Twoness, not One (shared gene: GA); eligibility, dosing and endpoints would need re-checking for One."
        " For One the closest clinical evidence is Trial two (dose 5 mg). Status terminated: no funds."
    )
    assert "Studies Three, not One (shared pathway only: GA, Mech, GB)" in rows["s3"]["differs"]
    steps = {x["start_id"]: x for x in walk.next_steps(told, n, e, s).collect()}
    assert steps.keys() == {"d1"} and steps["d1"]["edge_ids"] == "e1,e3,e4,e5,e8" and "population of Trial three" in steps["d1"]["text"]
    none = walk.next_steps(told.filter("tier = 0"), n, e, s).collect()
    assert [(x["start_id"], x["edge_ids"]) for x in none] == [("d1", "e1")] and "assay of GA variants" in none[0]["text"]


def test_bundle_of_a_start_without_anything(graph, spark):
    n, e, s, known = graph
    gaps = spark.createDataFrame([("d1", "studies"), ("d4", "causes,studies")], "start_id string, missing string")
    rows = {x["start_id"]: x for x in walk.bundle(n, e, s, known, gaps).collect()}
    assert (rows["d4"]["n_partners"], rows["d4"]["n_assets"], rows["d4"]["next_step"], rows["d4"]["missing"]) == (0, 0, None, "causes,studies")
    assert (rows["d1"]["n_partners"], rows["d1"]["first_partner"], rows["d1"]["n_assets"], rows["d1"]["first_asset"], rows["d1"]["missing"]) == (2, "f1", 4, "s2", None)


def test_a_filter_on_the_relation_passes_the_merge_of_edges(spark):
    rows = spark.createDataFrame([("a", r, "b", "s", "x", 0.5, "curated", None) for r in ("funds", "represents")], "source_id string, relation string, target_id string, source string, record_id string, confidence double, evidence_type string, qualifier string")
    plan = trust.one_per_id(trust.with_ids(rows)).filter(F.col("relation") == "funds")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")


@pytest.mark.parametrize("seed", [1, 2])
def test_assets_are_first_links_whatever_is_left_out_before_the_starts(spark, seed):
    r = random.Random(seed)
    diseases, genes, studies = [f"d{i}" for i in range(6)], ["g0", "g1", "g2"], [f"s{i:02}" for i in range(60)]
    nodes = [(x, "disease", x) for x in diseases] + [(x, "gene", x) for x in genes] + [(x, "study", x) for x in studies]
    edges = [(f"C{i:02}", r.choice(diseases), "caused_by", r.choice(genes), 0.8) for i in range(7)]
    # Most studies have one disease, some two or more, some several edges to one.
    edges += [(f"S{i:03}", r.choice(studies), "studies_condition", r.choice(diseases), r.choice([0.5, 0.6, 0.7])) for i in range(110)]
    known = spark.createDataFrame([(x, {"asset_slug": x} if r.random() < 0.3 else {"phase": "1"}) for x in studies], "id string, attributes map<string,string>")
    n, e, s = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in diseases], "start_id string")
    curated = {x["id"] for x in known.collect() if "asset_slug" in x["attributes"]}
    for by_tier in (False, True):
        expected = set()
        for start in diseases:
            best = {}
            for near, path in plain_walk(nodes, edges, start, walk.RELATED_EDGES, False).items():
                for x in edges:
                    if x[2] == "studies_condition" and x[3] == near:
                        row = (1 if path else 0, x[1] not in curated, -x[4], len(path) + 1, x[1], (*path, x[0]))
                        best[x[1]] = min(best.get(x[1], row), row)
            ranked = sorted(best.values())
            for tier in (0, 1) if by_tier else (None,):
                expected |= {(start, x[4], x[0], i, x[5]) for i, x in enumerate([x for x in ranked if tier in (None, x[0])][:3], 1)}
        found = walk.assets(n, e, s, known, most=3, by_tier=by_tier).collect()
        assert {(x["start_id"], x["asset"], x["tier"], x["rank"], tuple(h["id"] for h in x["path"])) for x in found} == expected


def test_few_links_of_a_disease_meet_the_starts(spark):
    hop = "struct<source_id:string,relation:string,target_id:string,id:string,confidence:double>"
    rows = [("d1", f"s{i:03}", True, (f"s{i:03}", "studies_condition", "d1", f"E{i}", 0.5)) for i in range(500)]
    rows += [(d, "many", True, ("many", "studies_condition", d, f"M{d}", 0.1)) for d in ("d1", "d2", "d3")]
    found = walk.first_links(spark.createDataFrame(rows, f"id string, asset string, loose boolean, hop {hop}"), 4).collect()
    assert sorted((x["id"], x["asset"]) for x in found) == [("d1", "many"), *(("d1", f"s{i:03}") for i in range(4)), ("d2", "many"), ("d3", "many")]
