"""Curated files of several documents, each rule that rejects an entry, and the nodes and edges of what is good."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skein.sources import curated

GOOD = {"id": "a", "name": " A  one ", "url": "https://x", "retrieved": "2024-05-01"}
PROOF = [{"url": "http://y", "quote": "so", "retrieved": "2024-01-01"}]
AGAINST = {"id": "a-1", "summary": "s", "curator": "c", "verification": "verified", "contradicts": {"source_id": "s", "target_id": "t"}, "evidence": PROOF}


def entries(spark, rows):
    return spark.createDataFrame([("f", section, i, json.dumps(e), None) for i, (section, e) in enumerate(rows)], curated.ENTRIES)


BAD = [
    ("assets", GOOD | {"url": ""}, "needs id, url and retrieved"), ("organizations", {"id": "o"}, "needs id, url and retrieved"), ("mechanisms", GOOD | {"url": "ftp://x"}, "url isn't http(s)"),
    ("assets", GOOD | {"retrieved": "May"}, "bad date"), ("assets", GOOD | {"name": " "}, "needs a name"), ("organizations", GOOD | {"funds": ["nothing"]}, "unknown asset"), ("mechanisms", GOOD, "not a term id"),
    ("mechanisms", GOOD | {"id": "GO:0000001"}, None), ("aliases", {"name": "n", "url": "u"}, "needs name, disease_id and url"), ("aliases", {"name": "n", "url": "u", "disease_id": "d"}, None),
    ("contradictions", AGAINST | {"id": "A b"}, "id isn't a slug"), ("contradictions", AGAINST, None), ("contradictions", AGAINST, "id isn't unique"), ("contradictions", AGAINST | {"id": "b", "verification": "maybe"}, "bad verification"),
    ("contradictions", AGAINST | {"id": "c", "contradicts": {"source_id": "s"}}, "needs both ends"), ("contradictions", AGAINST | {"id": "d", "summary": ""}, "needs summary and curator"), ("contradictions", AGAINST | {"id": "e", "evidence": []}, "needs evidence"),
    ("contradictions", AGAINST | {"id": "f", "evidence": [PROOF[0] | {"quote": None}]}, "bad evidence"), ("contradictions", AGAINST | {"id": "g", "bears_on": [{"edge_id": "E:1"}]}, "bad bears_on"),
    ("contradictions", AGAINST | {"id": "h", "bears_on": [{"source_id": "s", "relation": "knows", "target_id": "t"}]}, "bad bears_on"),
    ("contradictions", AGAINST | {"id": "i", "bears_on": [{"source_id": "s", "relation": "funds", "target_id": "t"}, {"edge_id": "E:0123456789abcdef"}]}, None), ("no_dedicated_org_found", {"disease_id": "d"}, None),
]


def test_rules(spark):
    got = {r.seq: r.problem for r in curated.checked(entries(spark, [b[:2] for b in BAD])).select("seq", "problem").collect()}
    assert [got[i] for i in range(len(BAD))] == [b[2] for b in BAD]
    picked = curated.selectors(curated.checked(entries(spark, [b[:2] for b in BAD])).filter("problem is null"))
    assert {tuple(r) for r in picked.collect()} == {("i", None, "s", "funds", "t"), ("i", "E:0123456789abcdef", None, None, None)}
    assert curated.checked(entries(spark, [("assets", GOOD)]).limit(0)).count() == 0


def test_nodes_and_edges(spark):
    rows = [
        ("assets", GOOD | {"source_record_id": "NCT00000001", "type": "trial", "disease_ids": ["d1", "d2"], "attributes": {"size": 5}}), ("assets", GOOD | {"id": "b", "source_record_id": "PMID:7", "type": "publication (review)", "disease_ids": ["d1"]}),
        ("assets", GOOD | {"id": "c", "source_record_id": "PMID:8", "type": "registry", "notes": "n\n m"}), ("organizations", GOOD | {"id": "o", "type": "research_charity", "verified": "home page read 2024", "disease_ids": ["d1"], "funds": ["a", "c"]}),
        ("organizations", GOOD | {"id": "p", "disease_ids": ["d2"], "operates": ["b"], "retrieved": "2025-02-03"}),
    ]
    good = curated.checked(entries(spark, rows)).filter("problem is null")
    nodes, edges = curated.graph(good)
    found = {r.id: (r.type, r.label, r.attributes) for r in nodes.collect()}
    assert {k: v[:2] for k, v in found.items()} == {"clinicaltrials:NCT00000001": ("study", "A one"), "PMID:7": ("publication", "A one"), "asset:c": ("asset", "A one"), "org:o": ("funder", "A one"), "org:p": ("patient_group", "A one")}
    assert found["clinicaltrials:NCT00000001"][2] == {"url": "https://x", "curated_retrieved": "2024-05-01", "asset_slug": "a", "asset_type": "trial", "curated_size": "5"}
    assert found["asset:c"][2]["curated_notes"] == "n m" and found["org:p"][2]["org_type"] == "unknown"
    assert {(r.source_id, r.relation, r.target_id, r.record_id, r.confidence, r.qualifier) for r in edges.collect()} == {
        ("clinicaltrials:NCT00000001", "studies_condition", "d1", "NCT00000001", 0.8, "cited"), ("clinicaltrials:NCT00000001", "studies_condition", "d2", "NCT00000001", 0.8, "cited"), ("PMID:7", "mentions", "d1", "PMID:7", 0.8, "cited"),
        ("org:o", "represents", "d1", "o", 0.6, "page_read"), ("org:p", "represents", "d2", "p", 0.5, "url_resolves"), ("org:o", "funds", "clinicaltrials:NCT00000001", "o|funds|a", 0.8, "cited"),
        ("org:o", "funds", "asset:c", "o|funds|c", 0.8, "cited"), ("org:p", "operates", "PMID:7", "p|operates|b", 0.8, "cited"),
    }
    assert tuple(curated.latest(good).first()) == (5, "2025-02-03T00:00:00Z")
    assert tuple(curated.latest(good.limit(0)).first()) == (0, "1970-01-01T00:00:00Z")


def test_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("assets:\n- id: a\n  name: A\n  url: https://x\n  retrieved: 2024-05-01\n---\naliases:\n- {name: é, disease_id: d, url: u}\n---\n- a list\n---\n")
    (tmp_path / "b.json").write_text(json.dumps({"assets": [GOOD], "note": "text"}))
    (tmp_path / "c.yaml").write_text("assets: [\n")
    (tmp_path / "d.yaml").write_text("")
    found = curated.read(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    rows = sorted((r.file, r.section or "", json.loads(r.entry)["name"] if r.entry else None, (r.problem or "").split(":")[0]) for r in found.collect())
    assert rows == [("a.yaml", "", None, "not a mapping"), ("a.yaml", "aliases", "é", ""), ("a.yaml", "assets", "A", ""), ("b.json", "assets", " A  one ", ""), ("c.yaml", "", None, "not readable")]
    judged = curated.checked(found)
    assert judged.filter("problem is null").count() == 3 and judged.filter("section = 'assets'").select("retrieved").distinct().count() == 1
