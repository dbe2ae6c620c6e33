"""Maps around several centers against a plain search; annotations kept and grouped by closure."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skein.operators import annotations, evidence_map as maps

NODE, EDGE = "id string, type string, label string", "id string, source_id string, relation string, target_id string, confidence double"


def plain_focus(nodes, edges, center, depth, types, least):
    """Level by level: distance and best confidence at the hop of discovery; hidden ones apart."""
    kinds, seen, hidden, front = {n[0]: n[1] for n in nodes}, {center: (0, 1.0)}, {}, [center]
    for hop in range(1, depth + 1):
        found = {}
        for here in front:
            for _, a, _, b, c in edges:
                if c >= least and here in (a, b):
                    other = b if a == here else a
                    if other not in seen:
                        if kinds[other] in types:
                            found[other] = max(found.get(other, 0), c)
                        else:
                            hidden.setdefault(other, hop)
        seen |= {k: (hop, c) for k, c in found.items()}
        front = list(found)
    return seen, hidden


def test_focus_equals_a_plain_search(spark):
    r = random.Random(2)
    kinds = ["disease", "gene", "phenotype", "study"]
    nodes = [(f"n{i:02}", r.choice(kinds), f"L{i % 7}") for i in range(40)]
    edges = [(f"e{i}", r.choice(nodes)[0], r.choice(["a", "b"]), r.choice(nodes)[0], round(r.random(), 2)) for i in range(90)]
    centers = [n[0] for n in nodes if n[1] == "disease"]
    n, e, c = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x,) for x in centers] * 2, "center string")
    for types, relations in ((None, None), (("gene", "study"), ("a",))):
        rows = maps.focus(n, e, c, 2, types, relations, 0.2).collect()
        shown = types or tuple(k for k in kinds if k != "phenotype")
        used = [x for x in edges if relations is None or x[2] in relations]
        for center in centers:
            seen, hidden = plain_focus(nodes, used, center, 2, shown, 0.2)
            own = [x for x in rows if x["center"] == center]
            assert {x["id"]: (x["distance"], x["best"]) for x in own if not x["hidden"]} == seen
            assert {x["id"]: x["distance"] for x in own if x["hidden"]} == hidden


def test_order_caps_and_what_is_left_out(spark):
    rows = [("c", "c", "disease", 0, 1.0, False), ("c", "d1", "disease", 2, 0.9, False), ("c", "g1", "gene", 1, 0.5, False), ("c", "g2", "gene", 1, 0.5, False), ("c", "g3", "gene", 1, 0.7, False), ("c", "s1", "study", 1, 0.9, False), ("c", "p1", "phenotype", 1, 0.9, True)]
    found = spark.createDataFrame(rows, "center string, id string, type string, distance int, best double, hidden boolean")
    nodes = spark.createDataFrame([(i, t, "b" if i == "g1" else "A") for _, i, t, *_ in rows], NODE)
    weights = spark.createDataFrame([("g1", 2.0)], "id string, ic double")
    placed = maps.ranked(found, nodes, weights, {"gene": 2}, most=3)
    assert {x["id"]: x["place"] for x in placed.collect()} == {"c": None, "g3": 1, "g1": 2, "s1": 3, "g2": None, "d1": None, "p1": None}
    assert {tuple(x) for x in maps.left_out(placed).collect()} == {("c", "gene", 1), ("c", "disease", 1), ("c", "phenotype", 1)}


def test_annotations_by_closure(spark):
    schema = "thing string, term string, closure array<string>, codes array<string>, publications array<string>"
    iea, exp = "ECO:0000501", "ECO:0000314"
    rows = [("g", "t1", ["t1", "w1", "w2"], [iea], ["p2", None, ""]), ("g", "w1", None, [iea], [f"p{i:02}" for i in range(12)]), ("g", "t2", ["w2"], [exp, iea], None), ("h", "t3", ["x"], [exp], ["p"]), ("h", "t4", ["w1"], None, [])]
    kept = annotations.matched(spark.createDataFrame(rows, schema), ["w1", "w2", "w2", "none"])
    assert {(x["thing"], x["term"]): x["matched"] for x in kept.collect()} == {("g", "t1"): ["w1", "w2"], ("g", "w1"): ["w1"], ("g", "t2"): ["w2"], ("h", "t4"): ["w1"]}
    found = {(x["thing"], x["target"]): tuple(x)[2:] for x in annotations.grouped(kept).collect()}
    assert found == {
        ("g", "w1"): (2, iea, "t1,w1", ",".join(f"p{i:02}" for i in range(8)), 0.7),
        ("g", "w2"): (2, f"{exp},{iea}", "t1,t2", "p2", 0.9),
        ("h", "w1"): (1, "", "t4", "", 0.7),
    }
    assert annotations.matched(spark.createDataFrame(rows, schema), []).count() == 0
    ancestors = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "id string, ancestor string")
    assert {x["term"]: x["closure"] for x in annotations.closures(ancestors).collect()} == {"a": ["a", "b"], "b": ["b"]}
    texts = spark.createDataFrame([("HP:0040281",), ("1/2",), (None,)], "c string")
    assert [x[0] for x in texts.select(annotations.frequency(F.col("c"))).collect()] == ["Very frequent (99-80%)", "1/2", None]
