"""Stages of resolution one by one, nearest nodes and shared words against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from skein.operators import resolver

NODE = "id string, label string, synonyms array<string>, xrefs array<string>"
NODES = [
    ("D:1", "Red fever", ["Fever rubra", None], ["OMIM:7"]), ("D:2", "Blue fever", ["Same name"], []), ("D:3", "Blue Fever", ["Same Name"], None), ("D:4", "Green long winter fever", None, ["omim:8"]), ("D:5", "--", [""], []),
]
MENTIONS = ["red FEVER", "omim:7", "rubra fever disease", "Fever rubra", "blue fever", "same name disease", "winter fever", "nothing here", "by vector", "near tie", "far", "", None, "D:4", "D:99"]


def test_stages(spark):
    mentions = spark.createDataFrame([(m,) for m in MENTIONS * 2], "mention string")
    nodes = spark.createDataFrame(NODES, NODE)
    queries = spark.createDataFrame([("by vector", [1.0, 0.0]), ("near tie", [1.0, 1.0]), ("far", [-1.0, -0.2]), ("red FEVER", [0.0, 1.0])], "mention string, embedding array<double>")
    vectors = spark.createDataFrame([("D:1", [1.0, 0.01]), ("D:1", [0.0, 1.0]), ("D:2", [0.1, 1.0]), ("D:4", None)], "id string, embedding array<double>")
    found = {r["mention"]: (r["node_id"], r["method"], r["score"], r["candidates"]) for r in resolver.resolve(mentions, nodes, queries, vectors).collect()}
    assert sorted(found) == sorted({m for m in MENTIONS if m is not None})
    assert found["red FEVER"] == ("D:1", "exact", 1.0, []) and found["omim:7"] == ("D:1", "xref", 1.0, []) and found["Fever rubra"] == ("D:1", "synonym", 0.95, []) and found["D:4"] == ("D:4", "xref", 1.0, [])
    assert found["blue fever"] == (None, "none", 0.0, ["D:2", "D:3"]) and found["same name disease"] == (None, "none", 0.0, ["D:2", "D:3"])
    assert found["by vector"] == ("D:1", "embedding", 1.0, []) and found["near tie"] == (None, "none", 0.0, ["D:2", "D:1"]) and found["far"] == (None, "none", 0.0, [])
    assert found["rubra fever disease"][3][0] == "D:1"
    assert found["winter fever"][3][0] == "D:4" and found["nothing here"] == found[""] == found["D:99"] == (None, "none", 0.0, [])


def test_decisions_answer_only_their_own_question(spark):
    mentions, nodes = spark.createDataFrame([("blue fever",), ("winter fever",)], "mention string"), spark.createDataFrame(NODES, NODE)
    asked = {r["mention"]: r["key"] for r in resolver.resolve(mentions, nodes).collect()}
    decisions = spark.createDataFrame([(asked["blue fever"], "D:3"), (asked["winter fever"], "D:1"), ("stale", "D:2")], "key string, node_id string")
    found = {r["mention"]: (r["node_id"], r["method"]) for r in resolver.resolve(mentions, nodes, decisions=decisions).collect()}
    assert found == {"blue fever": ("D:3", "llm"), "winter fever": (None, "none")}
    more = nodes.union(spark.createDataFrame([("D:9", "blue fever", [], [])], NODE))
    assert {r["mention"]: r["method"] for r in resolver.resolve(mentions, more, decisions=decisions).collect()}["blue fever"] == "none"


def test_nearest_nodes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolver, "BLOCK_BYTES", 8 * 4 * 3)
    r = random.Random(1)
    vectors = [(f"n{r.randint(0, 14):02}", [float(r.randint(-2, 2)) for _ in range(4)]) for _ in range(80)]
    queries = [(f"q{i}", [float(r.randint(-2, 2)) + 0.5 for _ in range(4)]) for i in range(10)]
    found = resolver.nearest_nodes(spark.createDataFrame(queries, "mention string, embedding array<double>"), spark.createDataFrame(vectors, "id string, embedding array<double>").repartition(5), 4).collect()
    for name, q in queries:
        best = {}
        for i, v in vectors:
            n = np.linalg.norm(v)
            s = np.floor(np.dot(q, v) / np.linalg.norm(q) / n * 10000 + 0.5) / 10000 if n else 0.0
            best[i] = max(best.get(i, -9), s)
        expected = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
        own = sorted(((x["id"], x["score"]) for x in found if x["mention"] == name), key=lambda x: (-x[1], x[0]))
        assert [s for _, s in own] == [s for _, s in expected] and own == expected


def test_shared_words_lose_nothing(spark):
    r = random.Random(2)
    words = [chr(97 + i) for i in range(12)]
    draw = lambda n: [words[min(int(r.expovariate(0.3)), 11)] for _ in range(n)]
    mentions = [(f"m{i}", draw(r.randint(0, 6))) for i in range(60)]
    texts = [(f"t{i % 50:02}", draw(r.randint(0, 7))) for i in range(90)]
    found = {(x["mention"], x["id"]): x["score"] for x in resolver.shared_words(spark.createDataFrame(mentions, "mention string, mw array<string>"), spark.createDataFrame(texts, "id string, w array<string>")).collect()}
    expected = {}
    for m, a in mentions:
        for t, b in texts:
            if a and b and (j := len(set(a) & set(b)) / len(set(a) | set(b))) >= resolver.LEXICAL_FLOOR:
                expected[m, t] = max(expected.get((m, t), 0), j)
    assert found == expected and expected


def test_keys_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("m", ["b", "a"], ["a", "b"])], "m string, x array<string>, y array<string>")
    one, two = df.select(resolver.question_key(F.col("m"), F.col("x")), resolver.question_key(F.col("m"), F.col("y"))).head()
    assert one == two
