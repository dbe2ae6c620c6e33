"""Communities against the best of all partitions, and what must hold of them on larger graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import communities

PAIRS = "a string, b string, w long"


def plain_modularity(pairs, label):
    m2 = 2 * sum(w for _, _, w in pairs)
    k, inside = {}, 0
    for a, b, w in pairs:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += 2 * w if label[a] == label[b] else 0
    tot = {}
    for node, d in k.items():
        tot[label[node]] = tot.get(label[node], 0) + d
    return inside / m2 - sum(t * t for t in tot.values()) / m2**2


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]
        yield [[nodes[0]], *rest]


def found_of(spark, pairs, parts=4):
    return {r["id"]: r["label"] for r in communities.communities(spark.createDataFrame(pairs, PAIRS).repartition(parts)).collect()}


GRAPHS = [
    [("a", "b", 5), ("b", "c", 5), ("a", "c", 5), ("c", "d", 1), ("d", "e", 5), ("e", "f", 5), ("d", "f", 5)],
    [("a", "b", 3), ("c", "d", 3), ("e", "f", 3), ("b", "c", 1), ("d", "e", 1), ("f", "a", 1)],
    [("h", x, 2) for x in "abcdefg"],
    [("a", "b", 9), ("b", "c", 1), ("c", "d", 9), ("d", "a", 1), ("e", "f", 4), ("f", "g", 4), ("g", "e", 4), ("g", "a", 1)],
]


@pytest.mark.parametrize("pairs", GRAPHS)
def test_best_of_all_partitions(spark, pairs):
    nodes = sorted({x for a, b, _ in pairs for x in (a, b)})
    best = max(plain_modularity(pairs, {x: i for i, g in enumerate(p) for x in g}) for p in partitions(nodes))
    label = found_of(spark, pairs)
    assert sorted(label) == nodes and plain_modularity(pairs, label) == pytest.approx(best)
    assert all(v == min(x for x in label if label[x] == v) for v in label.values())


def planted(r, groups=4, size=8):
    names = [f"n{i:02}" for i in range(groups * size)]
    return [(x, y, r.randint(5, 9) if i // size == j // size else 1) for i, x in enumerate(names) for j, y in enumerate(names) if i < j and r.random() < (0.7 if i // size == j // size else 0.08)]


def test_planted_groups_on_any_partitioning(spark):
    pairs = planted(random.Random(3))
    label = found_of(spark, pairs, 1)
    assert label == found_of(spark, [(b, a, w) for a, b, w in reversed(pairs)], 7)
    assert {frozenset(x for x in label if label[x] == v) for v in label.values()} == {frozenset(f"n{i:02}" for i in range(g, g + 8)) for g in range(0, 32, 8)}


def test_rounds_never_lose_and_no_move_is_left(spark):
    r = random.Random(4)
    pairs = [(f"n{i:02}", f"n{j:02}", r.randint(1, 9)) for i in range(24) for j in range(i + 1, 24) if r.random() < 0.4]
    df = spark.createDataFrame(pairs, PAIRS)
    ends = df.union(df.select("b", "a", "w"))
    total = 2 * sum(w for *_, w in pairs)
    labels = ends.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("comm"), "k")
    last = plain_modularity(pairs, {x: x for p in pairs for x in p[:2]})
    for _ in range(4):
        taken = {x["id"]: x["to"] for x in communities._taken(ends, communities.gains(ends, labels, total), total).collect()}
        labels = spark.createDataFrame([(x["id"], taken.get(x["id"], x["comm"]), x["k"]) for x in labels.collect()], "id string, comm string, k long")
        now = plain_modularity(pairs, {x["id"]: x["comm"] for x in labels.collect()})
        assert now > last if taken else now == last
        last = now
    label = found_of(spark, pairs)
    end = plain_modularity(pairs, label)
    for node in label:
        assert all(plain_modularity(pairs, label | {node: to}) <= end + 1e-12 for to in set(label.values()))
    told = communities.modularity(df, spark.createDataFrame(list(label.items()), "id string, label string")).head()
    assert told["n_communities"] == len(set(label.values())) and told["modularity"] == pytest.approx(end)


def test_no_pairs(spark):
    assert communities.communities(spark.createDataFrame([], PAIRS)).count() == 0


def test_communities_of_the_tables(spark, tmp_path):
    """No node of the catalogue's communities gains by a move, and the modularity is what SQL says, over the whole tables."""
    import os

    import duckdb

    from skein.plans import report_queries
    from skein.plans.star_sql import _G, PROFILES

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    _, _, pairs, found = report_queries.communities_of(spark, data)
    con = duckdb.connect()
    for t in ("nation", "part", "supplier", "region", "orders", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    likes = con.execute(f"{_G}, {PROFILES} SELECT a, b, CAST(round(score * 10000) AS BIGINT) FROM pairs WHERE score >= 0.1").fetchall()
    assert likes and sorted(likes) == sorted(map(tuple, report_queries.like_pairs(pairs).collect()))
    label = {x["id"]: x["cluster"] for x in found.collect()}
    assert sorted(label) == sorted(f"N:{i}" for i in range(25))
    end = plain_modularity(likes, label)
    linked = {x for a, b, _ in likes for x in (a, b)}
    assert all(plain_modularity(likes, label | {node: to}) <= end + 1e-12 for node in linked for to in set(label.values()))
    told = communities.modularity(report_queries.like_pairs(pairs), found.withColumnRenamed("cluster", "label")).head()
    assert told["modularity"] == pytest.approx(end)
