from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions.numeric import cosine, round4
from skein.functions.text import clipped, content, first_sentence, folded, slug, token_jaccard, with_tokens
from skein.operators import graph, resolve, search, similarity, trust
from skein.operators.components import components
from skein.streaming.limiter import limited, limited_stream


def brute_components(links):
    parent = {x: x for ab in links for x in ab}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(i, 99) for i in range(20)], [(3, 1), (3, 2), (2, 2), (9, 8)], [tuple(random.Random(4).sample(range(60), 2)) for _ in range(40)]])
def test_components(spark, links):
    found = {r["id"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: v for k, v in brute_components(links).items() if any(k in x and x[0] != x[1] for x in links)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cheapest_paths_are_those_of_enumeration(spark):
    r = random.Random(3)
    names = list("ABCDEFGH")
    routes = {tuple(sorted(p)): r.randint(1, 9) * 100_000 for p in itertools.combinations(names, 2) if r.random() < 0.5}
    cost = lambda a, b: routes.get(tuple(sorted((a, b))))
    middles = [("A", *m, "H") for n in range(4) for m in itertools.permutations([x for x in names if x not in "AH"], n)]
    every = [(sum(cost(*e) for e in itertools.pairwise(p)), list(p)) for p in middles if all(cost(*e) for e in itertools.pairwise(p))]
    rows = [(*k, v - 50_000, v, "-".join(k)) for k, v in routes.items()]
    table = spark.createDataFrame(rows, "lo string, hi string, cost long, w long, edge_id string")
    found = graph.cheapest_paths(table, "A", "H", 3, 4).collect()
    assert [(x["w"], x["path"]) for x in found] == sorted(every)[:3]
    for x in found:
        assert x["edge_ids"] == ["-".join(sorted(e)) for e in itertools.pairwise(x["path"])]
        assert x["cost"] == round((x["w"] - 50_000 * x["n_edges"]) / 1e6, 4)
    assert graph.cheapest_paths(table, "A", "nowhere").count() == 0 and graph.cheapest_paths(table, "A", "A").count() == 0


def test_routing_penalises_phenotypes_by_type(spark):
    nodes = spark.createDataFrame([("x", "disease"), ("P:y", "gene"), ("z", "phenotype")], "id string, type string")
    edges = spark.createDataFrame([("e1", "x", "P:y", 1.0, "curated"), ("e2", "z", "x", 1.0, "inferred"), ("e3", "x", "z", 1.0, "curated"), ("e4", "x", "x", 1.0, "curated")], "id string, source_id string, target_id string, confidence double, evidence_type string")
    found = {(r["lo"], r["hi"]): (r["cost"], r["w"], r["edge_id"]) for r in graph.routing(nodes, edges).collect()}
    assert found == {("P:y", "x"): (0, 0, "e1"), ("x", "z"): (0, 750_000, "e3")}


def test_closure_and_reach(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")], "child string, parent string")
    assert {(x["id"], x["ancestor"]) for x in graph.closure(up).collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("d", "c")}
    edges = up.select(F.col("child").alias("source_id"), F.col("parent").alias("target_id"))
    near = {(x["id"], x["distance"]) for x in graph.reach(edges, spark.createDataFrame([("a",)], "start_id string"), 2).collect()}
    assert near == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}


RUBRIC = [
    # id, relation, source, record, confidence, evidence type, qualifier; the triple is the id's letter
    ("a1", "caused_by", "monarch", "r1", 0.1, "curated", "infores:omim", 0.95, "curated KB gene-disease (OMIM via Monarch) 0.90; +0.05 corroborated by 2 sources (omim, orphanet)"),
    ("a2", "caused_by", "monarch", "r2", 0.1, "curated", "infores:orphanet", 0.95, "curated KB gene-disease (Orphanet via Monarch) 0.90; +0.05 corroborated by 2 sources (omim, orphanet)"),
    ("b1", "has_phenotype", "monarch", "r3", 0.1, "curated", None, 0.6, "curated KB phenotype annotation (HPO) 0.90; -0.30 contradicted by 2 records"),
    ("c1", "participates_in", "go", "r4", 0.1, "curated", "ECO:0000501", 0.8, "curated GO annotation, electronic (IEA) only 0.80"),
    ("d1", "participates_in", "go", "r5", 0.1, "curated", "ECO:0000501,ECO:1", 0.85, "curated GO annotation, non-IEA evidence 0.85"),
    ("f1", "studies_condition", "clinicaltrials", "NCT1", 0.1, "observed", "alias", 0.65, "ClinicalTrials.gov record, condition matched by alias 0.65"),
    ("f2", "studies_condition", "curated", "NCT1", 0.1, "curated", "unverified", 0.5, "team-curated, key claim unverified [U] 0.50"),
    ("g1", "claims", "other", "r7", 0.97, "curated", None, 0.97, "no rubric row for other; ingest value"),
    ("h1", "claims", "other", "r8", 0.8, "inferred", None, 0.49, "computed analytics value 0.80; capped at 0.49: inferred stays below curated"),
    ("i1", "claims", "openai:x", "PMID:1", 0.1, "inferred", "high", 0.45, "OpenAI Extract claim, certainty high (hypothesis) 0.45"),
    ("j1", "contradicts", "curated", "PMID:2", 0.1, "curated", "page_read", 0.6, "org verified on its own site 0.60"),
]


def test_rubric(spark):
    rows = [(i, i[0], rel, i[0] + "'", *rest[:5]) for i, rel, *rest in RUBRIC]
    edges = spark.createDataFrame(rows, "id string, source_id string, relation string, target_id string, source string, record_id string, confidence double, evidence_type string, qualifier string")
    disputes = spark.createDataFrame([("b", "has_phenotype", "b'", "x"), ("b", "has_phenotype", "b'", "y"), ("j", "contradicts", "j'", "z")], "source_id string, relation string, target_id string, record_id string")
    found = {r["id"]: (r["score"], r["reasons"]) for r in trust.rescored(edges, disputes).collect()}
    assert found == {r[0]: (r[7], r[8]) for r in RUBRIC}


def test_round4_is_half_even_on_the_binary_value(spark):
    r = random.Random(1)
    values = [0.00005, 0.00015, 0.12345, 2.67545, 0.5, 1e-9, 0.0, 0.99995] + [r.randint(0, 99999) / 1e5 + 5e-5 for _ in range(300)] + [r.random() for _ in range(300)]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", round4(F.col("v")).alias("r")).collect()
    assert all(x["r"] == round(x["v"], 4) for x in found)


def test_normal_names(spark):
    names = {"Parkinson's disease, type II": "parkinsons disease type 2", "α-Synuclein/β": "alpha synuclein beta", "Gaucher Type I": "gaucher type 1", "vitamin D i": "vitamin d i", "": "", "Crème brûlée ﬁ": "crème brûlée fi"}
    df = with_tokens(spark.createDataFrame([(n,) for n in names], "n string"), F.col("n"), "w")
    assert {x["n"]: " ".join(x["w"]) for x in df.collect()} == names


def test_text_functions(spark):
    row = spark.createDataFrame([("  The  Straße of\tMany words here. And more", "A-B c!", "")], "t string, s string, e string").select(
        clipped(F.col("t"), 20).alias("clip"), slug(F.col("s")).alias("slug"), content(F.array(F.lit("the"), F.lit("of"))).alias("fill"), folded(F.lit("Straße Ⅳ")).alias("fold"),
        first_sentence(F.col("t")).alias("first"), token_jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), token_jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("z"),
        cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("cos"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
    ).first()
    assert (row["clip"], row["slug"], row["fill"], row["fold"]) == ("The Straße of Many...", "a-b-c", ["the", "of"], "strasse iv")
    assert row["first"].endswith("here.") and (row["j"], row["z"], row["cos"], row["zero"]) == (0.5, 0.0, 1.0, 0.0)


def test_rate_limit_ignores_rejected_events(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 10, 20, 30, 61, 62])]
    events = spark.createDataFrame(rows, "key long, event_id long, s int").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
    found = {r["event_id"]: r["allowed"] for r in limited(events, 2, 60.0).collect()}
    assert [found[i] for i in range(6)] == [True, True, False, False, True, False]


def brute_limit(rows, limit, window):
    kept, out = {}, {}
    for key, event, t in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        live = [x for x in kept.get(key, []) if t - x < window]
        out[event] = len(live) < limit
        kept[key] = [*live, t] if out[event] else live
    return out


def test_rate_limit_of_a_hot_key(spark):
    r = random.Random(2)
    rows = [(1 if r.random() < 0.6 else r.randint(2, 9), i, r.randint(0, 3000)) for i in range(1500)]
    events = spark.createDataFrame(rows, "key long, event_id long, s int").select("key", "event_id", F.timestamp_seconds("s").alias("ts")).repartition(5)
    assert {x["event_id"]: x["allowed"] for x in limited(events, 3, 60.0).collect()} == brute_limit(rows, 3, 60.0)
    assert limited(events.filter("false"), 3, 60.0).count() == 0


def test_rate_limit_of_a_stream_out_of_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randint(1, 3), i, r.randint(0, 900)) for i in range(120)]
    schema = "key long, event_id long, s int"
    for k, part in enumerate([rows[:60], rows[60:], [(99, 1000, 9000)], [(99, 1001, 9100)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select("key", "event_id", F.timestamp_seconds("s").alias("ts"))
        query = limited_stream(events, 2, 60.0, "20 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = {x["event_id"]: x["allowed"] for x in spark.read.parquet(f"{tmp_path}/out").collect() if x["key"] != 99}
    assert found == brute_limit(rows, 2, 60.0)


def test_shared_pairs_of_a_hot_feature(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HEAVY", 4)
    r = random.Random(5)
    rows = [(f"t{i:02}", f, 1) for i in range(30) for f in ("hot", *r.sample("abcdef", 2))]
    found = similarity.shared_pairs(spark.createDataFrame(rows, "thing string, feature string, weight int"), []).collect()
    has = {}
    for t, f, _ in rows:
        has.setdefault(f, []).append(t)
    assert sorted((x["feature"], x["a"], x["b"]) for x in found) == sorted((f, a, b) for f, ts in has.items() for a, b in itertools.combinations(sorted(ts), 2))


def test_ambiguous_mentions_ask(spark):
    nodes = spark.createDataFrame([("1", "Red Thing"), ("2", "red thing"), ("3", "Blue Form"), ("4", "the blue"), ("5", "green apple tree")], "id string, label string")
    mentions = spark.createDataFrame([("red  thing",), ("Red Thing",), ("blue",), ("an apple tree",), ("xyz",)], "mention string")
    decided = spark.createDataFrame([("blue", "4"), ("red  thing", "5")], "mention string, node_id string")
    found = {r["mention"]: (r["node_id"], r["stage"], r["candidates"]) for r in resolve.cascade(mentions, nodes, decided).collect()}
    assert found == {"red  thing": (None, "ask", "1,2"), "Red Thing": ("1", "exact", ""), "blue": ("4", "choice", "3,4"), "an apple tree": (None, "ask", "5"), "xyz": (None, "none", "")}


def test_nearest_in_blocks(spark):
    r = random.Random(7)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    every = search.nearest(v, v, 3, 1000).collect()
    parts = search.nearest(v, v, 3, 7).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, parts)) and len(every) == 61 * 3


def test_interleaved(spark):
    lists = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "list_no int, rank int, item string")
    assert [(x["item"], x["place"]) for x in search.interleaved(lists, 3).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3)]
