"""What is shuffled or read again, by the plans."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import with_tokens
from skein.operators import actions, annotations, canonical, claims, evidence_map, gaps, graph, similarity, trust
from skein.operators.work import saved
from skein.plans import action_queries, claim_queries, claim_sql, gap_queries, star_queries
from skein.sources import star

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_joined_after_they_are_summed(spark):
    rows = [("u1", "p1", 3), ("u2", "p1", 3), ("u1", "p2", 5), ("u3", "p2", 5), ("u2", "p2", 5)]
    found = similarity.weighted_jaccard(spark.createDataFrame(rows, "thing string, feature string, weight long"))
    assert sorted((x["a"], x["b"], x["n_shared"], x["shared"], x["total"]) for x in found.collect()) == [("u1", "u2", 2, 8, 8), ("u1", "u3", 1, 5, 8), ("u2", "u3", 1, 5, 8)]
    assert "Join" not in _plan(found).split("Aggregate")[0]


def test_annotations_are_read_once_and_codes_listed_once(spark):
    rows = [("s1", "p1", ["T"], ["ECO:2", None, "ECO:1"], ["PMID:1"]), ("s1", "p2", ["T"], ["ECO:1"], ["PMID:1"]), ("s1", "p2", ["T"], None, None), ("s2", "p1", ["T"], [], []), ("s2", "p1", ["T"], ["ECO:0000501"], [])]
    kept = spark.createDataFrame(rows, "thing string, term string, matched array<string>, codes array<string>, publications array<string>")
    found = annotations.grouped(kept)
    assert sorted(tuple(x) for x in found.collect()) == [("s1", "T", 3, "ECO:1,ECO:2", "p1,p2", "PMID:1", 0.9), ("s2", "T", 2, "ECO:0000501", "p1", "", 0.7)]
    assert "RDD" not in _plan(found) and "LocalRelation" not in _plan(found)


@pytest.fixture
def repeated(spark, tmp_path):
    """The smallest tables with lines, orders and suppliers said again, in part otherwise or without a value."""
    again = {
        "lineitem": [("l_orderkey % 3 = 0", {"l_discount": 0.1 - F.col("l_discount")}), ("l_orderkey % 7 = 0", {"l_discount": F.lit(None).cast("double")})],
        "orders": [("o_orderkey % 5 = 0", {"o_orderstatus": F.lit("F"), "o_orderpriority": F.lit("1-URGENT")}), ("o_orderkey % 11 = 0", {"o_orderpriority": F.lit(None).cast("string")})],
        "supplier": [("s_suppkey % 2 = 0", {})],
    }
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        t = star.table(spark, SMALL, name)
        reduce(DataFrame.union, [t, *[t.filter(rows).withColumns(new) if new else t.filter(rows) for rows, new in again.get(name, [])]]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_edges_are_merged_by_the_keys_of_the_tables(spark, repeated):
    evidence = trust.with_ids(star.evidence(spark, repeated))
    wanted, found = (sorted(tuple(map(str, r)) for r in df.select(*trust.EDGE).collect()) for df in (trust.one_per_id(evidence), star_queries._edges(spark, repeated)))
    assert found == wanted and len(found) < evidence.count()
    # No row is shuffled by its id, and lines are shuffled once.
    lines = star_queries._edges(spark, repeated).filter("relation = 'has_phenotype'")._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in lines and not re.search(r"hashpartitioning\((id|source_id|c_nationkey|l_linenumber)", lines)


def test_only_ends_at_diseases_meet_the_other_end(spark):
    nodes = spark.createDataFrame([("d", "disease", "D"), ("s", "study", "S"), ("x", "phenotype", "X"), ("y", "phenotype", "Y")], "id string, type string, label string")
    rows = [("e1", "s", "studies_condition", "d", 0.9, "observed"), ("e2", "d", "has_phenotype", "x", 0.9, "inferred"), ("e3", "d", "has_phenotype", "y", None, "observed"), ("e4", "s", "studies_condition", "d", 0.1, "observed")]
    edges = spark.createDataFrame(rows, "id string, source_id string, relation string, target_id string, confidence double, evidence_type string")
    seeds, searches = spark.createDataFrame([("d", gaps.GAP)], "id string, kind string"), spark.createDataFrame([], "id string, searched array<string>, closest array<string>, not_searched array<string>")
    reported = gaps.report(nodes, edges, seeds, searches, projects_searched=True)
    found = gaps.leads(nodes, edges, reported)
    assert sorted((r["id"], r["edge_id"]) for r in found.collect()) == [("d", "e1"), ("d", "e4"), ("x", "e2"), ("y", "e3")]
    assert "LeftOuter" not in _plan(gaps.leads(nodes, edges, reported.select("id", "type", "result").localCheckpoint()))


def test_texts_are_shuffled_once_and_not_sorted(spark):
    raw = spark.createDataFrame([(1, "m", 0, "d", "claims", "g", "a  b", "supports", "low"), (2, "m", 0, "d", "claims", "g", "a b", "supports", "low"), (3, "m", 0, "d", "claims", "z", "a b", "supports", "low")], "doc_id long, model string, seq long, subject_id string, relation string, object_id string, quote string, polarity string, certainty string")
    docs = spark.createDataFrame([(1, "x a\n b"), (4, "a b")], "doc_id long, text string")
    nodes = spark.createDataFrame([("d", "disease", "D"), ("g", "gene", "G")], "id string, type string, label string")
    found = claims.checked(raw, docs, nodes)
    assert {r["doc_id"]: r["problem"] for r in found.collect()} == {1: None, 2: "quote not found", 3: "unknown id"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftSemi" not in plan


def test_canonical_edges_are_sorted_once_and_words_parted_once(spark):
    rows = [("a", "caused_by", "g", "s", "r", 0.5, "curated", None), ("b", "caused_by", "g", "s", "r", 0.9, "curated", "q"), ("a", "caused_by", "b", "s", "r", 0.9, "curated", "q")]
    evidence = spark.createDataFrame(rows, "source_id string, relation string, target_id string, source string, record_id string, confidence double, evidence_type string, qualifier string")
    found = canonical.merged_edges(evidence, spark.createDataFrame([("b", "a")], "id string, canonical_id string"))
    assert [(r["source_id"], r["target_id"], r["confidence"]) for r in found.collect()] == [("a", "g", 0.9)]
    assert "RepartitionByExpression" in _plan(found)
    words = with_tokens(spark.createDataFrame([("Type II form-v of type v",)], "label string"), F.col("label"), "w")
    assert words.head()["w"] == ["type", "2", "form", "v", "of", "type", "5"]
    assert _plan(words).count("split(") == 1


@pytest.fixture
def written(monkeypatch):
    """The optimized plans of the tables that the modules given write."""
    plans = []

    def watch(*modules):
        for m in modules:
            monkeypatch.setattr(m, "saved", lambda df: (plans.append(_plan(df)), saved(df))[1])
        return plans

    return watch


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_marked_lines_are_merged_without_a_shuffle(spark, repeated):
    evidence = trust.with_ids(star.evidence(spark, repeated))
    merged = trust.with_ids(star.evidence(spark, repeated, star_queries.marked_lines(spark, repeated), once=True)).select(*trust.EDGE)
    assert _rows(merged) == _rows(trust.one_per_id(evidence))
    assert "Exchange" not in merged.filter("relation = 'has_phenotype'")._jdf.queryExecution().executedPlan().toString()


def test_explained_edges_are_hashed_after_they_met_their_labels(spark):
    plan = _plan(star_queries.explanation_checks(spark, SMALL))
    assert plan.index("sha2") < plan.index("Join") and plan.count("sha2") == plan.split("Join")[0].count("sha2")


def test_focus_walks_evidence_as_it_is(spark, repeated, written):
    n, centers = star.nodes(spark, repeated), star.table(spark, repeated, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("center"))
    merged = evidence_map.focus(n, trust.one_per_id(trust.with_ids(star.evidence(spark, repeated))), centers, least=0.94)
    plans = written(evidence_map)
    assert _rows(evidence_map.focus(n, saved(star.evidence(spark, repeated)), centers, least=0.94)) == _rows(merged)
    assert "Aggregate" not in plans[0] and "Join" not in plans[0]
    plans.clear()
    action_queries.focus_left_out(spark, SMALL)
    assert not any("max_by" in p for p in plans)


def test_only_disputes_of_what_is_drawn_are_looked_for(spark, repeated, written):
    plans = written(star_queries)
    found = star_queries.map_pulled_in(spark, repeated)
    assert not any("sha2" in p for p in plans[:-1])
    n, e = star.nodes(spark, repeated), saved(star_queries._edges(spark, repeated))
    shown = saved(evidence_map.neighbourhood(n, e, "N:3").filter("shown").select("id"))
    drawn, disputes = graph.induced(shown, e).select(*trust.TRIPLE).distinct(), star.disputes(spark, repeated)
    records = disputes.join(drawn, list(trust.TRIPLE)).select(F.concat(F.lit("record:"), "record_id")).distinct()
    assert _rows(found.select("id")) == _rows(records) and found.filter("type = 'publication'").count() == found.count() > 0


def test_paths_are_found_without_ids(spark, repeated, written):
    plans = written(graph, star_queries)
    found = _rows(star_queries.path_hydration(spark, repeated))
    # Only edges between the nodes of the paths are hashed.
    assert [p.count("Join") > 1 for p in plans if "sha2" in p] and all("LeftSemi" in p for p in plans if "sha2" in p)
    n, e = star.nodes(spark, repeated), saved(star_queries._edges(spark, repeated))
    paths = graph.cheapest_paths(graph.routing(n, e), "N:0", "N:7", 3, 8)
    assert found == _rows(actions.hydrated(paths.select(F.array_join("path", ">").alias("path_id"), "edge_ids"), e, star.disputes(spark, repeated))) and len(found) == 3


def test_paths_of_no_cost_and_wider_limits(spark):
    rows = [("A", "B", 0), ("B", "C", 0), ("C", "H", 5), ("A", "D", 0), ("D", "H", 5), ("A", "E", 9), ("E", "F", 9), ("F", "H", 9), ("B", "D", 0), ("G", "H", 1)]
    table = spark.createDataFrame([(a, b, w, w, a + b) for a, b, w in rows], "lo string, hi string, cost long, w long, edge_id string")
    found = [("".join(r["path"]), r["w"]) for r in graph.cheapest_paths(table, "A", "H", 9, 8).collect()]
    assert found == [("ABCH", 5), ("ABDH", 5), ("ADBCH", 5), ("ADH", 5), ("AEFH", 27)]


def test_reported_edges_are_written_without_names(spark, repeated, written):
    plans = written(gap_queries)
    found = gap_queries.gap_report(spark, repeated)
    assert plans and not any("sha2" in p or "record_id" in p for p in plans)
    n, e = star.nodes(spark, repeated), saved(star_queries._edges(spark, repeated))
    assert _rows(found) == _rows(gap_queries._flat(gaps.report(n, e, *gap_queries.gap_tables(spark, repeated), projects_searched=True)))


def _shuffled(df):
    """The columns of each exchange of the plan, without their numbers."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.sub(r"#\d+L?", "", found).split(", ")) for found in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_names_of_sources_are_not_shuffled_with_edges(spark):
    edges = spark.createDataFrame([(str(i), "N:1", "has_phenotype", f"P:{i % 2}", "openai:m", f"PMID:{i}", 0.3, "inferred", "low") for i in range(5)], ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in trust.EDGE))
    disputes = spark.createDataFrame([("P:0", "r"), ("P:9", "r")], "target_id string, record_id string").select(F.lit("N:1").alias("source_id"), F.lit("has_phenotype").alias("relation"), "target_id", "record_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = trust.rescored(edges, disputes)
        shuffled = _shuffled(found)
        assert [(x["id"], x["n_sources"], x["n_disputes"], x["score"]) for x in found.orderBy("id").collect()] == [("0", 3, 1, 0.2), ("1", 2, 0, 0.3), ("2", 3, 1, 0.2), ("3", 2, 0, 0.3), ("4", 3, 1, 0.2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Once with what is said of an edge, once with the names of sources, never with both.
    assert sum("id" in columns for columns in shuffled) == 1 and len(shuffled) > 3
    assert not any("id" in columns and columns & {"sources", "backed", "n_sources"} for columns in shuffled)


@pytest.fixture
def twice(spark, tmp_path):
    """The smallest tables, some documents said again under the same number with another text."""
    docs = star.table(spark, SMALL, "documents")
    docs.union(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("Said\n\tagain:  "), "text"))).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "benchmark"):
        star.table(spark, SMALL, name).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_claims_meet_the_text_they_were_made_of(spark, twice):
    db = duckdb.connect()
    for path in sorted(Path(twice).iterdir()):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    # Which of two claims with the same number is the repeated one is open, so problems are counted.
    wanted = db.execute(f"SELECT doc_id, seq, count(*) FROM ({claim_sql.SQL['claim_problems']}) GROUP BY ALL").fetchall()
    made = claim_queries.claim_problems(spark, twice)
    assert _rows(made.groupBy("doc_id", "seq").count()) == sorted(tuple(map(str, r)) for r in wanted)
    assert not any(columns & {"text", "_text"} for columns in _shuffled(made))
    kept = claims.checked(claim_queries.raw_claims(spark, SMALL), None, star.nodes(spark, SMALL)).filter("problem is null").drop("problem")
    assert _rows(claims.holding(claim_queries.raw_claims(spark, SMALL), None, star.nodes(spark, SMALL))) == _rows(kept) and kept.count() > 100


def test_claims_look_for_disputes_of_what_they_name(spark, monkeypatch):
    asked, disputes = [], star.disputes
    monkeypatch.setattr(star, "disputes", lambda *a, targets: (asked.append(targets), disputes(*a, targets=targets))[1])
    made = claim_queries._made(spark, SMALL).select(*trust.EDGE)
    assert _rows(claim_queries.claims_rescored(spark, SMALL)) == _rows(trust.rescored(saved(made), disputes(spark, SMALL)))
    assert _rows(asked[0]) == _rows(made.select("target_id").distinct())
    some = spark.createDataFrame([("P:3",), ("P:17",), ("N:1",)], "target_id string")
    found = _rows(disputes(spark, SMALL, targets=some))
    assert found == _rows(disputes(spark, SMALL).filter("target_id in ('P:3', 'P:17')")) and len(found) > 2
