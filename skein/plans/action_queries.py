"""The catalogue, third part: the typed walk from all diseases, its partners, assets and hypotheses; maps around all; annotations by closure."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import annotations, coverage, evidence_map as maps, graph, walk
from skein.operators.work import saved
from skein.plans.star_queries import Query, _information, _parents, nodes_and_edges
from skein.sources import star
from skein.sources.star import table

_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


@cache
def queries() -> dict[str, Query]:
    return dict(_FOUND)


def _starts(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'disease'").select(F.col("id").alias("start_id"))


@query
def typed_walk(spark, d):
    n, e = nodes_and_edges(spark, d)
    found = walk.walk(n, e, _starts(n), walk.RELATED_EDGES)
    return found.select("start_id", "id", "type", F.size("path").alias("n_edges"), F.array_join(F.transform("path", lambda x: x["id"]), ",").alias("edge_ids"))


@query
def action_partners(spark, d):
    n, e = nodes_and_edges(spark, d)
    return walk.partners(n, e, _starts(n))


def _described(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the first ten assets of each tier, described."""
    n, e = nodes_and_edges(spark, d, whole=True)
    known = star.attributes(spark, d)
    return n, e, walk.described(walk.assets(n, e, _starts(n), known, most=10, by_tier=True), n, e, known)


@query
def reusable_assets(spark, d):
    return _described(spark, d)[2].select("start_id", "tier", "rank", "asset", "n_edges", "edge_ids", "reusable", "differs")


@query
def next_hypotheses(spark, d):
    n, e, told = _described(spark, d)
    return walk.next_steps(saved(told), n, e, _starts(n))


@query
def action_bundle(spark, d):
    n, e = nodes_and_edges(spark, d, whole=True)
    gaps = coverage.coverage(n, e, "disease", {"phenotypes": "has_phenotype", "causes": "caused_by", "studies": "investigates"})
    return walk.bundle(n, e, _starts(n), star.attributes(spark, d), gaps.select(F.col("id").alias("start_id"), "missing"))


def _focus(spark: SparkSession, d: str) -> DataFrame:
    """What is around each disease, placed; weights are the information content of brands and types."""
    # The best confidence of merged edges is that of the rows of evidence, so these needn't be merged.
    n, returned = star.nodes(spark, d), saved(star.returned_lines(spark, d))
    weights = _information(spark, d, returned, kinds="BT").select(F.col("term").alias("id"), "ic")
    found = maps.focus(n, star.evidence(spark, d, returned), _starts(n).withColumnRenamed("start_id", "center"), least=0.55)
    return maps.ranked(saved(found), n, weights)


@query
def focus_map(spark, d):
    return _focus(spark, d).filter("place is not null").select("center", "place", "id", "type", "distance", "best")


@query
def focus_left_out(spark, d):
    return maps.left_out(_focus(spark, d))


WANTED = ["T:LARGE", "T:SMALL", "B:Brand#1", "B:Brand#12", "none"]


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as annotations of suppliers with parts, below brands and types."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    code = F.when(F.col("l_returnflag") == "R", "ECO:0000314").when(F.col("l_returnflag") == "A", "ECO:0000501")
    rows = line.select(F.concat(F.lit("S:"), "l_suppkey").alias("thing"), F.concat(F.lit("P:"), "l_partkey").alias("term"), F.array_compact(F.array(code)).alias("codes"), F.array(F.concat(F.lit("PMID:"), "l_orderkey")).alias("publications"))
    # Every part is in the closure, so terms are matched once, not at each line, and lines of others meet nothing.
    terms = annotations.matched(annotations.closures(graph.closure(_parents(spark, d))), WANTED)
    return rows.join(terms, "term")


@query
def closure_scan(spark, d):
    return _annotated(spark, d).groupBy("term").agg(F.count("*").alias("n"), F.first(F.array_join("matched", ",")).alias("matched"))


@query
def annotation_groups(spark, d):
    return annotations.grouped(_annotated(spark, d))
