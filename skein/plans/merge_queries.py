"""The catalogue, fifth part: canonical nodes and edges between them, and conditions mapped by an index of names."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import canonical, conditions, resolver
from skein.operators.work import saved
from skein.plans.star_queries import Query
from skein.sources import star
from skein.sources.star import table

_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


@cache
def queries() -> dict[str, Query]:
    return dict(_FOUND)


def full_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The star's nodes with synonyms, cross-references and attributes; nations have two more records under other registries."""
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    plain = star.nodes(spark, d).filter("type not in ('phenotype', 'disease', 'investigator')").select("id", "type", "label", none.alias("synonyms"), none.alias("xrefs"), nothing.alias("attributes"))
    part = table(spark, d, "part").select(F.concat(F.lit("P:"), "p_partkey"), F.lit("phenotype"), "p_name", F.array("p_type", "p_brand", "p_name"), F.array(F.concat(F.lit("sku:"), "p_partkey")), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    s = F.col("s_suppkey")
    other = F.when(s % 10 == 0, F.array(F.concat(F.lit("s:"), s + 1))).otherwise(none)
    supplier = table(spark, d, "supplier").select(F.concat(F.lit("S:"), s), F.lit("investigator"), "s_name", F.array(F.lower("s_name")), other, F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")))
    nation, k = table(spark, d, "nation"), F.col("n_nationkey")
    region = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))
    records = [
        nation.select(F.concat(F.lit("N:"), k), F.lit("disease"), "n_name", none, none, region),
        nation.select(F.concat(F.lit("ORPHA:"), k), F.lit("disease"), F.concat(F.lit("the "), F.lower("n_name")), F.array(F.concat(F.lit("land "), k)), none, F.create_map(F.lit("region"), F.lit("?"), F.lit("orpha"), k.cast("string"))),
        nation.select(F.concat(F.lit("MONDO:"), k), F.lit("disease"), F.concat(F.lit("State "), k), F.array(F.concat(F.lit("land "), k), F.upper("n_name")), F.array(F.concat(F.lit("orpha:"), k)), nothing),
    ]
    out = plain
    for more in (part, supplier, *records):
        out = out.union(more)
    return out


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = full_nodes(spark, d)
    return n, canonical.groups(n)


@query
def canonical_nodes(spark, d):
    found = canonical.canonical(*_grouped(spark, d))
    return found.select("id", "type", "label", "n_members", F.array_join("synonyms", "|").alias("synonyms"), "n_synonyms", F.array_join("xrefs", "|").alias("xrefs"), "n_xrefs", F.to_json("attributes").alias("attributes"))


@query
def canonical_aliases(spark, d):
    return canonical.aliases(_grouped(spark, d)[1])


@query
def canonical_edges(spark, d):
    return canonical.merged_edges(star.evidence(spark, d, once=True), canonical.aliases(_grouped(spark, d)[1]))


@query
def merge_report(spark, d):
    return canonical.merge_report(*_grouped(spark, d), star.evidence(spark, d))


def _studies(spark: SparkSession, d: str) -> DataFrame:
    """Orders as studies, with the customer's nation and segment and a name that only an alias knows among their conditions."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Land-"), "n_nationkey")).when(F.col("o_orderstatus") == "O", F.concat(F.col("n_name"), F.lit("'s")))
    kinds = F.array_compact(F.array(own, F.col("c_mktsegment"), F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("region "), "n_regionkey"))))
    queries = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("seed"), F.lit("wide"))).otherwise(F.array(F.lit("wide")))
    return rows.select(F.concat(F.lit("O:"), "o_orderkey").alias("study_id"), kinds.alias("conditions"), queries.alias("queries"), F.col("o_orderstatus").alias("status"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations with synonyms (that of their region is one of several nations), and the index with a segment as an alias."""
    nation = table(spark, d, "nation")
    named = nation.select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("land "), "n_nationkey"), F.concat(F.lit("Region "), "n_regionkey")).alias("synonyms"))
    segment = table(spark, d, "customer").agg(F.min("c_mktsegment").alias("name")).select("name", F.lit("N:0").alias("node_id"))
    return named, conditions.name_index(named, segment)


def _mapped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    studies = _studies(spark, d)
    return studies, conditions.mapped(studies, _index(spark, d)[1])


@query
def condition_index(spark, d):
    return _index(spark, d)[1]


@query
def ambiguous_synonyms(spark, d):
    return conditions.ambiguous(_index(spark, d)[0])


@query
def unmapped_conditions(spark, d):
    return conditions.unmapped(_mapped(spark, d)[1])


@query
def condition_edges(spark, d):
    studies, found = _mapped(spark, d)
    return conditions.condition_edges(found, studies.select("study_id", "status"))


@query
def kept_studies(spark, d):
    studies, found = _mapped(spark, d)
    return conditions.kept_studies(studies, found).select("study_id", F.array_join("queries", ",").alias("queries"))


def _questions(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Mentions of all kinds, the nodes they could mean, and the vectors of some: a node has two vectors, and every second asked one is turned round."""
    none, nothing = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    v = table(spark, d, "embeddings")
    at = F.concat(F.lit("V:"), F.floor(F.col("vec_id") / 2))
    held = v.select(at.alias("id")).distinct().select("id", F.lit("vector"), F.concat(F.lit("Held "), "id"), none, none, nothing)
    nodes = full_nodes(spark, d).filter("type <> 'study'").union(held).select("id", "label", "synonyms", "xrefs")
    part, nation = table(spark, d, "part"), table(spark, d, "nation")
    asked = v.filter("vec_id % 20 = 0").select(F.concat(F.lit("Unknown-"), "vec_id").alias("mention"), F.when(F.col("vec_id") % 40 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    mentions = [nation.select(F.lower("n_name")), nation.select(F.concat(F.lit("orpha:"), "n_nationkey")), nation.select(F.concat(F.lit("Land "), "n_nationkey")), part.select("p_name"), part.select("p_brand"), part.select(F.concat(F.lit("the "), "p_type", F.lit(" "), F.element_at(F.split("p_name", " "), -1))), asked.select("mention")]
    every = mentions[0].toDF("mention")
    for more in mentions[1:]:
        every = every.union(more)
    return every.distinct(), nodes, asked, v.select(at.alias("id"), "embedding")


@query
def resolve_stages(spark, d):
    return resolver.resolve(*_questions(spark, d)).select("mention", "node_id", "method", "score", F.array_join("candidates", ",").alias("candidates"), "key")


@query
def resolve_decided(spark, d):
    # Half of what was asked is answered by its last candidate, and asked again.
    given = _questions(spark, d)
    open_ = resolver.resolve(*given).filter("key <> '' and substring(key, 1, 1) < '8'")
    found = resolver.resolve(*given, decisions=saved(open_.select("key", F.try_element_at("candidates", F.lit(-1)).alias("node_id"))))
    return found.groupBy("method").agg(F.count("*").alias("n"), F.count("node_id").alias("n_nodes"), F.min("mention").alias("first"), F.min("node_id").alias("first_node"))
