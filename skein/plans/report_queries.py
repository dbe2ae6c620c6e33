"""The catalogue, second part: clusters, reports, investigators, search by meaning, record fields."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import fields
from skein.functions.numeric import finite, round4
from skein.functions.text import first_sentence, registry_name, squeezed
from skein.operators import clusters, communities, coverage, graph, search, similarity, trust
from skein.operators.components import components
from skein.operators.work import saved
from skein.plans.star_queries import WEIGHTS, Query, nodes_and_edges, profiles_of
from skein.sources import star
from skein.sources.star import table
from skein.streaming import windows

_FOUND: dict[str, Query] = {}
LIKE = 0.1


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


@cache
def queries() -> dict[str, Query]:
    return dict(_FOUND)


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Nodes, profiles, pairs and clusters: components of like pairs, each disease without a like in one of its own."""
    n, profile = star.nodes(spark, d), profiles_of(spark, d)
    pairs = saved(similarity.scored_pairs(profile, WEIGHTS))
    found = components(pairs.filter(F.col("score") >= LIKE).select("a", "b"))
    diseases = n.filter("type = 'disease'").select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("label"))
    return n, profile, pairs, saved(similarity.cluster_ids(diseases))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions as clusters of nations, where what is asked for needs several clusters."""
    return table(spark, d, "nation").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"), F.concat(F.lit("C"), F.col("n_regionkey") + 1).alias("cluster"))


@query
def cluster_ids(spark, d):
    return _clustered(spark, d)[3]


@query
def cluster_features(spark, d):
    return clusters.features(profiles_of(spark, d), _regions(spark, d))


@query
def cluster_labels(spark, d):
    own = _regions(spark, d)
    return clusters.labels(clusters.features(profiles_of(spark, d), own), own, star.nodes(spark, d))


@query
def cluster_bridges(spark, d):
    return clusters.bridges(_clustered(spark, d)[2], _regions(spark, d))


@query
def counterexamples(spark, d):
    n, profile, pairs, _ = _clustered(spark, d)
    return clusters.counterexamples(profile, pairs, _regions(spark, d), n)


def like_pairs(pairs: DataFrame) -> DataFrame:
    """Like pairs with integer weights, ten thousandths of their scores."""
    return pairs.filter(F.col("score") >= LIKE).select("a", "b", F.round(F.col("score") * 10000).cast("long").alias("w"))


def communities_of(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Nodes, profiles, pairs and clusters: communities of like pairs, each disease without a like in one of its own."""
    n, profile = star.nodes(spark, d), profiles_of(spark, d)
    pairs = saved(similarity.scored_pairs(profile, WEIGHTS))
    found = communities.communities(like_pairs(pairs))
    diseases = n.filter("type = 'disease'").select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return n, profile, pairs, saved(similarity.cluster_ids(diseases))


@query
def similarity_communities(spark, d):
    return communities_of(spark, d)[3]


@query
def community_quality(spark, d):
    _, _, pairs, found = communities_of(spark, d)
    return communities.modularity(like_pairs(pairs), found.withColumnRenamed("cluster", "label")).withColumn("modularity", round4(F.col("modularity")))


@query
def community_details(spark, d):
    n, profile, pairs, found = communities_of(spark, d)
    return clusters.details(n, profile, pairs, found, LIKE)


@query
def similarity_degree(spark, d):
    pairs = _clustered(spark, d)[2].filter(F.col("score") >= LIKE)
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


@query
def mechanism_frequency(spark, d):
    return similarity.profiles(star.nodes(spark, d), star.evidence(spark, d)).filter("kind = 'mechanism'").groupBy(F.col("feature").alias("mechanism")).agg(F.count("*").alias("n"))


@query
def pair_reasons(spark, d):
    n, profile, pairs, _ = _clustered(spark, d)
    label = n.select(F.col("id").alias("feature"), "label")
    met = similarity.shared_pairs(profile.filter("kind in ('gene', 'mechanism')"), ["kind"]).join(label, "feature")
    said = met.withColumn("r", F.row_number().over(Window.partitionBy("a", "b", "kind").orderBy("feature"))).filter("r <= 3").groupBy("a", "b", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), ", ").alias("names"))
    wide = said.groupBy("a", "b").agg(*[F.max(F.when(F.col("kind") == k, F.col("names"))).alias(f"{k}s") for k in ("gene", "mechanism")])
    more = F.when(F.col("n_mechanism") > 3, F.format_string(" and %d more", F.col("n_mechanism") - 3)).otherwise("")
    parts = F.array(F.concat(F.lit("shares gene "), "genes"), F.concat(F.lit("shares GO mechanism via its genes: "), "mechanisms", more))
    return pairs.join(wide, ["a", "b"]).select("a", "b", F.array_join(F.array_compact(parts), "; ").alias("reasons"))


@query
def node_cards(spark, d):
    n, e = nodes_and_edges(spark, d, whole=True)
    ends = graph.incidence(e)
    counted = ends.groupBy("node_id").agg(F.count("*").alias("n_edges"), F.count_distinct("other_id").alias("n_neighbours"), F.count_if(F.col("evidence_type") == "inferred").alias("n_inferred"), F.max("confidence").alias("best"))
    first = ends.groupBy("node_id").agg(F.min_by("id", F.struct((F.col("relation") == "has_phenotype").alias("late"), -F.col("confidence"), "id")).alias("first_edge"))
    found = n.join(counted.join(first, "node_id").withColumnRenamed("node_id", "id"), "id", "left")
    return found.select("id", "type", "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_edges", "n_neighbours", "n_inferred")], F.coalesce("best", F.lit(0.0)).alias("best"), "first_edge")


@query
def meta(spark, d):
    n, e = nodes_and_edges(spark, d)
    return n.agg(F.count("*").alias("n_nodes")).join(e.agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("relation").alias("n_relations")))


@query
def coverage_other(spark, d):
    n, e = nodes_and_edges(spark, d)
    kinds = {"diseases": "caused_by", "mechanisms": "participates_in"}
    return coverage.coverage(n, e, "gene", kinds)


@query
def weak_leads(spark, d):
    n, e = nodes_and_edges(spark, d)
    routes = e.filter("relation in ('studies_condition', 'represents') and (confidence < 0.7 or evidence_type = 'inferred')")
    return routes.join(n.filter("type = 'disease'").select(F.col("id").alias("target_id"), F.col("label").alias("disease")), "target_id").groupBy("target_id", "disease").agg(F.count("*").alias("n_leads"), F.min("confidence").alias("least"), F.min("id").alias("first"))


@query
def partner_paths(spark, d):
    # Groups that represent a disease, and funders of those who investigate it: the shortest way, then the surest, then by ids.
    _, e = nodes_and_edges(spark, d)
    direct = e.filter("relation = 'represents'").select(F.col("target_id").alias("disease"), F.col("source_id").alias("partner"), F.lit(1).alias("n_edges"), F.col("confidence").alias("least"), F.col("id").alias("path"))
    studies = e.filter("relation = 'investigates'").select(F.col("source_id").alias("via"), F.col("target_id").alias("disease"), F.col("confidence").alias("c1"), F.col("id").alias("e1"))
    funds = e.filter("relation = 'funds'").select(F.col("target_id").alias("via"), F.col("source_id").alias("partner"), F.col("confidence").alias("c2"), F.col("id").alias("e2"))
    through = studies.join(funds, "via").select("disease", "partner", F.lit(2).alias("n_edges"), F.least("c1", "c2").alias("least"), F.concat_ws(",", "e1", "e2").alias("path"))
    best = direct.unionByName(through).groupBy("disease", "partner").agg(F.min(F.struct("n_edges", (-F.col("least")).alias("worst"), "path")).alias("b"))
    return best.select("disease", "partner", "b.n_edges", (-F.col("b.worst")).alias("least"), "b.path")


@query
def investigator_bridges(spark, d):
    regions = _regions(spark, d).withColumnsRenamed({"id": "target_id", "cluster": "community"})
    _, e = nodes_and_edges(spark, d)
    linked = e.filter("relation = 'investigates'").join(regions, "target_id")
    found = linked.groupBy("source_id").agg(F.array_sort(F.collect_set("community")).alias("communities"), F.count_distinct("target_id").alias("n_targets"), F.sum(F.col("qualifier").cast("long")).alias("n_projects")).filter(F.size("communities") >= 2)
    order = Window.orderBy(F.desc("n"), F.desc("n_targets"), F.desc("n_projects"), "source_id")
    first = found.withColumn("n", F.size("communities")).orderBy(F.desc("n"), F.desc("n_targets"), F.desc("n_projects"), "source_id").limit(30)
    why = F.concat(fields.plural(F.col("n_projects"), "project"), F.lit(" in "), F.array_join("communities", " + "))
    return first.select(F.col("source_id").alias("investigator"), "n_targets", "n_projects", F.row_number().over(order).alias("rank"), why.alias("why"))


@query
def relevant_bridges(spark, d):
    # Investigators of a disease or of one that shares a cause with it.
    _, e = nodes_and_edges(spark, d)
    genes = e.filter("relation = 'caused_by'").select(F.col("source_id").alias("disease"), "target_id")
    near = genes.join(genes.withColumnRenamed("disease", "other"), "target_id").select("disease", "other").distinct()
    works = e.filter("relation = 'investigates'").select(F.col("source_id").alias("investigator"), F.col("target_id").alias("other"))
    return near.join(works, "other").groupBy("disease").agg(F.count_distinct("investigator").alias("n_investigators"), F.count_distinct("other").alias("n_targets"))


@query
def shared_gene_degree(spark, d):
    # The cause that most diseases share, for each disease: what a next experiment falls back to.
    _, e = nodes_and_edges(spark, d)
    genes = e.filter("relation = 'caused_by'").select(F.col("source_id").alias("disease"), F.col("target_id").alias("gene")).distinct()
    n = genes.groupBy("gene").agg(F.count("*").alias("n"))
    return genes.join(n, "gene").groupBy("disease").agg(F.min(F.struct((-F.col("n")).alias("m"), "gene")).alias("b")).select("disease", "b.gene", (-F.col("b.m")).alias("n"))


@query
def search_semantic(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 20 = 0")
    lexical = asked.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"))
    return search.semantic(lexical, search.nearest(asked, v))


@query
def interleaved_hits(spark, d):
    # The dearest orders of each status in turn.
    o = table(spark, d, "orders")
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    codes = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    lists = o.withColumn("rank", rank).filter("rank <= 40").select(codes.alias("list_no"), "rank", F.col("o_orderkey").alias("item"))
    return search.interleaved(lists, 60)


@query
def projects_per_target(spark, d):
    _, e = nodes_and_edges(spark, d)
    return e.filter("relation = 'investigates'").groupBy("target_id").agg(F.count_distinct("source_id").alias("n_investigators"), F.sum(F.col("qualifier").cast("long")).alias("n_projects"))


@query
def latest_order_per_customer_and_status(spark, d):
    return trust.latest(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@query
def story_checks(spark, d):
    # Whether each step of a story has an edge, and whether what should be a gap is one.
    _, e = nodes_and_edges(spark, d)
    steps = ["caused_by", "participates_in", "has_phenotype", "investigates", "funds", "claims"]
    counted = e.filter(F.col("relation").isin(*steps)).groupBy("relation").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(s, s == "claims") for s in steps], "relation string, is_gap boolean")
    n = F.coalesce("n", F.lit(0))
    return wanted.join(counted, "relation", "left").select("relation", n.alias("n"), ((n > 0) != F.col("is_gap")).alias("holds"))


@query
def record_fields(spark, d):
    p = table(spark, d, "part")
    label = squeezed(F.col("p_name"))
    raw = F.array(F.concat(F.lit("ORPHA:"), "p_partkey"), F.concat(F.lit("OMIM:"), "p_size"), F.col("p_type"), F.concat(F.lit("ORPHA:"), "p_partkey"))
    names = F.array(F.upper("p_name"), F.col("p_type"), F.lit(" "), F.concat(F.lit(" "), "p_type"))
    return p.select(
        "p_partkey",
        F.array_join(fields.xrefs(raw), ",").alias("xrefs"),
        F.array_join(fields.synonyms(label, names), ",").alias("synonyms"),
        fields.spelt(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("spelt"),
        fields.plural(F.col("p_size"), "part").alias("counted"),
        F.array_join(fields.listed(F.concat_ws(",", "p_brand", F.lit(" "), "p_type")), "|").alias("listed"),
        fields.stub_label(F.nullif("p_type", F.lit("STANDARD")), F.concat(F.lit("P:"), "p_partkey")).alias("stub"),
        fields.asset_id(F.when(F.col("p_size") > 25, F.concat(F.lit("NCT"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise(F.concat(F.lit("PMID:"), "p_partkey")), F.when(F.col("p_size") > 10, "publication").otherwise("tool"), F.col("p_brand")).alias("asset"),
    )


@query
def attribute_maps(spark, d):
    # Curated attributes have precedence over a record's own; blanks go.
    c = table(spark, d, "customer")
    own = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("blank"), F.lit(" "))
    curated = F.create_map(F.lit("nation"), F.concat(F.lit("N:"), "c_nationkey"), F.lit("key"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", F.to_json(fields.without_blanks(fields.merged_maps(curated, own))).alias("attributes"))


@query
def usable_numbers(spark, d):
    # Texts as numbers, where they are finite ones above 0.
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "NaN").when(F.col("o_orderkey") % 5 == 1, "Infinity").when(F.col("o_orderkey") % 5 == 2, "x").otherwise(F.col("o_totalprice").cast("string")).alias("raw"))
    return o.select("o_orderkey", round4(finite(F.col("raw"))).alias("value")).filter("value > 0")


@query
def request_ids(spark, d):
    # The ids of the parts of an order as a request: distinct, in order of lines, none if there are over 4.
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    asked = line.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: F.concat(F.lit(" P:"), s["l_partkey"].cast("string"))).alias("ids"))
    return asked.select("l_orderkey", F.array_join(fields.clean_ids(F.col("ids"), 4), ",").alias("ids"))


@query
def first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", first_sentence(squeezed(F.coalesce("text", F.lit("")))).alias("sentence"))


@query
def registry_names(spark, d):
    return table(spark, d, "part").select("p_partkey", registry_name(F.concat(F.col("p_name"), F.lit("'s Type "), F.when(F.col("p_size") % 2 == 0, "IV").otherwise("VI"))).alias("name"))


@query
def client_events(spark, d):
    e = table(spark, d, "events")
    header = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), "user_id", F.lit(", 10.1.1.1"))).when(F.col("user_id") % 3 == 1, "")
    peer = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("peer"), "user_id"))
    return e.groupBy(fields.client_key(header, peer).alias("client")).agg(F.count("*").alias("n"))


@query
def daily_events(spark, d):
    found = windows.tumbling(table(spark, d, "events").withColumn("cents", F.floor(F.col("value") * 100 + 0.5).cast("long")), 1440)
    return found.groupBy("event_type").agg(F.count("*").alias("n_days"), F.max("n_events").alias("most"), F.sum("cents").alias("cents"))
