"""Graph operators over nodes (id, type, label) and edges (id, source_id, relation, target_id, confidence, evidence_type)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numeric import edge_cost, millionths
from skein.operators.work import discard, saved
from skein.schema import HUB_COST


def incidence(edges: DataFrame) -> DataFrame:
    """A row (node_id, other_id, direction) and the edge's columns per end of each edge; a self loop has one row."""
    ends = F.filter(
        F.array(
            F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id"), F.lit("out").alias("direction")),
            F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id"), F.lit("in").alias("direction")),
        ),
        lambda e: (F.col("source_id") != F.col("target_id")) | (e["direction"] == "out"),
    )
    return edges.withColumn("_end", F.explode(ends)).select("_end.*", *edges.columns)


def neighbors(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = None, least: float = 0.0, evidence: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Edges at each node with the other end's type and label, filtered by relation, confidence, evidence and type."""
    touching = incidence(edges.filter(F.col("confidence") >= least))
    if relations:
        touching = touching.filter(F.col("relation").isin(relations))
    if evidence:
        touching = touching.filter(F.col("evidence_type").isin(evidence))
    other = nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"), F.col("label").alias("other_label"))
    if types:
        other = other.filter(F.col("other_type").isin(types))
    return touching.join(other, "other_id")


def counts_by_relation(edges: DataFrame) -> DataFrame:
    """Edges by (relation, evidence_type), by each of them and in all; null stands for all."""
    return edges.groupingSets([["relation", "evidence_type"], ["relation"], ["evidence_type"], []], "relation", "evidence_type").agg(F.count("*").alias("n_edges"))


def top_edges(edges: DataFrame, most: int = 25) -> DataFrame:
    """Each node's first edges: phenotypes last, then by confidence and id."""
    order = [(F.col("relation") == "has_phenotype").asc(), F.desc("confidence"), F.asc("id")]
    ranked = incidence(edges).withColumn("rank", F.row_number().over(Window.partitionBy("node_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= most)


def reach(edges: DataFrame, starts: DataFrame, depth: int, types: DataFrame | None = None) -> DataFrame:
    """Breadth first from starts (start_id): (start_id, id, distance) of all that is at most depth edges away.

    types: nodes (id) that may be walked through; others are reached and counted, but not left again.
    Each level joins only what the last one reached first, and is written before the next. Edges are read a level at a time, so they
    should be written; parallel ones merge where a level merges what it found.
    """
    ends = F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    steps = edges.select(F.explode(ends).alias("s")).select("s.a", "s.b")
    seen = saved(starts.select("start_id", F.col("start_id").alias("id"), F.lit(0).alias("distance")).distinct())
    front = seen
    for level in range(1, depth + 1):
        open_ = front if types is None or level == 1 else front.join(types, "id", "left_semi")
        found = open_.select("start_id", F.col("id").alias("a")).join(steps, "a").select("start_id", F.col("b").alias("id")).distinct()
        front = saved(found.join(seen, ["start_id", "id"], "left_anti").withColumn("distance", F.lit(level)))
        seen = seen.union(front)
    return seen


def closure(parents: DataFrame) -> DataFrame:
    """Reflexive and transitive ancestors of (child, parent): (id, ancestor). Semi-naive: only new pairs are joined on."""
    ids = parents.select(F.explode(F.array("child", "parent")).alias("id")).distinct()
    known = saved(ids.select("id", F.col("id").alias("ancestor")).union(parents.select("child", "parent")).distinct())
    fresh = saved(parents.select(F.col("child").alias("id"), F.col("parent").alias("ancestor")).distinct())
    while not fresh.isEmpty():
        longer = fresh.join(parents, fresh["ancestor"] == parents["child"]).select("id", parents["parent"].alias("ancestor")).distinct()
        newer = saved(longer.join(known, ["id", "ancestor"], "left_anti"))
        known, fresh, old = saved(known.union(newer)), newer, (known, fresh)
        for t in old:
            discard(t)
    return known


def information_content(annotations: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Per term: n, the things (thing, term) annotated with it or a term below it, and ic = -ln(n / all things)."""
    total = annotations.agg(F.count_distinct("thing").alias("total"))
    n = annotations.join(ancestors, annotations["term"] == ancestors["id"]).groupBy("ancestor").agg(F.count_distinct("thing").alias("n"))
    return n.join(F.broadcast(total)).select(F.col("ancestor").alias("term"), "n", (-F.log(F.greatest("n", F.lit(1)) / F.col("total"))).alias("ic"))


def routing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected routes (lo, hi, cost, w, edge_id) without loops: the cheapest edge of each pair, ties by id. Edges without ids give routes without.

    cost is the edge's, w with a penalty for each end that is a phenotype, both in millionths.
    """
    cost = millionths(edge_cost(F.col("confidence"), F.col("evidence_type") == "inferred"))
    pairs = edges.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi"), cost.alias("cost"), *[c for c in ("id",) if c in edges.columns])
    if "id" in edges.columns:
        best = pairs.groupBy("lo", "hi").agg(F.min(F.struct("cost", "id")).alias("e")).select("lo", "hi", "e.cost", F.col("e.id").alias("edge_id"))
    else:
        best = pairs.groupBy("lo", "hi").agg(F.min("cost").alias("cost"))
    hubs = nodes.filter(F.col("type") == "phenotype").select("id").distinct()
    marked = best
    for end in ("lo", "hi"):
        marked = marked.join(hubs.select(F.col("id").alias(end), F.lit(1).alias(f"hub_{end}")), end, "left")
    n = F.coalesce("hub_lo", F.lit(0)) + F.coalesce("hub_hi", F.lit(0))
    return marked.select("lo", "hi", "cost", (F.col("cost") + n * int(HUB_COST / 2 * 1_000_000)).cast("long").alias("w"), *best.columns[3:])


def cheapest_paths(routes: DataFrame, source: str, target: str, k: int = 3, hops: int = 8) -> DataFrame:
    """The k cheapest simple paths by w of at most hops edges: (path, edge_ids, w, cost, n_edges), ties by path; cost is
    without penalties, in four decimals. See cheapest(); ids are looked up for what it found."""
    return with_edges(saved(cheapest(routes, source, target, k, hops)), routes)


def with_edges(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Paths with the ids of their routes, by w and path."""
    hop = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda a, i: F.struct(F.least(a, F.get("path", i + 1)).alias("lo"), F.greatest(a, F.get("path", i + 1)).alias("hi")))
    found = paths.select("path", F.posexplode(hop).alias("pos", "e")).select("path", "pos", "e.*").join(routes.select("lo", "hi", "edge_id"), ["lo", "hi"])
    ids = found.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"]).alias("edge_ids"))
    return paths.join(ids, "path").select("path", "edge_ids", "w", "cost", "n_edges").orderBy("w", F.array_join("path", ">"))


def _bounded(steps: DataFrame, bound: DataFrame, front: DataFrame, source: str, limit: int | None, rounds: int) -> tuple[DataFrame, int | None]:
    """bound (id, h): the least w to the target of all nodes where it is within the limit, and the limit. None is lowered to what the source has.

    Only what the last round improved (front) is joined, and what exceeds the limit isn't shuffled.
    """
    own = limit is None
    for _ in range(rounds):
        onward = front.withColumnRenamed("id", "b").join(steps, "b").select(F.col("a").alias("id"), (F.col("w") + F.col("h")).alias("h"))
        onward = onward if limit is None else onward.filter(F.col("h") <= limit)
        found = saved(onward.groupBy("id").agg(F.min("h").alias("h")))
        known = bound.join(found.select("id"), "id", "left_semi").withColumnRenamed("h", "was")
        better = saved(found.join(known, "id", "left").filter("was is null or h < was").select("id", "h"))
        discard(found)
        if better.isEmpty():
            break
        bound, old = saved(bound.union(better).groupBy("id").agg(F.min("h").alias("h"))), bound
        discard(old)
        least = [r["h"] for r in better.filter(F.col("id") == source).select("h").collect()]
        limit = min([*least, *([] if limit is None else [limit])], default=None) if own else limit
        front = better if limit is None else better.filter(F.col("h") <= limit)
    return bound, limit


def cheapest(routes: DataFrame, source: str, target: str, k: int = 3, hops: int = 8) -> DataFrame:
    """The k cheapest simple paths by w of at most hops edges, without ids: (path, w, cost, n_edges), ties by path.

    First the least w from nodes to the target is found, as far as it is within that of the source; it bounds from below what any
    unfinished path still costs, and of other nodes the limit does. Paths from the source are then extended as long as what they
    cost and the bound stay within a limit. It begins at the optimum and, until k paths lie within it or nothing was cut off, goes on
    to the k-th of the values that were cut off, by an eighth at least, and the bound with it, so few paths are looked at that cost more than the answer.
    """
    spark = routes.sparkSession
    schema = "path array<string>, w long, cost double, n_edges int"
    if source == target:
        return spark.createDataFrame([], schema)
    written = saved(routes.select("lo", "hi", "w", "cost"))
    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))
    steps = written.select(F.explode(ends).alias("e"), "w", "cost").select("e.*", "w", "cost")
    start = saved(spark.createDataFrame([(target, 0)], "id string, h long"))
    bound, limit = _bounded(steps, saved(start), start, source, None, hops)
    if limit is None:
        return spark.createDataFrame([], schema)
    while True:
        paths = saved(spark.createDataFrame([([source], source, 0, 0)], "path array<string>, at string, w long, cost long"))
        done, cut = [], []
        for n in range(1, hops + 1):
            grown = paths.join(steps.withColumnsRenamed({"w": "step", "cost": "more"}), F.col("at") == F.col("a")).filter(~F.array_contains("path", F.col("b")))
            grown = grown.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at"), (F.col("w") + F.col("step")).alias("w"), (F.col("cost") + F.col("more")).alias("cost"))
            full = saved(grown.join(bound.withColumnRenamed("id", "at"), "at", "left").withColumn("f", F.col("w") + F.coalesce("h", F.lit(limit + 1))))
            cut += [r["f"] for r in full.filter(F.col("f") > limit).groupBy("f").agg(F.count("*").alias("n")).orderBy("f").limit(k).collect()]
            inside = full.filter(F.col("f") <= limit)
            done.append(inside.filter(F.col("at") == target).select("path", "w", F.round(F.col("cost") / 1_000_000, 4).alias("cost"), F.lit(n).alias("n_edges")))
            paths = saved(inside.filter(F.col("at") != target).select("path", "at", "w", "cost"))
            if paths.isEmpty():
                break
        best = reduce(DataFrame.union, done).orderBy("w", F.array_join("path", ">")).limit(k)
        if not cut or best.count() >= k:
            return best
        limit = max(sorted(set(cut))[:k][-1], limit + limit // 8)
        bound = _bounded(steps, bound, saved(bound), source, limit, hops)[0]


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def shared_items(members: DataFrame, cluster: Column | str, item: Column | str, least: int = 2) -> DataFrame:
    """Items that at least least members (member) of a cluster have."""
    return members.groupBy(cluster, item).agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"), F.count_distinct("member").alias("n")).filter(F.col("n") >= least)
