"""Resolution of mentions in stages, each taking only what the ones before it left, and groups of names of one thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import content, token_jaccard, with_tokens
from skein.operators.components import components

LEAST_OVERLAP = 0.34


def cascade(mentions: DataFrame, nodes: DataFrame, decisions: DataFrame | None = None, most: int = 5) -> DataFrame:
    """mentions (mention) to (mention, node_id, stage, candidates): exact label, else plain words, else match key.

    A stage with one node decides. A stage with several doesn't fall through to weaker ones: it asks, and the answer is
    taken from decisions (mention, node_id) if it names a candidate, stage "choice", else node_id is null and the stage
    is "ask". What no stage knows asks about the best overlaps of words from LEAST_OVERLAP on; else the stage is "none".
    candidates: the first `most` ids, comma-joined, by overlap and id.
    """
    asked = with_tokens(mentions.select("mention").distinct(), F.col("mention"), "mw")
    worded = with_tokens(nodes.select("id", "label"), F.col("label"), "nw")
    keys = {"exact": (F.col("mention"), F.col("label")), "plain": (F.array_join("mw", " "), F.array_join("nw", " ")), "key": (F.array_join(content(F.col("mw")), " "), F.array_join(content(F.col("nw")), " "))}
    staged = asked
    for stage, (m, n) in keys.items():
        # Only the first few ids of a key that many nodes have are ever named.
        held = worded.select(n.alias(f"k_{stage}"), "id").distinct()
        counted = held.groupBy(f"k_{stage}").agg(F.count("*").alias(f"n_{stage}"), *[F.min("id").alias(f"id_{stage}")])
        staged = staged.withColumn(f"k_{stage}", m).join(counted, f"k_{stage}", "left")
    at = F.coalesce(*[F.when(F.col(f"n_{s}").isNotNull(), F.lit(s)) for s in keys])
    staged = staged.withColumn("at", at).withColumn("n", F.coalesce(*[F.when(F.col("at") == s, F.col(f"n_{s}")) for s in keys]))
    only = F.coalesce(*[F.when(F.col("at") == s, F.col(f"id_{s}")) for s in keys])
    several = staged.filter("n > 1").select("mention", "at", F.coalesce(*[F.when(F.col("at") == s, F.col(f"k_{s}")) for s in keys]).alias("k"))
    by_stage = None
    for stage, (_, n) in keys.items():
        own = several.filter(F.col("at") == stage).join(worded.select(n.alias("k"), "id").distinct(), "k").select("mention", "id", F.lit(1.0).alias("score"))
        by_stage = own if by_stage is None else by_stage.union(own)
    left = staged.filter("at is null").select("mention", "mw")
    met = left.select("mention", "mw", F.explode(content(F.col("mw"))).alias("w")).join(worded.select("id", "nw", F.explode(F.array_distinct(content(F.col("nw")))).alias("w")), "w").dropDuplicates(["mention", "id"])
    scored = met.withColumn("score", token_jaccard(content(F.col("mw")), content(F.col("nw")))).filter(F.col("score") >= LEAST_OVERLAP).select("mention", "id", "score")
    open_ = by_stage.union(scored)
    named = open_.groupBy("mention").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, most), lambda x: x["id"]), ",").alias("candidates"))
    out = staged.select("mention", F.when(F.col("n") == 1, only).alias("node_id"), F.when(F.col("n") == 1, F.col("at")).alias("stage")).join(named, "mention", "left")
    if decisions is not None:
        out = out.join(decisions.select("mention", F.col("node_id").alias("chosen")).dropDuplicates(["mention"]), "mention", "left")
    else:
        out = out.withColumn("chosen", F.lit(None).cast("string"))
    fits = F.col("node_id").isNull() & F.array_contains(F.split("candidates", ","), F.col("chosen"))
    stage = F.coalesce("stage", F.when(fits, "choice"), F.when(F.col("candidates").isNotNull(), "ask"), F.lit("none"))
    return out.select("mention", F.coalesce("node_id", F.when(fits, F.col("chosen"))).alias("node_id"), stage.alias("stage"), F.coalesce("candidates", F.lit("")).alias("candidates"))


def duplicate_groups(nodes: DataFrame, xrefs: DataFrame) -> DataFrame:
    """(id, head): nodes of one type under one match key or one cross-reference (id, xref) belong together, also through
    others; the head is the smallest id. Nodes without a like are their own head.

    Nodes link to the smallest one under their key, a row a node, not a pair of nodes.
    """
    keyed = with_tokens(nodes.select("id", "type", "label"), F.col("label"), "w").select("id", "type", F.array_join(content(F.col("w")), " ").alias("k")).filter("k <> ''")
    shared = keyed.unionByName(xrefs.join(nodes.select("id", "type"), "id").select("id", "type", F.concat(F.lit("x:"), "xref").alias("k")))
    first = shared.groupBy("type", "k").agg(F.min("id").alias("first"))
    links = shared.join(first, ["type", "k"]).filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    found = components(links)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("head"))
