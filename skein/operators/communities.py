"""Communities of a weighted graph by modularity: nodes move while that gains, then communities become nodes, and again.

The modularity of a partition adds, for all pairs of nodes in one community, their weight less k * k' / 2m, where k is a
node's weighted degree and 2m the sum of all k. Weights are integers and gains are compared as such, multiplied by
2m: neither the order of sums nor the number of tasks changes a result.

Nodes move in rounds, many at once. So that gains add up, moves are taken in the order of their gains, each only if it gains
more than the ones before it could cost it at most: a node that enters or leaves the same community costs k * k' / 2m less
the link between the two, and one that leaves the community to be entered, or enters the one that is left, what the link
is above k * k' / 2m. A round's moves together therefore gain something, whichever are taken, and modularity never falls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.work import discard, saved

#: Nodes that may leave or enter one community in a round, the first by gain; the others have their turn in later ones.
MOVERS = 1000
_WIDE = "decimal(38,0)"


def gains(ends: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """Moves (id, k, comm, to, gain) of nodes into neighbouring communities that gain, each node's best one.

    ends (a, b, w) has each link in both directions, labels (id, comm, k) the nodes. gain is that of modularity, times 2m * m.
    """
    votes = ends.filter("a <> b").join(labels.select(F.col("id").alias("b"), F.col("comm").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("w"))
    sums = labels.groupBy("comm").agg(F.sum("k").alias("tot"))
    named = votes.join(labels, "id")
    stays = named.filter(F.col("to") == F.col("comm")).select("id", F.col("w").alias("own"))
    moves = named.filter(F.col("to") != F.col("comm")).join(stays, "id", "left").join(sums.withColumnsRenamed({"comm": "to", "tot": "tot_to"}), "to").join(sums, "comm")
    wide = lambda c: F.col(c).cast(_WIDE)
    gain = F.lit(total).cast(_WIDE) * (wide("w") - F.coalesce(wide("own"), F.lit(0))) - wide("k") * (wide("tot_to") - wide("tot") + wide("k"))
    found = moves.select("id", "k", "comm", "to", gain.cast(_WIDE).alias("gain")).filter("gain > 0")
    return found.groupBy("id", "k", "comm").agg(F.min_by("to", F.struct(-F.col("gain"), "to")).alias("to"), F.max("gain").alias("gain"))


def _taken(ends: DataFrame, moves: DataFrame, total: int) -> DataFrame:
    """The moves of a round, whose gains add up to something in any case. The first by gain is one of them."""
    order = (F.desc("gain"), "id")
    allowed = moves
    for side in ("to", "comm"):
        allowed = allowed.withColumn("place", F.row_number().over(Window.partitionBy(side).orderBy(*order))).filter(F.col("place") <= MOVERS).drop("place")
    before = lambda side: F.coalesce(F.sum("k").over(Window.partitionBy(side).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = allowed.withColumns({"entered": before("to"), "left": before("comm")})
    other = allowed.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "k", "comm", "to", "gain")])
    linked = ends.filter("a <> b").join(allowed.withColumnRenamed("id", "a"), "a").join(other.withColumnRenamed("id_b", "b"), "b")
    earlier = (F.col("gain_b") > F.col("gain")) | ((F.col("gain_b") == F.col("gain")) & (F.col("b") < F.col("a")))
    usual, link = F.col("k").cast(_WIDE) * F.col("k_b").cast(_WIDE), F.lit(total).cast(_WIDE) * F.col("w").cast(_WIDE)
    times = lambda *tests: sum((t.cast("int") for t in tests), F.lit(0))
    same = times(F.col("to") == F.col("to_b"), F.col("comm") == F.col("comm_b"))
    across = times(F.col("to") == F.col("comm_b"), F.col("comm") == F.col("to_b"))
    eased = (same * F.least(link, usual) - across * F.greatest(link - usual, F.lit(0).cast(_WIDE))).cast(_WIDE)
    sums = linked.filter(earlier).groupBy(F.col("a").alias("id")).agg(F.sum(eased).cast(_WIDE).alias("eased"))
    cost = F.col("k").cast(_WIDE) * (F.col("entered") + F.col("left")).cast(_WIDE) - F.coalesce("eased", F.lit(0).cast(_WIDE))
    return counted.join(sums, "id", "left").filter(F.col("gain") > cost).select("id", "to")


def _moved(ends: DataFrame, labels: DataFrame, total: int) -> tuple[DataFrame, bool]:
    """labels after all moves that gain, and whether there were any."""
    given = labels
    while True:
        moves = saved(gains(ends, labels, total))
        if moves.isEmpty():
            discard(moves)
            return labels, labels is not given
        before, labels = labels, saved(labels.join(_taken(ends, moves, total), "id", "left").select("id", F.coalesce("to", "comm").alias("comm"), "k"))
        for used in (moves, before):
            if used is not given:
                discard(used)


def communities(pairs: DataFrame) -> DataFrame:
    """Per id of pairs (a, b, w: a positive integer): (id, label), label the smallest id of its community.

    Repeated pairs add up, whichever way round; pairs of a node with itself count in its degree. Nodes move, communities become nodes and move, and so on
    until none does; then the nodes themselves may move once more, from where they are, and all is repeated if any
    does. So of the result no move of a node or of a community into another one gains. No pair gives no row.
    """
    ends = saved(pairs.select("a", "b", "w").union(pairs.select(F.col("b"), F.col("a"), F.col("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")))
    nodes = saved(ends.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")))
    total = nodes.agg(F.sum("k")).head()[0]
    labels = saved(nodes.select("id", F.col("id").alias("comm"), "k"))
    while total:
        labels, some = _moved(ends, labels, total)
        if not some:
            break
        while True:
            # Communities as nodes: links between them, and their own degrees.
            here = labels.select("id", "comm")
            over = saved(ends.join(here.withColumnsRenamed({"id": "a", "comm": "x"}), "a").join(here.withColumnsRenamed({"id": "b", "comm": "y"}), "b").filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
            level = saved(labels.groupBy(F.col("comm").alias("id")).agg(F.sum("k").alias("k")).select("id", F.col("id").alias("comm"), "k"))
            joined, more = _moved(over, level, total)
            if not more:
                break
            labels = saved(labels.join(joined.select(F.col("id").alias("comm"), F.col("comm").alias("to")), "comm").select("id", F.col("to").alias("comm"), "k"))
            for used in (over, level, joined):
                discard(used)
    first = labels.groupBy("comm").agg(F.min("id").alias("label"))
    return saved(labels.join(first, "comm").select("id", "label"))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n_communities, modularity) of a partition (id, label) of pairs (a, b, w), exact up to the last division."""
    ends = pairs.select("a", "b", "w").union(pairs.select(F.col("b"), F.col("a"), F.col("w")))
    degree = ends.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    by_label = labels.join(degree, "id").groupBy("label").agg(F.sum("k").cast(_WIDE).alias("tot"))
    inner = ends.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").filter("x = y").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("inside"))
    sums = by_label.agg(F.count("*").alias("n_communities"), F.sum("tot").cast("double").alias("m2"), F.sum((F.col("tot") * F.col("tot")).cast(_WIDE)).cast("double").alias("squares"))
    return sums.join(F.broadcast(inner)).select("n_communities", (F.col("inside") / F.col("m2") - F.col("squares") / (F.col("m2") * F.col("m2"))).alias("modularity"))
