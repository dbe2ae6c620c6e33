"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.work import discard, saved


def components(links: DataFrame) -> DataFrame:
    """Per id of links (a, b, of one type): (id, comp), comp the smallest id that it reaches.

    In each round every remaining component joins its smallest neighbour, chains of such joins are shortened by
    doubling until each component names a root, and the links are carried over to the roots; the rounds are
    logarithmic in number. Rows whose ends are null or equal link nothing. Each round is written to the shared folder.
    """
    links = saved(_ordered(links))
    labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id"))
    first, open_links = links, links
    while not open_links.isEmpty():
        parent = _roots(open_links.groupBy("a").agg(F.min("b").alias("p")))
        labels = labels.join(parent.withColumnsRenamed({"a": "comp", "p": "root"}), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
        over = open_links.join(parent, "a").select("b", F.col("p").alias("x")).join(parent.withColumnsRenamed({"a": "b", "p": "y"}), "b", "left")
        carried = saved(_ordered(over.select(F.col("x").alias("a"), F.coalesce("y", "b").alias("b"))))
        if open_links is not first:
            discard(open_links)
        open_links = carried
    labels = saved(labels)
    discard(first)
    return labels


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _roots(parent: DataFrame) -> DataFrame:
    """parent (a, p) with p replaced by the last of the chain that it begins, four steps of it a round."""
    while True:
        for _ in range(2):
            parent = parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("pp")), "p", "left").select("a", F.coalesce("pp", "p").alias("p"))
        longer = parent.join(parent.select(F.col("a").alias("p"), F.lit(True).alias("more")), "p", "left")
        parent = saved(longer.select("a", "p", F.coalesce("more", F.lit(False)).alias("more")))
        if parent.filter("more").isEmpty():
            return parent.select("a", "p")
        parent = parent.select("a", "p")
