"""Checks of quotes and numbers, and fields of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import numbers, squeezed
from skein.operators.work import saved


def quoted(docs: DataFrame, quotes: DataFrame, seed_words: int = 6) -> DataFrame:
    """(doc_id, item_id) where the white-space-squeezed text of a document holds that of a quote verbatim.

    A quote may begin or end inside a word of the document, so its inner words, at most seed_words - 2 of them, are its
    seed. Documents and quotes meet under hashes of seeds, documents by id only; the texts are fetched for the pairs
    that met, and the whole quote is searched. Quotes of one or two words have no inner words: they are a stated set,
    each searched in every text. Empty ones are found nowhere.
    """
    d = saved(docs.select("doc_id", squeezed(F.col("text")).alias("t")))
    q = quotes.select("item_id", squeezed(F.col("text")).alias("q")).filter("q <> ''").withColumn("w", F.split("q", " "))
    k = F.least(F.size("w"), F.lit(seed_words)) - 2
    seeded = saved(q.withColumn("k", k).withColumn("seed", F.when(k > 0, F.xxhash64(F.array_join(F.slice("w", 2, F.greatest(k, F.lit(1))), " ")))).select("item_id", "q", "k", "seed"))
    lengths = sorted(r["k"] for r in seeded.filter("k > 0").select("k").distinct().collect())
    met = None
    for n in lengths:
        runs = d.select("doc_id", F.split("t", " ").alias("w")).filter(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(_runs(n))).alias("seed"))
        own = runs.join(seeded.filter(F.col("k") == n).select("item_id", "seed", "q"), "seed").select("doc_id", "item_id", "q")
        met = own if met is None else met.union(own)
    found = d.select("doc_id", "t").join(seeded.filter("k <= 0").select("item_id", "q"), F.contains("t", F.col("q"))).select("doc_id", "item_id")
    if met is not None:
        found = found.union(met.join(d, "doc_id").filter(F.contains("t", F.col("q"))).select("doc_id", "item_id"))
    return found.distinct()


def _runs(n: int) -> Column:
    """Hash of each run of n of the words w."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))


def unseen_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that no part of the allowed text holds."""
    return F.array_distinct(F.filter(numbers(text), lambda n: ~F.contains(allowed, n)))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, host, title, lang and links of raw pages."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(html, r"<title>([^<]*)", 1).alias("title"),
        F.regexp_extract(html, r'<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_count(html, F.lit("<a href=")).cast("long").alias("n_links"),
    )
