"""Search and resolution of names, by text and by vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.numeric import round4
from skein.functions.text import content, token_jaccard, with_tokens


def lexical(nodes: DataFrame, query: str, most: int | None = 50) -> DataFrame:
    """Nodes by how their label meets the query: 1 equal, 0.95 by match key, 0.8 prefix, 0.75 phrase, from 0.4 by shared words."""
    asked = with_tokens(nodes.sparkSession.range(1), F.lit(query), "asked").select("asked")
    worded = with_tokens(nodes.select("id", "label"), F.col("label"), "words").join(F.broadcast(asked))
    key, q = F.array_join("words", " "), F.array_join("asked", " ")
    overlap = token_jaccard(F.col("words"), F.col("asked"))
    phrase = F.contains(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    same = F.array_join(content(F.col("words")), " ") == F.array_join(content(F.col("asked")), " ")
    score = F.when(key == q, 1.0).when(same, 0.95).when((F.length(q) >= 3) & F.startswith(key, q), 0.8).when(phrase, 0.75).when(overlap >= 0.5, 0.4 + 0.3 * overlap)
    hits = worded.withColumn("score", score).filter("score is not null").select("id", "label", round4(F.col("score")).alias("score"))
    return hits if most is None else hits.orderBy(F.desc("score"), "id").limit(most)


def by_key(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """mentions (mention) resolved by match key: node_id if exactly one node has the key, and the number that have."""
    key = F.array_join(content(F.col("words")), " ").alias("key")
    keyed = with_tokens(nodes, F.col("label"), "words").groupBy(key).agg(F.count_distinct("id").alias("n"), F.min("id").alias("node_id"))
    out = with_tokens(mentions, F.col("mention"), "words").select("mention", key).join(keyed, "key", "left")
    return out.select("mention", F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), F.coalesce("n", F.lit(0)).alias("n"))


def nearest(queries: DataFrame, vectors: DataFrame, most: int = 5, block: int = 2000) -> DataFrame:
    """The vectors (vec_id, embedding) nearest to each query by cosine, with the margin to the next one: (query_id, vec_id,
    score, rank, margin).

    queries (vec_id, embedding) is a stated set. It goes out in blocks of `block`; a task multiplies each of its batches of
    vectors, SCORE_BYTES of scores at a time, with the block and keeps its best few a query, so what is shuffled is a few rows a query and task.
    """
    spark, out = vectors.sparkSession, None
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    for ids, matrix in _blocks(queries, block):
        sent = spark.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            yield nearest_of(*sent.value, batches, most + 1)

        found = rows.mapInPandas(best, "query_id long, vec_id long, s long")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, s long")
    scored = out.select("query_id", "vec_id", (F.col("s") / 10000).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most + 1)
    margin = F.col("score") - F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return ranked.withColumn("margin", F.floor(F.coalesce(margin, F.col("score")) * 10000 + 0.5) / 10000).filter(F.col("rank") <= most)


def nearest_of(ids: np.ndarray, matrix: np.ndarray, batches: Iterator[pd.DataFrame], most: int) -> pd.DataFrame:
    """The `most` vectors of the batches (vec_id, embedding) nearest to each query, itself excepted: (query_id, vec_id, s), s the cosine in ten-thousandths."""
    kept_s, kept_id = np.full((len(ids), most), ABSENT, np.int64), np.full((len(ids), most), np.iinfo(np.int64).max)
    for b in batches:
        b = b.sort_values("vec_id")
        named, v = b["vec_id"].to_numpy(np.int64), _units(b["embedding"].tolist(), matrix.shape[1])
        for part in slices(len(v), len(ids)):
            scores = ten_thousandths(matrix, v[part])
            scores[ids[:, None] == named[part][None, :]] = ABSENT
            top = first_places(scores, most)
            s, i = np.hstack([kept_s, np.take_along_axis(scores, top, 1)]), np.hstack([kept_id, named[part][top]])
            order = np.lexsort((i, -s), axis=1)[:, :most]
            kept_s, kept_id = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    known = kept_s > ABSENT
    return pd.DataFrame({"query_id": np.repeat(ids, most)[known.ravel()], "vec_id": kept_id[known], "s": kept_s[known]})


#: Bytes of scores that a task has at once, and what stands for a score that isn't there.
SCORE_BYTES, ABSENT = 4 << 20, -(1 << 20)


def slices(n: int, queries: int) -> Iterator[slice]:
    """Ranges of n vectors whose scores with so many queries fit into SCORE_BYTES."""
    step = max(SCORE_BYTES // (8 * max(queries, 1)), 1)
    return (slice(at, at + step) for at in range(0, n, step))


def ten_thousandths(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of all rows as integers of ten-thousandths, ABSENT where one isn't finite."""
    s = np.floor(np.einsum("qd,vd->qv", matrix, vectors) * 10000 + 0.5)
    return np.where(np.isfinite(s), s, ABSENT).astype(np.int64)


def first_places(scores: np.ndarray, most: int) -> np.ndarray:
    """The columns of the `most` highest integers of each row, of equal ones the first."""
    width = scores.shape[1]
    most = min(most, width)
    # The column counts down in the lower part of one integer, so no two are equal and no row has to be sorted whole.
    key = scores * width + np.arange(width - 1, -1, -1)
    return width - 1 - np.mod(np.partition(key, width - most, axis=1)[:, width - most :], width)


def _units(rows: list, width: int) -> np.ndarray:
    """Rows as vectors of length one; those of another width, and zero ones, as zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r) == width:
            v = np.asarray(r, np.float64)
            norm = np.sqrt(v @ v)
            out[i] = v / norm if norm > 0 else 0.0
    return out


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, one block in the driver at a time."""
    held: list = []
    for row in queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).toLocalIterator():
        held.append((row["vec_id"], row["embedding"]))
        if len(held) == block:
            yield np.array([i for i, _ in held]), _units([v for _, v in held], len(held[0][1] or []))
            held = []
    if held:
        yield np.array([i for i, _ in held]), _units([v for _, v in held], len(held[0][1] or []))


def texts_of(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, ord, text): the label of each node and then its synonyms (id, ord, text)."""
    return nodes.select("id", F.lit(0).alias("ord"), F.col("label").alias("text")).unionByName(synonyms.select("id", "ord", "text"))


def lexical_texts(texts: DataFrame, query: str, most: int = 50) -> DataFrame:
    """As lexical(), over all texts of a node: the best of them, ties by the first text."""
    scored = lexical(texts.withColumnRenamed("text", "label").withColumn("node", F.col("id")), query, None)
    best = scored.groupBy("id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(most)


def semantic(hits: DataFrame, near: DataFrame, floor: float = 0.45, factor: float = 0.8) -> DataFrame:
    """Hits by vector (query_id, vec_id, score) of at least floor, at a factor, for the queries without a lexical hit (query_id)."""
    kept = near.filter(F.col("score") >= floor).join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return kept.select("query_id", "vec_id", (F.floor(F.col("score") * factor * 10000 + 0.5) / 10000).alias("score"))


def interleaved(lists: DataFrame, most: int) -> DataFrame:
    """Items of ranked lists (list_no, rank, item) in turn, the first of each list, then the second, ...: each item once, at
    its first place, at most `most`: (item, place)."""
    first = lists.groupBy("item").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    return first.orderBy("at.rank", "at.list_no", "item").limit(most).withColumn("place", F.row_number().over(Window.orderBy("at.rank", "at.list_no", "item"))).select("item", "place")
