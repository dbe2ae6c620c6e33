"""Resolution of mentions to nodes in stages: label, identifier, synonym, vector, shared words; what stays open is asked for and
answered by a table of decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import content, token_jaccard, with_tokens
from skein.operators.search import ABSENT, _units, first_places, slices, ten_thousandths
from skein.operators.work import saved

#: Scores of the stages, floors of vectors and words, candidates that are named, and what looks like an identifier.
SCORES = {"exact": 1.0, "xref": 1.0, "synonym": 0.95}
EMBED_ACCEPT, EMBED_MARGIN, CANDIDATE_FLOOR, LEXICAL_FLOOR, TOP = 0.85, 0.05, 0.45, 0.34, 5
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_.]*:\S+$"
#: Bytes of a block of query vectors, which goes to all tasks.
BLOCK_BYTES = 1 << 20


def _plain(words: str) -> Column:
    return F.array_join(words, " ")


def _keys(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stage, k, id), distinct, of nodes (id, label, synonyms, xrefs), and the words (id, w) of each of their texts."""
    none = F.array().cast("array<string>")
    texts = nodes.select("id", F.posexplode(F.concat(F.array("label"), F.coalesce("synonyms", none))).alias("pos", "text")).filter("text is not null")
    worded = saved(with_tokens(texts, F.col("text"), "w").select("id", "pos", "w"))
    ids = nodes.select("id", F.explode(F.concat(F.array("id"), F.coalesce("xrefs", none))).alias("x"))
    parts = [
        worded.filter("pos = 0").select(F.lit("exact").alias("stage"), _plain("w").alias("k"), "id"),
        ids.select(F.lit("xref"), F.upper("x"), "id"),
        worded.select(F.lit("synonym"), F.array_join(content(F.col("w")), " "), "id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).filter("k <> ''").distinct(), worded.select("id", content(F.col("w")).alias("w"))


def nearest_nodes(queries: DataFrame, vectors: DataFrame, most: int = TOP) -> DataFrame:
    """(mention, id, score): the `most` nodes nearest to each query (mention, embedding) by the best cosine of their vectors (id,
    embedding), in four decimals, ties by id.

    Queries go out in blocks of bounded size. A task takes the best of each node in a few vectors at a time and keeps its best few nodes a query; a node that is
    among the best of all is so where its best vector is, so none is lost.
    """
    spark, out = vectors.sparkSession, None
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    for names, matrix in _blocks(queries):
        sent = spark.sparkContext.broadcast((names, matrix))

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            yield nearest_of(*sent.value, batches, most)

        found = rows.mapInPandas(best, "mention string, id string, s long")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "mention string, id string, score double")
    once = out.groupBy("mention", "id").agg(F.max("s").alias("s"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("s"), "id"))).filter(F.col("r") <= most)
    return ranked.select("mention", "id", (F.col("s") / 10000).alias("score"))


def nearest_of(names: list[str], matrix: np.ndarray, batches: Iterator[pd.DataFrame], most: int) -> pd.DataFrame:
    """The `most` nodes of the batches (id, embedding) nearest to each query, by their best vectors: (mention, id, s), s the cosine in ten-thousandths."""
    kept = pd.DataFrame({"q": np.empty(0, np.int64), "id": np.empty(0, object), "s": np.empty(0, np.int64)})
    for b in batches:
        b = b[b["embedding"].notna()].sort_values("id", kind="stable")
        named, v = b["id"].to_numpy(), _units(b["embedding"].tolist(), matrix.shape[1])
        for part in slices(len(v), len(names)):
            ids, first = np.unique(named[part], return_index=True)
            scores = np.maximum.reduceat(ten_thousandths(matrix, v[part]), first, axis=1)
            top = first_places(scores, most)
            s, q = np.take_along_axis(scores, top, 1), np.repeat(np.arange(len(names)), top.shape[1]).reshape(top.shape)
            # What falls behind the last of a full list needn't be merged.
            last = np.full(len(names), ABSENT)
            full = kept.groupby("q")["s"].agg(["size", "min"])
            full = full[full["size"] >= most]
            last[full.index.to_numpy(np.int64)] = full["min"]
            new = (s >= last[:, None]) & (s > ABSENT)
            if new.any():
                kept = pd.concat([kept, pd.DataFrame({"q": q[new], "id": ids[top[new]], "s": s[new]})])
                kept = kept.groupby(["q", "id"], as_index=False)["s"].max().sort_values(["q", "s", "id"], ascending=[True, False, True]).groupby("q").head(most)
    return pd.DataFrame({"mention": np.array(names, object)[kept["q"].to_numpy(np.int64)], "id": kept["id"], "s": kept["s"]})


def _blocks(queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Names and unit vectors of the queries, one block in the driver at a time."""
    held: list = []
    for row in queries.select("mention", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding is not null").toLocalIterator():
        held.append((row["mention"], row["embedding"]))
        if len(held) * 8 * max(len(held[0][1]), 1) >= BLOCK_BYTES:
            yield [m for m, _ in held], _units([v for _, v in held], len(held[0][1]))
            held = []
    if held:
        yield [m for m, _ in held], _units([v for _, v in held], len(held[0][1]))


def shared_words(mentions: DataFrame, worded: DataFrame) -> DataFrame:
    """(mention, id, score): nodes whose texts (id, w) have at least LEXICAL_FLOOR of their words and the mention's (mention, mw) in common.

    Two sets that have so much in common share one of the rarest words of either, so only as many of each as that takes are looked up:
    words that most texts have meet only in texts that have few others.
    """
    every = worded.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))

    def rare(rows: DataFrame, key: list[str], words: str) -> DataFrame:
        each = rows.select(*key, F.array_distinct(words).alias("s")).withColumn("row", F.monotonically_increasing_id()).filter(F.size("s") > 0)
        each = saved(each)
        ranked = each.select("row", F.explode("s").alias("t"), F.size("s").alias("n")).join(every, "t", "left")
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("df", F.lit(0)), "t")))
        return ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * LEXICAL_FLOOR - 1e-9) + 1).select("row", "t").join(each, "row")

    one, two = rare(mentions, ["mention"], "mw"), rare(worded.distinct(), ["id"], "w")
    met = one.select("mention", F.col("s").alias("a"), "t").join(two.select("id", F.col("s").alias("b"), "t"), "t")
    return met.withColumn("score", token_jaccard(F.col("a"), F.col("b"))).filter(F.col("score") >= LEXICAL_FLOOR).groupBy("mention", "id").agg(F.max("score").alias("score"))


def question_key(mention: Column, candidates: Column) -> Column:
    """The key of a decision: a hash of the mention and its candidates, sorted."""
    return F.sha2(F.to_json(F.struct(mention.alias("mention"), F.array_sort(candidates).alias("candidates"))), 256)


def resolve(mentions: DataFrame, nodes: DataFrame, queries: DataFrame | None = None, vectors: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """Per different mention of mentions (mention): node_id, method, score, candidates (an array of ids) and key.

    nodes: id, label, synonyms, xrefs. The first of these stages that knows a mention decides if it knows one node, and asks if it knows several:
    exact (all words of the label), xref (an identifier, whatever its case), synonym (words but fillers, of label and synonyms). Else, with a
    vector (queries: mention, embedding; vectors: id, embedding), the nearest node decides from EMBED_ACCEPT on with EMBED_MARGIN to the next; from
    CANDIDATE_FLOOR on the nearest are asked about; below, it is none. Without a vector nodes that share words are asked about. An answer is looked up in
    decisions (key, node_id); it counts if it names a candidate (method llm), else the method is none and key says what to ask. Candidates are the first TOP by score and id.
    """
    asked = saved(with_tokens(mentions.select("mention").filter("mention is not null").distinct(), F.col("mention"), "mw"))
    keyed, worded = _keys(nodes)
    trimmed = F.trim("mention")
    pairs = F.array(
        F.struct(F.lit(0).alias("at"), F.lit("exact").alias("stage"), _plain("mw").alias("k")),
        F.struct(F.lit(1).alias("at"), F.lit("xref").alias("stage"), F.when(F.rlike(trimmed, F.lit(IDENTIFIER)), F.upper(trimmed)).otherwise("").alias("k")),
        F.struct(F.lit(2).alias("at"), F.lit("synonym").alias("stage"), F.array_join(content(F.col("mw")), " ").alias("k")),
    )
    looked = asked.select("mention", F.explode(pairs).alias("p")).select("mention", "p.*").filter("k <> ''")
    counts = keyed.groupBy("stage", "k").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    hit = saved(looked.join(counts, ["stage", "k"]).groupBy("mention").agg(F.min_by(F.struct("stage", "k", "n", "only"), "at").alias("b")).select("mention", "b.*"))
    score = F.coalesce(*[F.when(F.col("stage") == s, F.lit(v)) for s, v in SCORES.items()])
    # Of a key that many nodes have only the first few ids are ever named.
    few = keyed.withColumn("r", F.row_number().over(Window.partitionBy("stage", "k").orderBy("id"))).filter(F.col("r") <= TOP)
    several = hit.filter("n > 1").join(few, ["stage", "k"]).select("mention", "id", score.alias("score"))
    left = saved(asked.join(hit.select("mention"), "mention", "left_anti"))
    empty = left.sparkSession.createDataFrame([], "mention string, id string, score double")
    near = saved(nearest_nodes(queries.join(left.select("mention"), "mention", "left_semi"), vectors, TOP + 1)) if queries is not None and vectors is not None else empty
    words = shared_words(left.join(near.select("mention").distinct(), "mention", "left_anti").select("mention", content(F.col("mw")).alias("mw")), worded)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "id")))
    tops = ranked.groupBy("mention").agg(F.max(F.when(F.col("r") == 1, F.col("id"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("next"))
    margin = F.round(F.col("best") - F.coalesce("next", F.lit(0.0)), 4)
    taken = tops.filter((F.col("best") >= EMBED_ACCEPT) & (margin >= EMBED_MARGIN))
    open_near = near.join(tops.filter(F.col("best") >= CANDIDATE_FLOOR).join(taken.select("mention"), "mention", "left_anti").select("mention"), "mention", "left_semi")
    every = several.unionByName(open_near).unionByName(words)
    place = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "id"))
    listed = every.withColumn("r", place).filter(F.col("r") <= TOP).groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("c"))
    question = listed.select("mention", "c", F.transform("c", lambda x: x["id"]).alias("ids")).withColumn("key", question_key(F.col("mention"), F.col("ids")))
    known = decisions if decisions is not None else left.sparkSession.createDataFrame([], "key string, node_id string")
    told = question.join(known.select("key", F.col("node_id").alias("said")).dropDuplicates(["key"]), "key", "left").withColumn("fits", F.coalesce(F.array_contains("ids", F.col("said")), F.lit(False)))
    at = F.get(F.filter("c", lambda x: x["id"] == F.col("said")), F.lit(0))["score"]
    none = F.array().cast("array<string>")
    parts = [
        hit.filter("n = 1").select("mention", F.col("only").alias("node_id"), F.col("stage").alias("method"), score.alias("score"), none.alias("candidates"), F.lit("").alias("key")),
        taken.select("mention", "first", F.lit("embedding"), "best", none, F.lit("")),
        told.select("mention", F.when(F.col("fits"), F.col("said")), F.when(F.col("fits"), "llm").otherwise("none"), F.when(F.col("fits"), at).otherwise(0.0), "ids", "key"),
    ]
    found = saved(parts[0].union(parts[1]).union(parts[2]))
    rest = asked.join(found.select("mention"), "mention", "left_anti").select("mention", F.lit(None).cast("string").alias("node_id"), F.lit("none").alias("method"), F.lit(0.0).alias("score"), none.alias("candidates"), F.lit("").alias("key"))
    return found.unionByName(rest)
