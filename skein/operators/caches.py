"""Content-addressed caches as tables: keys hashed from what an answer depends on, the newest row of a key, upserts that touch few files.

A cache is a folder of Parquet partitioned by the first hex digits of the key; its rows have key, body (an entry as JSON) and made_at.
An upsert reads and rewrites only the buckets with a new or newer row, so a run without news writes nothing. Buckets are replaced when
the job commits; a lost executor costs a task. Of two writers at once the later wins a bucket. A null key or body is no row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import with_tokens
from skein.operators.work import discard, saved

ROWS = "key string, body string, made_at timestamp"
#: Versions of the prompts, which keys are hashed with, and JSON's short escapes.
DECISION_PROMPT, CLAIM_PROMPT = "reconcile-v1", "extract-v1"
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def python_json(text: Column) -> Column:
    """A text as a JSON string of ASCII, as Python's json.dumps writes it; what is beyond 16 bits is a pair of escapes."""

    def letter(c: Column) -> Column:
        out = F.when((c >= " ") & (c <= "~"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1"))
        for raw, short in SHORT.items():
            out = F.when(c == raw, F.lit(short)).otherwise(out)
        return out

    simple = F.regexp_like(text, F.lit(r"^[ !#-\[\]-~]*$")) & ~F.contains(text, F.lit("\n"))
    return F.concat(F.lit('"'), F.when(simple, text).otherwise(F.array_join(F.transform(F.split(text, ""), letter), "")), F.lit('"'))


def python_list(*parts: Column) -> Column:
    """JSON values as a list, parted as json.dumps does."""
    return F.concat(F.lit("["), F.array_join(F.array(*parts), ", "), F.lit("]"))


def with_embedding_key(df: DataFrame, model: Column, text: Column, name: str = "key") -> DataFrame:
    """df with the key of a text's vector: of the model and the text in its normal form."""
    return with_tokens(df, text, "_words").withColumn(name, F.sha2(F.concat(model, F.lit("\n"), F.array_join("_words", " ")), 256)).drop("_words")


def decision_key(model: Column, mention: Column, candidates: Column) -> Column:
    """Key of a decision between candidates (an array of ids, in any order) for a mention."""
    ids = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(candidates), python_json), ", "), F.lit("]"))
    return F.sha2(python_list(python_json(model), F.lit(f'"{DECISION_PROMPT}"'), python_json(mention), ids), 256)


def claims_key(model: Column, publication: Column, vocabulary: Column) -> Column:
    return F.sha2(python_list(python_json(model), F.lit(f'"{CLAIM_PROMPT}"'), python_json(publication), python_json(vocabulary)), 256)


def newest(rows: DataFrame) -> DataFrame:
    """The newest row of each key, ties by body."""
    whole = rows.filter("key is not null and body is not null")
    return whole.groupBy("key").agg(F.max(F.struct("made_at", "body")).alias("r")).select("key", "r.body", "r.made_at")


def load(spark: SparkSession, path: str, entry: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a cache, none where there is no folder yet. With entry, a schema, body is parsed to its columns; rows whose body
    isn't such JSON, or lacks a required field, are left out."""
    try:
        rows = spark.read.schema(ROWS + ", bucket string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ROWS + ", bucket string")
    if entry is None:
        return rows
    parsed = rows.withColumn("e", F.from_json("body", entry, {"mode": "PERMISSIVE"})).select("key", "made_at", "e.*")
    return parsed.dropna(subset=list(required)) if required else parsed.dropna(how="all", subset=[c for c in parsed.columns if c not in ("key", "made_at")])


def missing(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of asked (key, text, pos) without a row in the cache: one a key, the first by pos, blank texts left out."""
    first = asked.filter(F.trim("text") != "").groupBy("key").agg(F.min(F.struct("pos", "text")).alias("f")).select("key", "f.text", "f.pos")
    return first.join(cache.select("key"), "key", "left_anti")


def upsert(path: str, rows: DataFrame, digits: int = 2) -> int:
    """Puts rows (key, body, made_at) into the cache at path; the newest of a key stays. Gives the number of buckets written.

    digits: hex digits of the key by which the folder is parted; it must stay the same for a cache. Take more for larger ones, so that a bucket fits a task.
    """
    spark = rows.sparkSession
    bucket = F.substring("key", 1, digits).alias("bucket")
    given = saved(newest(rows).select("*", bucket))
    held = load(spark, path)
    known = held.select("key", F.struct("made_at", "body").alias("old"))
    news = given.join(known, "key", "left").filter(F.col("old").isNull() | (F.struct("made_at", "body") > F.col("old")))
    news = saved(news.select("key", "body", "made_at", "bucket"))
    touched = [r.bucket for r in news.select("bucket").distinct().collect()]
    if touched:
        merged = newest(held.filter(F.col("bucket").isin(touched)).drop("bucket").unionByName(news.drop("bucket")))
        whole = saved(merged.select("*", bucket))
        whole.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        discard(whole)
    discard(given), discard(news)
    return len(touched)
