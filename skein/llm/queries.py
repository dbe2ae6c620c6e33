"""Queries over the test tables, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat_format, content_dedup, decontaminate, fill_middle, html_text, mixing, ngram_join, pii, quality_model, quality_rules, secret_scan, sql, toxicity, turn_repair
from skein.llm.common import table
from skein.operators.work import saved

ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_model.fold_of(3)
    out = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", "predicted", "n_passages")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality_model.fold_of(5)
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=fold != 0)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted", "n_hits")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat_format.format_chats(chats)
    read = formatted.select("conv_id", "formatted", chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"))
    line = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _digest(spans: Column) -> Column:
    return F.sha2(secret_scan.spans_text(spans), 256)


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    order = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    every = F.sort_array(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return found.select("doc_id", *[_count(k) for k in ORDER], _digest(F.col("base")).alias("base_sha256"), secret_scan.spans_text(every).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    every = F.sort_array(F.concat("base", "extra"))
    told = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["verdict"], s["owners"].cast("string"), s["repositories"].cast("string"))), ",")
    return found.select("doc_id", *[_count(k) for k in secret_scan.BASE], _digest(F.col("base")).alias("base_sha256"), secret_scan.spans_text(every).alias("spans"), told.alias("verdicts"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = saved(mixing.measured(table(spark, sf_dir, "documents")).drop("doc"))
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality_rules.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    chats = turn_repair.damaged(given)
    plans = saved(turn_repair.plans(chats))
    texts = turn_repair.digests(turn_repair.repaired(chats, plans)).withColumnRenamed("conv_id", "id")
    every = given.select("conv_id").distinct()
    found = every.join(plans.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_jaccard_join, op2_quality_model, op3_toxicity, op4_decontaminate, op5_chat_format, op6_pii, op7_secret_scan, op8_html_text, op9_mixing, op10_quality_rules, op11_turn_repair, op12_fill_middle, op13_content_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
