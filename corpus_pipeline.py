"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), docs read back from the files that the stage before it wrote, and returns
the columns of docs, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, mixing, ngram_join, quality_rules, secret_scan
from skein.llm.common import table
from skein.operators.work import discard, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines and rejects documents by the quality rules. Null, empty and short texts are rejected."""
    return quality_rules.cleaned(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked by five-word shingles at 0.8 or more.

    Of repeated rows and of equal texts one stays, whatever their ids; texts without words all stay.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark. Null and empty texts contain none; an empty benchmark drops none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the documents' texts; n_chars follows. Null and empty texts stay, and no row goes."""
    return secret_scan.without_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as its source's target asks for; a null source is a source, texts without words go."""
    return mixing.emit_copies(mixing.mix_sources(mixing.measured(docs)))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("secret_scan", secret_stage),
    ("mixing", mixing_stage),
]

#: Not SQL: which line fails and which document is a near copy of which take too many steps for one statement.
#: test_run_equals_brute_force has every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage wrote on its way is deleted when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if at:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
