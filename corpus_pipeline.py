"""From raw documents to packed sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read back, so a
failed stage starts again from its input.

Defined cases: null, empty and wordless texts fall at the base rules; documents of any length
pass through whole; a null doc_id is kept and counts as larger than all others wherever ids are
compared; of rows repeated with their id, and of near copies, one stays; a text that is all
repeated passages stays as an empty document; an empty table of documents gives no sequences, an
empty benchmark drops nothing; further columns of documents, of any name, pass through to the
last stage unchanged, but for n_chars, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagwise.llm import decontam, packing, quality_rules, simhash_dedup, suffix_dedup
from lagwise.llm.shared import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or their group's adaptive fences reject."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash_dedup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings that a document with a smaller id also has."""
    return suffix_dedup.strip(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("sequences", sequences)]

#: Near-duplicate components, alignment and best-fit have no SQL; tests/llm/test_pipeline.py compares run() with a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
