"""From documents to token files in five stages, each written as Parquet and read again as the next one's documents.

1. Quality rules: failing lines go, documents that are rejected go.
2. MinHash near-dedup: the first document of each class stays.
3. Benchmark decontamination: documents with a match go.
4. Mixing: sources are repeated or thinned to weights by the square root of their size, and shuffled.
5. Token files: the mix in its shuffled order as sequences of token ids; a row for each document as read back.

All stages but the last return the columns of documents. n_chars follows the text. Null texts and empty tables are as the
operators define them: a null text has no words and goes in the first stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, near_dedup, quality_rules, source_mix, token_files
from threadloom.llm.common import materialize, new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.keep_good(docs.select(*COLUMNS))
    return judged.select("doc_id", F.col("cleaned_text").alias("text"), "lang", "source", F.length("cleaned_text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.clean(docs.select(*COLUMNS), benchmark)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, copy, and as the files have them start, n_tokens and ids_crc32. Copies of a document lie apart: the order is that of a hash of document and copy."""
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")
    numbered = docs.select("doc_id", "text", (F.row_number().over(again) - 1).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(source_mix.MixTarget().seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    keyed = numbered.select(F.concat_ws(":", order, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")).alias("key"), "text")
    manifest = token_files.write_sequences(keyed, "key", "text", new_folder(spark, "tokens"), token_files.default_format())
    parts = F.split("key", ":")
    read = token_files.read_documents(manifest, "string")
    return read.select(F.expr("try_cast(split(key, ':')[1] AS bigint)").alias("doc_id"), F.get(parts, 2).cast("int").alias("copy"), "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mixing),
    ("token_files", tokens),
]

#: Similarity joins, edit distances and byte-pair encoding are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
