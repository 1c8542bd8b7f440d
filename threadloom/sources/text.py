"""Plain text as messages: lines, blocks between empty lines, or the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(rows: DataFrame, key: str, mode: str, text: str = "text") -> DataFrame:
    """key, ordinal (of the line or block, from 1) and text; pieces without a visible character are left out."""
    if mode not in ("line", "block", "whole"):
        raise ValueError(f"no such mode: {mode}")
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    parts = {"line": F.split(t, "\n"), "block": F.split(t, r"\n[ \t]*\n+"), "whole": F.array(t)}[mode]
    out = rows.select(key, F.posexplode(parts).alias("ordinal", "text")).withColumn("ordinal", F.col("ordinal") + 1)
    return out.where(F.col("text").rlike(r"\S"))


def read_text(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """Files of path as rows of file, ordinal and text."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return blocks(files, "file", mode)
