"""Files of attachments, found by their paths in a folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str) -> DataFrame:
    """resolved_path (without its scheme), actual_bytes and sha256 of every file under root. A file is hashed where it is read;
    files of no bytes are not listed by Spark's reader, so an attachment that is one counts as missing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", "^[a-zA-Z0-9+.-]+:(//[^/]*(?=/))?", "").alias("resolved_path"), F.col("length").alias("actual_bytes"), F.sha2("content", 256).alias("sha256"))


def resolve(attachments: DataFrame, found: DataFrame, root: str) -> DataFrame:
    """attachments: attachment_id, source_path, filename. The stated path is sought as it stands, then what follows
    `attachments` in it (or, if it is relative, all of it) under the root. resolution_status: resolved, missing or no_path."""
    base = root.rstrip("/")
    path = F.replace(F.coalesce(F.nullif("source_path", F.lit("")), F.nullif("filename", F.lit(""))), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split("_path", "/"), lambda p: (p != "") & (p != "."))
    at = F.array_position(F.transform(parts, F.lower), "attachments").cast("int")
    after = F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0))), "/")
    relative = ~F.col("_path").startswith("/") & ~F.col("_path").startswith("~")
    under = F.when((at > 0) & (after != ""), after).when(relative, F.array_join(parts, "/"))
    named = attachments.withColumn("_path", path).withColumn("_tries", F.array(F.col("_path"), F.concat(F.lit(base + "/"), under)))
    tries = named.select("attachment_id", F.posexplode("_tries").alias("_try", "resolved_path")).where("resolved_path IS NOT NULL")
    first = Window.partitionBy("attachment_id").orderBy("_try")
    hit = tries.join(found, "resolved_path").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_try")
    status = F.when(F.col("_path").isNull(), "no_path").when(F.col("sha256").isNull(), "missing").otherwise("resolved")
    return named.join(hit, "attachment_id", "left").select(*attachments.columns, "resolved_path", "actual_bytes", "sha256", status.alias("resolution_status"))
