"""Target-distribution importance resampling: documents are drawn by how much more likely their words are in a target set.

Features are all runs of up to `longest` consecutive words, hashed into buckets. First pass: each task counts its features
by np.bincount into one vector as long as there are buckets, and a tree of additions merges the vectors of the corpus and of
the target. Second pass: the gains of the buckets, a vector of bounded length, go to all tasks, and a document's weight is
the sum of its features' gains (np.bincount with weights). A Gumbel number hashed from the key is added, and the highest
scores of documents with enough words are drawn: a draw without replacement in proportion to the weights' exponentials.

Scores are ranked without a task that sees them all: rows are dealt by ranges of score, key and row, numbered within their
range and shifted by the sizes of the ranges before, one number a range.

Defined results: a null or empty text has no words, weight 0 and is never drawn (it counts in no bucket); a null key hashes
as an empty text and comes last among equal scores; rows that are equal in score and key get ranks of their own, in any
order, so that results are equal but for which of them is which; extra columns pass through, columns named as the
operator's own are replaced; an empty corpus gives no rows; an empty target is one of no features. Texts are read whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bare_lower, joined_words, materialize, spans_of, sql_crc32, text_slices

#: Bytes of a lower-cased text that belong to a word: digits, a-z, and all of characters beyond ASCII.
INSIDE = np.zeros(256, dtype=bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
#: Longer features than this are hashed one by one.
LONG = 64
ADDED = ("n_words", "n_features", "weight")


@dataclass(frozen=True)
class ResampleConfig:
    buckets: int = 10_000
    #: Words in the longest feature.
    longest: int = 1
    #: Documents drawn, in percent of those with least_words and more.
    percent: int = 10
    least_words: int = 20
    seed: str = "2024"


def crc_table() -> np.ndarray:
    """The CRC-32 of each byte, by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


_CRC = crc_table()


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, for all spans a byte at a time; the few long ones by zlib."""
    length = end - start
    order = np.argsort(-np.minimum(length, LONG + 1), kind="stable")
    sized, at = length[order], start[order]
    long_ones = int(np.searchsorted(-sized, -LONG, side="left"))
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(int(sized[long_ones]) if long_ones < len(sized) else 0):
        n = int(np.searchsorted(-sized[long_ones:], -i, side="left")) + long_ones
        now = crc[long_ones:n]
        crc[long_ones:n] = _CRC[(now ^ data[at[long_ones:n] + i]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    crc[:long_ones] = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(at[:long_ones], sized[:long_ones], strict=True)]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(data: np.ndarray, offsets: np.ndarray, config: ResampleConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words, rows of the features, and the features' buckets."""
    low = bare_lower(data)
    start, end, row = spans_of(INSIDE[low], offsets)
    rows, buckets = [row], [crc_spans(low, start, end) % np.uint32(config.buckets)]
    if config.longest > 1 and len(row):
        text, at, _ = joined_words(low, start, end, row, len(offsets) - 1)
        close = at + (end - start)
        for n in range(2, config.longest + 1):
            whole = row[n - 1 :] == row[: 1 - n]
            rows.append(row[: 1 - n][whole])
            buckets.append(crc_spans(text, at[: 1 - n][whole], close[n - 1 :][whole]) % np.uint32(config.buckets))
    return row, np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


def bucket_counts(rows: DataFrame, text: str = "text", config: ResampleConfig = ResampleConfig()) -> np.ndarray:
    """Features of all texts by bucket: a vector a partition, merged by a tree so that the driver adds few of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                total += np.bincount(features(data, offsets, config)[2], minlength=config.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = rows.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, dtype=np.int64))
    n = vectors.getNumPartitions()
    return vectors.treeReduce(np.add, depth=2 if n <= 1000 else 3) if n else np.zeros(config.buckets, dtype=np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of the smoothed share in the target over that in the corpus, in thousandths, rounded down."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """The rows of docs with n_words, n_features and weight added."""
    base = docs.drop(*[c for c in ADDED if c != text])
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED]])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A sum of gains is exact in a double up to 2 ** 53.
        value = shared.value.astype(np.float64)
        for batch in batches:
            found = []
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                word_row, row, bucket = features(data, offsets, config)
                found.append([np.bincount(word_row, minlength=hi - lo), np.bincount(row, minlength=hi - lo), np.bincount(row, weights=value[bucket], minlength=hi - lo)])
            sums = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, *ADDED])

    return base.mapInArrow(judge, schema)


def gumbel(key: Column, seed: str) -> Column:
    """A Gumbel number in thousandths, rounded down, hashed from the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, key: str, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """The rows of scored (n_words, score and others) with rank: 1, 2, 3... for those that are drawn, null for the others."""
    kept = [c for c in scored.columns if c not in ("rank", "_row")]
    # The row's number is part of the range's bound, so that a key or score that repeats without end is still dealt out.
    table = materialize(scored.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_row", F.monotonically_increasing_id()), "resample-scores")
    able = F.col("n_words") >= config.least_words
    order = [F.desc("score"), F.col(f"`{key}`").asc_nulls_last(), F.asc("_row")]
    placed = materialize(table.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    # monotonically_increasing_id is the partition's number above 33 bits of the row's place in it.
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # as many rows as partitions
    drawn = placed.agg(F.floor(F.count("*") * config.percent / 100).alias("n")).first().n
    rank = F.col("_before") + F.col("_at").bitwiseAND(2**33 - 1) + 1
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= int(drawn), rank))
    rest = table.where(~able | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("bigint"))
    return numbered.select(*[F.col(f"`{c}`") for c in kept], "rank").unionByName(rest.select(*[F.col(f"`{c}`") for c in kept], "rank"))


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", config: ResampleConfig = ResampleConfig(), keep_text: bool = True) -> DataFrame:
    """The rows of docs with n_words, n_features, weight and score; target has a column of the same name for its texts."""
    gain = gains(bucket_counts(docs, text, config), bucket_counts(target, text, config))
    weighed = weigh(docs, gain, text, config)
    out = weighed if keep_text else weighed.drop(text)
    return out.withColumn("score", F.col("weight") + gumbel(F.col(f"`{key}`"), config.seed))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """The documents that are drawn, with all their columns, n_words, n_features, weight, score and rank."""
    return ranked(score(docs, target, key, text, config), key, config).where("rank IS NOT NULL")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those like the benchmark's texts drawn first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    out = ranked(score(docs, target, keep_text=False), "doc_id")
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same in DuckDB.
OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT {_WORDS} AS words FROM benchmark),
v AS (SELECT DISTINCT unnest(words) AS word FROM (SELECT words FROM d UNION ALL SELECT words FROM b)),
h AS (SELECT word, {sql_crc32("word")} % 10000 AS bucket FROM v),
s AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) JOIN h USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(words) AS word FROM d) JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM r) THEN place END AS rank, n_features AS n_words FROM x LEFT JOIN r USING (doc_id)
"""
