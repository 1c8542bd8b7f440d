"""Mixing sources to target weights: Poisson replication. DataFrame functions only.

Every document gets a count from a Poisson distribution whose mean is its source's target repetition rate: the inverse
of the distribution at a number in [0, 1) that is hashed from the document and a seed. The document is exploded by its
count and the copies are dealt over the partitions by a hashed key and sorted by it, which shuffles them globally.

Defined results: a null source is a source of its own; a null or empty text has size 0, and where a whole source has
size 0 its rate is 1; rows equal in every column get equal keys and so equal counts; a null key hashes as an empty
string; extra columns pass through, columns named as the operator's own are replaced; an empty table gives an empty
table. Sources missing from the given weights get weight 0 and so no copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Tables of so many probabilities in all are broadcast (8 MB); beyond that they are joined by a shuffle.
BROADCAST_ENTRIES = 1 << 20
#: Numbers in [0, 1) are so many hashed bits, exact in a double.
BITS = 52


@dataclass(frozen=True)
class MixTarget:
    #: Share of the mix for each source; None: in proportion to size ** exponent.
    weights: dict[str, float] | None = None
    exponent: float = 0.5
    #: Size of the mix as a multiple of the input's.
    total: float = 1.0
    #: Largest mean repetition, if there is to be one: a source that is too small for its share then stays below it.
    max_rate: float | None = None
    seed: str = "mix-1"
    own: tuple[str, ...] = field(default=("copy", "n_copies", "rate", "shuffle_key"), repr=False)


def hashed_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, BITS // 4), 16, 10).cast("bigint") / F.lit(float(2**BITS))


def source_rates(docs: DataFrame, source: str, size: Column, target: MixTarget) -> DataFrame:
    """Per source its size, its rate, and the cumulated Poisson probabilities from 0 up to where they reach 1."""
    # A row for each source, read three times: a table, so that the documents are read for it once.
    sizes = materialize(docs.groupBy(F.col(source).alias("_source")).agg(F.sum(size).alias("_size")), "source-sizes")
    if target.weights is None:
        weight = F.pow(F.col("_size").cast("double"), F.lit(target.exponent))
    else:
        given = F.create_map(*[F.lit(x) for k, v in target.weights.items() for x in (k, float(v))]) if target.weights else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(given, F.col("_source")), F.lit(0.0))
    weighted = sizes.withColumn("_weight", weight)
    whole = weighted.agg(F.sum("_size").alias("_all"), F.sum("_weight").alias("_weights"))
    wanted = F.col("_weight") / F.col("_weights") * F.lit(target.total) * F.col("_all") / F.col("_size")
    rate = F.when(F.col("_size") == 0, 1.0).when(F.col("_weights") == 0, 0.0).otherwise(wanted if target.max_rate is None else F.least(F.lit(target.max_rate), wanted))
    # Rounded, so that the order in which weights were summed can't show.
    rated = weighted.crossJoin(F.broadcast(whole)).select("_source", "_size", F.round(rate, 9).alias("rate"))
    return rated.withColumn("_least", least_count(F.col("rate"))).withColumn("_cdf", poisson_cdf(F.col("rate"), F.col("_least")))


def least_count(rate: Column) -> Column:
    """A count that no number of BITS bits falls below."""
    low = F.floor(rate - 12 * F.sqrt(rate) - 24)
    return F.when(low >= 32, low).otherwise(0).cast("bigint")


def poisson_cdf(rate: Column, least: Column) -> Column:
    """P(X <= k) for k = least, least + 1, ... up to a k that no number of BITS bits goes beyond: some 24 square roots of the rate.

    By logarithms, as exp(-rate) may be 0; that of `least` is from Stirling's series, with rate and least so combined that no
    digits cancel. The array is built in pieces of the square root of its length, so that appending doesn't copy it each time.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("bigint")
    n = least.cast("double")
    series = n - rate + n * F.log(rate / n) - 0.5 * F.log(2 * math.pi * n) - 1 / (12 * n) + 1 / (360 * n * n * n) - 1 / (1260 * n * n * n * n * n)
    log = F.when(least > 0, series).otherwise(-rate)
    piece = F.ceil(F.sqrt((top - least + 1).cast("double"))).cast("bigint")

    def add(acc: Column, k: Column) -> Column:
        now = acc.log + F.when(rate > 0, F.log(rate / k)).otherwise(-1e300)
        return F.struct(now.alias("log"), (acc.sum + F.exp(now)).alias("sum"), F.concat(acc.part, F.array(acc.sum + F.exp(now))).alias("part"))

    def add_piece(acc: Column, first: Column) -> Column:
        start = F.struct(acc.log.alias("log"), acc.sum.alias("sum"), F.array().cast("array<double>").alias("part"))
        return F.aggregate(F.sequence(first, F.least(first + piece - 1, top)), start, add, lambda x: F.struct(x.log.alias("log"), x.sum.alias("sum"), F.concat(acc.all, F.array(x.part)).alias("all")))

    start = F.struct(log.alias("log"), F.exp(log).alias("sum"), F.array(F.array(F.exp(log))).alias("all"))
    # Where counts start above 0 the sums are scaled to 1, against errors that the rate has magnified.
    return F.aggregate(F.sequence(least + 1, top, piece), start, add_piece, lambda x: F.transform(F.flatten(x.all), lambda p: F.when(least > 0, p / x.sum).otherwise(p)))


def count_at_most(table: Column, u: Column) -> Column:
    """Entries of an ascending array that are u at most, by halving."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2((F.size(table) + 1).cast("double"))).cast("int"))

    def halve(x: Column, _: Column) -> Column:
        middle = F.shiftright(x.low + x.high, 1)
        below = (x.low < x.high) & (F.get(table, middle) <= u)
        return F.struct(F.when(below, middle + 1).otherwise(x.low).alias("low"), F.when(below | (x.low >= x.high), x.high).otherwise(middle).alias("high"))

    return F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(table).alias("high")), halve, lambda x: x.low)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", target: MixTarget = MixTarget(), ordered: bool = True) -> DataFrame:
    """The rows of docs, each as often as its count says, with copy (from 0), n_copies, rate and shuffle_key added."""
    passed = [c for c in docs.columns if c not in target.own]
    docs = docs.select(*[F.col(f"`{c}`") for c in passed])
    rates = source_rates(docs, f"`{source}`", F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint"), target)
    rates = materialize(rates, "source-rates")
    held = rates.agg(F.sum(F.size("_cdf"))).first()[0] or 0
    few = held <= BROADCAST_ENTRIES
    joined = docs.join(F.broadcast(rates) if few else rates, F.col(f"`{source}`").eqNullSafe(F.col("_source")))
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    drawn = joined.withColumn("_u", hashed_unit(F.lit(target.seed), id_text)).withColumn("n_copies", (F.col("_least") + count_at_most(F.col("_cdf"), F.col("_u"))).cast("int"))
    copies = drawn.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    out = copies.select(*[F.col(f"`{c}`") for c in passed], "copy", "n_copies", "rate", F.md5(F.concat_ws("|", F.lit(target.seed), F.lit("order"), id_text, "copy")).alias("shuffle_key"))
    if not ordered:
        return out
    # The keys are uniform, so that dealing by their hash evens out hot sources; where a partition comes in the order is
    # the hash's matter, and within it the key's.
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, sources weighted by the square root of their size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "source", "text", "copy", "n_copies", F.round("rate", 6).alias("rate"), "shuffle_key")


#: The same in DuckDB.
OP4_SQL = """
WITH s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS size FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE round(pow(size::DOUBLE, 0.5::DOUBLE) / (SELECT sum(pow(size::DOUBLE, 0.5::DOUBLE)) FROM s) * (SELECT sum(size)::DOUBLE FROM s) / size::DOUBLE, 9) END AS rate FROM s),
l AS (SELECT *, CASE WHEN floor(rate - 12 * sqrt(rate) - 24) >= 32 THEN floor(rate - 12 * sqrt(rate) - 24)::BIGINT ELSE 0 END AS least FROM r),
p AS (SELECT source, rate, least, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + k * ln(rate) - lgamma(k + 1)) END AS p FROM (SELECT *, unnest(range(least, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM l)),
c AS (SELECT source, rate, least, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.doc_id, u.source, u.text, any_value(c.rate) AS rate, (any_value(c.least) + count(*) FILTER (WHERE c.cdf <= u.u))::INTEGER AS n_copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY u.doc_id, u.source, u.text, u.u)
SELECT doc_id, source, text, copy::INTEGER AS copy, n_copies, round(rate, 6) AS rate, md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM n WHERE n_copies > 0)
"""
