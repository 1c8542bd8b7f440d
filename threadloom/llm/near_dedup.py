"""MinHash near-dedup by DartMinHash.

A document is the weighted set of its shingles of five words (lower case; a text of fewer words is one shingle), weighted
by their counts. Hashed darts fall into regions of weight and rank: for each shingle and each dyadic region of weight
that its weight reaches, a Poisson process along the rank axis, seeded by shingle and region, throws darts that carry a
coordinate and a place in the region; those under the shingle's weight count. Per coordinate the earliest dart is kept.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates are
join keys.

Copies (equal word for word) are one class from the start and stand for each other. In each bucket of two and more every
document is compared with a hub: as many pairs as documents. What that leaves unlinked is compared in full (`grouped`).
Every pair that counts is verified by the exact weighted Jaccard similarity of the shingles. Components are found by
alternating stars.

Defined results: null and empty texts, and texts without a word, are alone in their class; a row with a null doc_id gets
the class of its copies and is otherwise linked to nothing; rows that share a doc_id share a class; ties go to the
smallest doc_id; extra columns are ignored by `classes` and passed through by `keep_first`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SpanHash, components, materialize, mix, signed, text_slices, word_spans

_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDedupConfig:
    shingle: int = 5
    similarity: float = 0.8
    #: Documents at the threshold share no band with probability (1 - similarity ** rows) ** bands: 6 in 100,000.
    bands: int = 32
    rows: int = 6
    #: Buckets of so many documents get their pairs as rows; larger ones are compared in blocks.
    small: int = 24
    #: Hubs of a large bucket.
    hubs: int = 3
    #: Members of a hub that one task compares.
    hub_rows: int = 2_000
    #: Documents, and bytes of their hashes, in a block of a large bucket. Rows grow with the blocks of a bucket.
    block_rows: int = 1024
    block_bytes: int = 8 << 20
    seed: int = 11

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def darts(self) -> float:
        """Darts a document expects, so that hardly a coordinate stays empty."""
        return self.coordinates * (math.log(self.coordinates) + 3)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: row, hash and count of each row's distinct shingles; two hashes of the words of each row (0: none)."""
    start, end, row = word_spans(data, offsets)
    rows = len(offsets) - 1
    content = np.zeros((2, rows), dtype=np.uint64)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), content[0], content[1]
    word = SpanHash(data)(start, end)
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    with np.errstate(over="ignore"):
        place = (np.arange(len(word)) - first[row]).astype(np.uint64)
        has = np.flatnonzero(words)
        for k in range(2):
            # A sum over words of their hash mixed with their place: equal for equal words in equal order only.
            content[k][has] = mix(np.add.reduceat(mix(word * np.uint64(2 * k + 3) + place * _K), first[has]) + words[has].astype(np.uint64))
        long = np.flatnonzero(place + np.uint64(n) <= words[row].astype(np.uint64)) if n > 1 else np.arange(len(word))
        h = np.zeros(len(long), dtype=np.uint64)
        for j in range(n):
            h = h * _K + word[long + j]
        h = mix(h)
        brief = np.flatnonzero((words > 0) & (words < n))
        h = np.concatenate([h, content[0][brief]])
    owner = np.concatenate([row[long], brief])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h))), content[0], content[1]


def dart_signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, config: NearDedupConfig) -> np.ndarray:
    """rows x coordinates: the rank of the earliest dart under the row's weights in each coordinate, as bits."""
    k = config.coordinates
    total = np.bincount(owner, weights=weight, minlength=rows)
    limit = np.where(total > 0, config.darts / np.maximum(total, 1e-12), 0.0)
    best = np.full(rows * k, np.inf)
    level = 0
    live = np.arange(len(h))
    while len(live):
        # The region of weight [low, low + width): level 0 is [0, 1), level l is [2^(l-1), 2^l).
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        live = live[weight[live] > low]
        base, most, top = owner[live] * k, limit[owner[live]], weight[live]
        rank, throw = np.zeros(len(live)), 0
        with np.errstate(over="ignore"):
            seed = mix(h[live] + np.uint64((config.seed * 4096 + level) & 0xFFFFFFFF) * _K)
        while len(seed):
            throw += 1
            with np.errstate(over="ignore"):
                dart = mix(seed + np.uint64(throw) * _K)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / width
            inside = rank < most
            if not inside.all():
                base, most, top, rank, seed, dart = (x[inside] for x in (base, most, top, rank, seed, dart))
            with np.errstate(over="ignore"):
                dart = (dart ^ (dart >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            cell = base + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            place = low + width * ((dart & np.uint64(0xFFFFFF)).astype(np.float64) / 2**24)
            if (place < top).all():
                np.minimum.at(best, cell, rank)
            else:
                under = place < top
                np.minimum.at(best, cell[under], rank[under])
        level += 1
    # A dart's rank is as good as its name.
    return best.view(np.uint64).reshape(rows, k)


SIGNATURES = "doc_id bigint, c1 bigint, c2 bigint, bands array<bigint>"


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """Each document with words: doc_id, two hashes of its words (c1, c2) and the keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.utf8_lower(batch.column(1))
            for lo, hi, data, offsets in text_slices(column):
                owner, h, count, c1, c2 = shingles(data, offsets, config.shingle)
                ids = dart_signatures(owner, h, count.astype(np.float64), hi - lo, config).reshape(hi - lo, config.bands, config.rows)
                with np.errstate(over="ignore"):
                    keys = np.arange(config.bands, dtype=np.uint64)[None, :] * _K + np.uint64(1)
                    for j in range(config.rows):
                        keys = mix(keys * _K + ids[:, :, j])
                has = np.flatnonzero(np.bincount(owner, minlength=hi - lo))
                flat = pa.array(signed(keys[has].reshape(-1)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * config.bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(has)), pa.array(signed(c1[has])), pa.array(signed(c2[has])), bands], names=["doc_id", "c1", "c2", "bands"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(sign, SIGNATURES)


def packed_shingles(docs: DataFrame, wanted: DataFrame, config: NearDedupConfig) -> DataFrame:
    """node, hashes and counts (binary) of the texts in wanted (node, doc_id, c1, c2). docs: doc_id, text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.utf8_lower(batch.column(1))
            for lo, hi, data, offsets in text_slices(column):
                owner, h, count, c1, c2 = shingles(data, offsets, config.shingle)
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                rows, texts = [], batch.column(2).slice(lo, hi - lo).to_pylist()
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    for w in texts[i]:  # the texts that are wanted under this id: one, but for repeated ids
                        if (w["c1"], w["c2"]) == (int(signed(c1)[i]), int(signed(c2)[i])):
                            rows.append((w["node"], h[a:b].tobytes(), count[a:b].astype("<u4").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["node", "hashes", "counts"])

    of_id = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("node", "c1", "c2")).alias("texts"))  # an id's own texts
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(of_id, "doc_id")
    return rows.mapInArrow(pack, "node bigint, hashes binary, counts binary")


def weighted_jaccard(h1: np.ndarray, c1: np.ndarray, h2: np.ndarray, c2: np.ndarray) -> float:
    """Of two sorted sets of hashes with counts."""
    total = float(c1.sum()) + float(c2.sum())
    if not total:
        return 0.0
    _, a, b = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    both = float(np.minimum(c1[a], c2[b]).sum())
    return both / (total - both)


def verify(pairs: DataFrame, packed: DataFrame, config: NearDedupConfig) -> DataFrame:
    """The pairs (a, b) with their similarity (s). A hub's shingles are sent once to each task that compares its members."""
    pairs = pairs.select(F.col("a").alias("hub"), F.col("b").alias("member")).distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / config.hub_rows).cast("int").alias("parts"))
    members = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "member")
    members = members.join(packed.withColumnRenamed("node", "member"), "member").select("hub", "part", "member", "hashes", "counts")
    hubs = packed.join(sizes.withColumnRenamed("hub", "node"), "node").select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("member"), "hashes", "counts")
    together = hubs.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("member"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h1, c1 = None, np.zeros(0, np.uint64), np.zeros(0, "<u4")
        for batch in batches:
            a, b, s = [], [], []
            hub, member, hashes, counts = (batch.column(n) for n in ("hub", "member", "hashes", "counts"))
            for i in range(batch.num_rows):
                h, c = np.frombuffer(hashes[i].as_buffer(), dtype=np.uint64), np.frombuffer(counts[i].as_buffer(), dtype="<u4")
                m = member[i].as_py()
                if m is None:
                    own, h1, c1 = hub[i].as_py(), h.copy(), c.copy()
                elif own == hub[i].as_py():
                    a.append(own)
                    b.append(m)
                    s.append(weighted_jaccard(h1, c1, h, c))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s, pa.float64())})

    return together.select("hub", "member", "hashes", "counts").mapInArrow(compare, "a bigint, b bigint, s double")


def block_links(left: list[tuple], right: list[tuple], least: float) -> list[tuple[int, int, float]]:
    """Pairs of left and right (each node, component, hashes, counts) at `least` or more, one for each two components that they join.

    What two documents share is a product of matrices over the shingles that both sides have: a column for the first
    occurrence of a shingle, one for the second, and so on, so that the sum of the lesser counts comes out.
    """

    def split(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c, dtype=np.int64) - c, c)
        h = np.repeat(h, c)
        again = nth > 0
        with np.errstate(over="ignore"):
            h[again] = mix(h[again] + nth[again].astype(np.uint64) * _K)
        return h

    def side(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [split(h, c) for _, _, h, c in rows]
        words = np.array([len(x) for x in parts], dtype=np.int64)
        return np.concatenate(parts), np.repeat(np.arange(len(rows)), words), words

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    h1, row1, n1 = side(left)
    h2, row2, n2 = side(right) if right is not left else (h1, row1, n1)
    common = np.intersect1d(h1, h2)
    if not len(common):
        return []

    def placed(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        there = common[at] == h
        return row[there], at[there]

    (r1, k1), (r2, k2) = placed(h1, row1), placed(h2, row2)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    # Some thousand columns at a time, so that a matrix stays small whatever the number of shingles.
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        x, y = np.zeros((len(left), width), dtype=np.float32), np.zeros((len(right), width), dtype=np.float32)
        own = (k1 >= lo) & (k1 < lo + width)
        x[r1[own], k1[own] - lo] = 1
        own = (k2 >= lo) & (k2 < lo + width)
        y[r2[own], k2[own] - lo] = 1
        both += x @ y.T
    # A float32 counts exactly up to 2^24; longer texts are counted one by one.
    if max(n1.max(), n2.max()) >= 1 << 24:
        both = np.array([[len(np.intersect1d(h1[row1 == i], h2[row2 == j], assume_unique=True)) for j in range(len(right))] for i in range(len(left))], dtype=np.float64)
    i, j = np.nonzero(both >= least * (n1[:, None] + n2[None, :]) / (1 + least) - 1e-3)
    shared = both[i, j].astype(np.float64)
    s = shared / (n1[i] + n2[j] - shared)
    out = []
    for k in np.flatnonzero(s >= least):
        a, b = left[i[k]], right[j[k]]
        x, y = find(a[1]), find(b[1])
        if x != y:
            parent[x] = y
            out.append((a[0], b[0], float(s[k])))
    return out


def linked_in_blocks(large: DataFrame, packed: DataFrame, config: NearDedupConfig) -> DataFrame:
    """Links (a, b) between the components of each bucket. large: key, node, component, hub, n, whole buckets of n rows.

    Buckets that overlap are one set, where that takes no more comparisons than bucket by bucket. All documents outside a
    set's largest component meet all of the set, block by block: rows grow with blocks, and pairs are no rows.
    """
    least = config.similarity - 1e-12
    sets = components(large.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "set")
    named = large.join(sets, "node")
    cost = named.groupBy("set").agg(F.sum("n").alias("squares"), F.count_distinct("node").alias("m"))
    whole = F.col("m") * F.col("m") <= F.col("squares")
    members = named.join(cost, "set").select(F.xxhash64(whole, F.when(whole, F.col("set")).otherwise(F.col("key"))).alias("unit"), "node", "component").distinct()
    members = materialize(members.join(packed.select("node", F.octet_length("hashes").alias("bytes")), "node"), "members")
    main = members.groupBy("unit", "component").agg(F.count("*").alias("c")).groupBy("unit").agg(F.max(F.struct("c", "component")).alias("top"))
    sides = members.join(main, "unit").withColumn("rest", F.col("component") != F.col("top.component")).drop("top")

    def blocks(of: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(of) / config.block_rows, F.coalesce(F.sum(F.when(of, F.col("bytes"))), F.lit(0)) / config.block_bytes)).cast("int")

    dealt = sides.join(sides.groupBy("unit").agg(blocks(F.col("rest")).alias("r"), blocks(~F.col("rest")).alias("k")).where("r > 0"), "unit")
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    block = F.col("block")
    left = F.when(F.col("rest"), F.transform(F.sequence(block, F.col("r") + F.col("k") - 1), lambda j: task(block, j, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    right = F.when(block > 0, F.transform(F.sequence(F.lit(0), F.least(block, F.col("r")) - 1), lambda i: task(i, block, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    tasks = dealt.withColumn("block", own).select("unit", "node", "component", F.explode(F.concat(left, right)).alias("t")).select("unit", "t.*", "node", "component")
    together = tasks.join(packed, "node").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            found = block_links(sides[0], sides[1] if now[1] != now[2] else sides[0], least) if sides[0] and (sides[1] or now[1] == now[2]) else []
            return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64()), "s": pa.array([x[2] for x in found], pa.float64())})

        for batch in batches:
            unit, i, j, side, node, component = (batch.column(n).to_pylist() for n in ("unit", "i", "j", "side", "node", "component"))
            hashes, counts = batch.column("hashes"), batch.column("counts")
            for k in range(batch.num_rows):
                if now != (unit[k], i[k], j[k]):
                    if now is not None:
                        yield done()
                    now, sides = (unit[k], i[k], j[k]), ([], [])
                h, c = np.frombuffer(hashes[k].as_buffer(), dtype=np.uint64).copy(), np.frombuffer(counts[k].as_buffer(), dtype="<u4").astype(np.int64)
                sides[side[k]].append((node[k], component[k], h, c))
        if now is not None:
            yield done()

    return together.select("unit", "i", "j", "side", "node", "component", "hashes", "counts").mapInArrow(compare, "a bigint, b bigint, s double")


def grouped(rows: DataFrame, docs: DataFrame, config: NearDedupConfig) -> DataFrame:
    """node, component of all documents that have a similar one. rows: node, doc_id, c1, c2, bands (of one document for each set of copies).

    Every document of a bucket is compared with its hub, the document that has the most company in all its buckets: of a
    text and its edited copies that is the text. Similarity to the hub tells which others can be similar at all, since
    one minus the weighted Jaccard similarity is a metric: small buckets get all those pairs between components. In large
    ones all documents outside the largest component are compared with all others, in blocks (`linked_in_blocks`).
    """
    least = config.similarity - 1e-12
    far = 1.0 - config.similarity + 1e-9
    keyed = rows.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    state = materialize(keyed.join(sizes, "key"), "buckets")  # key, node, band, n
    company = materialize(state.groupBy("node").agg(F.sum("n").alias("company")), "company")
    packed = materialize(packed_shingles(docs, rows.select("node", "doc_id", "c1", "c2").join(company, "node", "left_semi"), config).dropDuplicates(["node"]), "shingles")
    # Large buckets have a further hub for each share of their documents, as copies of a text may be less like each other
    # than each is like it; the first hub is the one that distances are taken from.
    share = F.when(F.col("n") > config.small, F.pmod(F.xxhash64("node"), F.lit(config.hubs))).otherwise(0)
    tops = materialize(state.join(company, "node").groupBy("key", share.alias("share")).agg(F.min(F.struct((-F.col("company")).alias("c"), "node")).alias("top")), "hubs")
    hubs = tops.groupBy("key").agg(F.min("top").alias("top")).select("key", F.col("top.node").alias("hub"))
    star = state.join(hubs, "key").select("key", "node", "n", "hub")
    pairs = state.join(tops.select("key", F.col("top.node").alias("a")), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    tried = materialize(verify(pairs, packed, config), "compared")
    of = materialize(components(tried.where(F.col("s") >= least).select("a", "b")), "components")
    # Each row with its component and its distance from the hub; buckets of one component are done.
    d = tried.select(F.col("a").alias("hub"), F.col("b").alias("node"), (1.0 - F.col("s")).alias("d"))
    named = star.join(of, "node", "left").select("key", "node", "n", "hub", F.coalesce("component", "node").alias("component"))
    named = named.join(d, ["hub", "node"], "left").withColumn("d", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("d")))
    mixed = named.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("key")
    open_ = materialize(named.join(mixed, "key", "left_semi"), "open")
    near = lambda x, y: (F.abs(x.d - y.d) <= far) & (x.component != y.component)
    collected = open_.where(F.col("n") <= config.small).groupBy("key").agg(F.collect_list(F.struct("node", "component", "d")).alias("m"))  # `small` at most
    found = F.filter(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (x.node < y.node) & near(x, y)), lambda y: F.struct(x.node.alias("a"), y.node.alias("b"))))), lambda q: q.a.isNotNull())
    both_ways = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialize(collected.select(F.explode(found).alias("q")).select("q.a", "q.b").distinct().join(both_ways, ["a", "b"], "left_anti"), "pairs")
    compared = [tried]
    if more.limit(1).count():
        compared.append(materialize(verify(more, packed, config), "compared"))
    large = open_.where(F.col("n") > config.small)
    if large.limit(1).count():
        compared.append(materialize(linked_in_blocks(large, packed, config), "compared"))
    return components(reduce(DataFrame.union, compared).where(F.col("s") >= least).select("a", "b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """Each row's doc_id, class_id (the smallest doc_id of its class) and n_copies, the number of rows with its very words."""
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed_rows = materialize(signatures(plain, "doc_id", "text", config), "signatures")
    copies = signed_rows.groupBy("c1", "c2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    # A node is a text: it goes by the smallest id of its copies, or by its hash if that id has other texts as well.
    repeated = materialize(signed_rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("low"), F.max(F.struct("c1", "c2")).alias("high")).where("low <> high").select("doc_id"), "repeated-ids")
    any_repeated = repeated.limit(1).count() > 0
    if any_repeated:
        again = repeated.select(F.col("doc_id").alias("first"), F.lit(True).alias("_again"))
        copies = copies.join(again, "first", "left").withColumn("node", F.when(F.col("_again"), F.xxhash64("c1", "c2", "first")).otherwise(F.col("first"))).drop("_again")
    else:
        copies = copies.withColumn("node", F.col("first"))
    copies = materialize(copies.select("c1", "c2", "first", "n_copies", "node"), "copies")
    rows = signed_rows.join(copies.where("node IS NOT NULL").select("c1", "c2", F.col("first").alias("doc_id"), "node"), ["c1", "c2", "doc_id"]).dropDuplicates(["node"]).select("node", "doc_id", "c1", "c2", "bands")
    of_node = materialize(grouped(rows, plain, config), "components")
    if any_repeated:
        # Rows of one doc_id and different words are one class as well.
        of_id = signed_rows.join(repeated, "doc_id", "left_semi").join(copies, ["c1", "c2"]).select("doc_id", "node")
        same_id = of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("low")), "doc_id").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        of_node = materialize(components(of_node.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same_id)), "components")
    named = copies.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if any_repeated:
        least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("class_id"))
        named = named.join(least, "component", "left")
    else:
        named = named.withColumn("class_id", F.col("component"))  # the smallest node is the smallest id
    named = named.select("c1", "c2", "class_id", "n_copies")
    # A row without words has no signature; it is its own class.
    worded = signed_rows.select("doc_id", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", "class_id", "n_copies")
    wordless = plain.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return worded.union(wordless)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """The rows of docs that are the first of their class, whole; of rows equal in key one stays, rows with a null key all stay."""
    first = classes(docs, key, text, config).where("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    kept = docs.join(first, F.col(f"`{key}`") == F.col("_kept"), "left_semi")
    order = Window.partitionBy(F.col(f"`{key}`")).orderBy(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    repeated = docs.groupBy(F.col(f"`{key}`").alias("_id")).agg(F.count("*").alias("n")).where("n > 1")
    if repeated.where("_id IS NOT NULL").limit(1).count():
        kept = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept.union(docs.where(F.col(f"`{key}`").isNull()))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "n_copies")
