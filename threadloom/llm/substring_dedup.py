"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts anywhere else goes.

Windows of `length` bytes are not compared one by one. Each has an anchor, the leftmost of its grams of `gram` bytes with
the smallest hash; equal windows have equal anchors in equal places, so that only windows of one anchor are compared.
An anchor's occurrence comes with its context, the bytes of all windows it is the anchor of. Equal contexts are counted
with map-side combining; one of them stands for all, and if there are two it is a repeat as a whole. The different contexts
of an anchor go to one task, which sorts them by what follows the anchor (a suffix array sampled at anchors), computes the
longest common prefixes of neighbours, and scans these with a stack for the tree of common-prefix intervals. Within each
interval the contexts are put in order of what stands before the anchor, and the tree of that order tells which agree in
how many bytes there: the sets that can't grow on either side are the maximal repeats, with all contexts that hold them
(`repeat_groups`). What is removed is what these cover; `maximal_repeats` returns them with all their occurrences. Anchors
with more contexts than a task may hold are first split by halving the range of windows: a half's windows share a core of
bytes, contexts go on only with others of an equal core, and where one window is left, equal cores are a repeat.

Defined results: a null or empty text has no bytes and nothing removed; texts are taken whole, as UTF-8; repeated rows
are copies of each other, so that both lose what is long enough; rows with a null doc_id count like any; extra columns
are ignored; an empty table gives no rows. What is kept of a character cut in two is kept as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SpanHash, delete, materialize, mix, signed, text_slices, word_spans

PAD = 0xFF  # in no UTF-8 text
#: So many keys of large groups are broadcast; beyond, each is dealt to so many shares.
BROADCAST_KEYS, SHARES = 10_000, 64


@dataclass(frozen=True)
class SubstringConfig:
    length: int = 400
    gram: int = 64
    #: Contexts of one anchor that are compared in one task; anchors with more are split first. Results don't hang on it.
    contexts: int = 1_000
    #: Contexts that a task sorts at once, about.
    chunk: int = 8_000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


def anchors_of(data: np.ndarray, offsets: np.ndarray, config: SubstringConfig):
    """Of a slice: row, place, first and last window of each anchor (bytes in the slice), hash of its gram and of its context."""
    n, k, length, w = len(data), config.gram, config.length, config.window
    sizes = np.diff(offsets)
    valid = np.flatnonzero(sizes >= length)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    grams = SpanHash(data, 1)
    at = np.arange(n - k + 1)
    h = grams(at, at + k)
    packed = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    blocks = -(-len(packed) // w) + 1
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(packed)] = packed
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    counts = sizes[valid] - length + 1
    begin = np.repeat(offsets[valid], counts)
    s = begin + np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(valid, counts)
    place = (np.minimum(behind[s], ahead[s + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    row, place, lo, hi = row[first], place[first], s[first], s[last]
    with np.errstate(over="ignore"):
        context = mix(SpanHash(data, 2)(lo, hi + length) + mix((place - lo).astype(np.uint64)) * np.uint64(3) + (hi - lo).astype(np.uint64))
    return row, place, lo, hi, h[place], context


ANCHORS = "doc_id bigint, th bigint, place int, before int, extra int, h bigint, ctx bigint"


def anchors(docs: DataFrame, config: SubstringConfig) -> DataFrame:
    """docs: doc_id, th, text. before: bytes from the first window to the anchor; extra: windows after the first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                row, place, first, last, h, ctx = anchors_of(data, offsets, config)
                own = [batch.column(i).slice(lo, hi - lo).take(pa.array(row)) for i in (0, 1)]
                ints = [pa.array(x.astype(np.int32)) for x in (place - offsets[row], place - first, last - first)]
                yield pa.RecordBatch.from_arrays([*own, *ints, pa.array(signed(h)), pa.array(signed(ctx))], names=["doc_id", "th", "place", "before", "extra", "h", "ctx"])

    return docs.mapInArrow(find, ANCHORS)


def contexts(docs: DataFrame, wanted: DataFrame, config: SubstringConfig) -> DataFrame:
    """The bytes of the contexts in wanted (h, ctx, m, doc_id, th, place, before, extra): h, ctx, m, before, extra, bytes."""
    by_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "ctx", "m", "place", "before", "extra")).alias("at"))  # a text's own anchors
    joined = docs.join(by_doc.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "at"), (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for text, at in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    raw = (text.as_py() or "").encode()
                    out += [(x["h"], x["ctx"], x["m"], x["before"], x["extra"], raw[x["place"] - x["before"] : x["place"] - x["before"] + x["extra"] + config.length]) for x in at]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h", "ctx", "m", "before", "extra", "bytes"])

    return joined.select("text", "at").mapInArrow(cut, "h bigint, ctx bigint, m bigint, before int, extra int, bytes binary")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes in which the rows of two matrices agree from the left."""
    if not len(a):
        return np.zeros(0, np.int64)
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tree of common-prefix intervals by a stack scan: (prefix, first, last) of a suffix array, for prefixes of `least` and more.
    lcp[i] is that of entries i and i + 1."""
    out, stack = [], []  # of (prefix, first)
    for i, value in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > value:
            prefix, first = stack.pop()
            out.append((prefix, first, i))
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


#: A maximal repeat among contexts of one anchor: bytes before the anchor, bytes from it on, and the contexts that hold it.
Group = tuple[int, int, np.ndarray]


def repeat_groups(parts: list[bytes], before: np.ndarray, config: SubstringConfig) -> list[Group]:
    """The maximal repeats of `length` bytes and more that hold the anchor, each with all contexts it occurs in.

    The tree of common-prefix intervals of the array of right sides gives every set of contexts that agree in `right`
    bytes and no more. Within an interval the contexts are put in order of what stands before the anchor, and the tree of
    that order gives the sets that agree in `left` bytes and no more: what stands before differs (left-diverse). A set that
    agrees in more on the right belongs to a deeper interval and is left to it (right-diverse).
    """
    n, length = len(parts), config.length
    right = np.full((n, length), PAD, dtype=np.uint8)
    left = np.full((n, config.window), PAD, dtype=np.uint8)  # from the anchor backwards; one byte of padding at least
    size = np.zeros(n, dtype=np.int64)
    for i, raw in enumerate(parts):
        x, b = np.frombuffer(raw, dtype=np.uint8), before[i]
        right[i, : len(x) - b] = x[b:][:length]
        left[i, :b] = x[:b][::-1]
        size[i] = len(x) - b
    array = np.argsort(right.reshape(-1).view(f"S{length}"), kind="stable")
    place, rank = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    place[array] = np.arange(n)
    rank[np.argsort(left.reshape(-1).view(f"S{config.window}"), kind="stable")] = np.arange(n)
    ordered = right[array]
    # Sides that end alike agree in their padding too, which counts for nothing.
    lcp = np.minimum(common_prefix(ordered[:-1], ordered[1:]), np.minimum(size[array[:-1]], size[array[1:]]))
    groups: list[Group] = []
    nodes: list[tuple[int, np.ndarray]] = []  # (right, contexts in order of their left sides)
    waiting = 0

    def look() -> None:
        """Left sides of the nodes gathered so far: neighbours are compared together, and nodes with a repeat scanned."""
        i, j = np.concatenate([m[:-1] for _, m in nodes]), np.concatenate([m[1:] for _, m in nodes])
        common = np.empty(len(i), dtype=np.int64)
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            common[at : at + 20_000] = np.minimum(common_prefix(left[x], left[y]), np.minimum(before[x], before[y]))
        at = 0
        for r, members in nodes:
            own = common[at : at + len(members) - 1]
            at += len(own)
            least = length - r
            if not (own >= least).any():
                continue
            for l, first, last in intervals(own, least):  # noqa: E741
                held = members[first : last + 1]
                ends = place[held]
                if len(held) == len(members) or lcp[ends.min() : ends.max()].min() == r:
                    groups.append((l, r, held))
        nodes.clear()

    for value, first, last in intervals(lcp, config.gram):
        members = array[first : last + 1]
        nodes.append((value, members[np.argsort(rank[members], kind="stable")]))
        waiting += len(members)
        if waiting >= 100_000:
            look()
            waiting = 0
    if nodes:
        look()
    return groups


def group_marks(groups: list[Group], n: int, config: SubstringConfig) -> list[list[tuple[int, int]]]:
    """For each of n contexts the ranges of windows, by their start from its anchor, that lie in a repeat."""
    marks: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if not groups:
        return marks
    sizes = [len(m) for _, _, m in groups]
    rows = np.stack([np.concatenate([m for _, _, m in groups]), np.repeat([-g[0] for g in groups], sizes), np.repeat([g[1] - config.length for g in groups], sizes)], axis=1)
    for i, lo, hi in np.unique(rows.astype(np.int32), axis=0).tolist():
        own = marks[i]  # rows are in order of context and first window
        if own and lo <= own[-1][1] + 1:
            own[-1] = (own[-1][0], max(own[-1][1], hi))
        else:
            own.append((lo, hi))
    return marks


def repeats(parts: list[bytes], before: np.ndarray, config: SubstringConfig) -> list[list[tuple[int, int]]]:
    """For each context the ranges of windows, by their start from its anchor, that another context has too: those of its repeats."""
    return group_marks(repeat_groups(parts, before, config), len(parts), config)


def merged(spans: list[tuple[int, int]], gap: int = 1) -> list[tuple[int, int]]:
    """Ranges of whole numbers, both ends in, joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


MARKS = "h bigint, ctx bigint, spans array<struct<lo:int,hi:int>>"
_MARKS = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))])
HELD = "repeat bigint, h bigint, ctx bigint, lo int, hi int"
_HELD = pa.schema([("repeat", pa.int64()), ("h", pa.int64()), ("ctx", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def compared(groups: DataFrame, config: SubstringConfig, listed: bool = False) -> DataFrame:
    """The contexts of each g compared with each other. groups: g, h, ctx, before, bytes. Returns the ranges of each context
    that lie in repeats, or, listed, a row for each repeat (named by a hash of its bytes) and context that holds it."""

    def names(groups: list[Group], rows: list[tuple]) -> list[tuple]:
        out = []
        for l, r, members in groups:  # noqa: E741
            one = rows[members[0]]
            name = int.from_bytes(hashlib.blake2b(one[4][one[3] - l : one[3] + r], digest_size=8).digest(), "little", signed=True)
            out += [(name, rows[m][1], rows[m][2], -l, r - config.length) for m in members]
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            once = list({(r[1], r[2]): r for r in rows}.values())  # a context can be in two groups; it is no repeat of itself
            found = repeat_groups([r[4] for r in once], np.array([r[3] for r in once], dtype=np.int64), config)
            if listed:
                have, schema = names(found, once), _HELD
            else:
                marks, schema = group_marks(found, len(once), config), _MARKS
                have = [(r[1], r[2], [{"lo": a, "hi": b} for a, b in m]) for r, m in zip(once, marks, strict=True) if m]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in have], t) for i, t in enumerate(schema.types)], schema=schema)

        for batch in batches:
            for r in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if len(rows) >= config.chunk and r[0] != rows[-1][0]:
                    yield out()
                    rows = []
                rows.append(r)
        if rows:
            yield out()

    return groups.select("g", "h", "ctx", "before", "bytes").repartition("g").sortWithinPartitions("g").mapInArrow(scan, HELD if listed else MARKS)


def with_sizes(keyed: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """keyed (a table) with the n of its key in sizes (key, n). The rows of keys with more than `most` rows stay where they are:
    these keys are broadcast if they are BROADCAST_KEYS at most, and else dealt by key and a hash of the row. Rows of other
    keys are dealt by key."""
    large = sizes.where(F.col("n") > most)
    if large.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        told = keyed.join(F.broadcast(large), "key", "left")
    else:
        shares = large.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        told = keyed.withColumn("_share", F.pmod(F.xxhash64("h", "ctx"), F.lit(SHARES)).cast("int")).join(shares, ["key", "_share"], "left").drop("_share")
    return told.where("n IS NOT NULL").unionByName(told.where("n IS NULL").drop("n").join(sizes.where(F.col("n") <= most), "key"))


def refined(hot: DataFrame, config: SubstringConfig, made: list[str]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Splits anchors with too many contexts. hot: h, ctx, before, extra, bytes. Returns groups to compare, and marks."""
    groups, marks = [], []
    state = hot.select("h", "ctx", "before", "extra", "bytes", F.lit(-(config.window - 1)).alias("lo"), F.lit(0).alias("hi"), F.col("h").alias("g"))
    while True:
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi")))).otherwise(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
        split = state.withColumn("half", F.explode(halves)).select("h", "ctx", "before", "extra", "bytes", "half.lo", "half.hi", "g")
        # Contexts with a window in the half, by the bytes that all windows of the half share.
        own = split.where("greatest(lo, -before) <= least(hi, extra - before)")
        core = F.substring("bytes", F.col("hi") + F.col("before") + 1, F.col("lo") + config.length - F.col("hi"))
        keyed = materialize(own.withColumn("key", F.xxhash64("g", "lo", "hi", core)), "refined-keys", made)
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        keyed = materialize(with_sizes(keyed, sizes, config.contexts), "refined", made)
        single = keyed.where("lo = hi")
        marks.append(single.select(F.col("key").alias("repeat"), "h", "ctx", "lo", "hi"))
        groups.append(keyed.where((F.col("lo") < F.col("hi")) & (F.col("n") <= config.contexts)).select(F.col("key").alias("g"), "h", "ctx", "before", "bytes"))
        state = keyed.where((F.col("lo") < F.col("hi")) & (F.col("n") > config.contexts)).select("h", "ctx", "before", "extra", "bytes", "lo", "hi", F.col("key").alias("g"))
        if not state.limit(1).count():
            return groups, marks


def _held(docs: DataFrame, config: SubstringConfig, listed: bool, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """All anchors of docs (doc_id, th, text), and what repeats hold of their contexts, as `compared` returns it."""
    found = materialize(anchors(docs, config), "anchors", made)
    distinct = found.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "place", "before", "extra")).alias("one"))
    groups = distinct.groupBy("h").agg(F.count("*").alias("m"), F.sum("c").alias("total"), F.min("c").alias("least")).where("total > 1")
    repeated = materialize(distinct.join(groups, "h"), "contexts", made)
    # Equal contexts are one repeat as they are.
    whole = repeated.where("c > 1").select(F.xxhash64("h", "ctx").alias("repeat"), "h", "ctx", (-F.col("one.before")).alias("lo"), (F.col("one.extra") - F.col("one.before")).alias("hi"))
    open_ = repeated.where("m > 1" if listed else "m > 1 AND least = 1")
    parts = materialize(contexts(docs, open_.select("h", "ctx", "m", "one.*"), config).dropDuplicates(["h", "ctx"]), "context-bytes", made)
    todo = parts.where(F.col("m") <= config.contexts).select(F.col("h").alias("g"), "h", "ctx", "before", "bytes")
    hot = parts.where(F.col("m") > config.contexts)
    if hot.limit(1).count():
        more, known = refined(hot.drop("m"), config, made)
        for x in more:
            todo = todo.union(x)
        for x in known:
            whole = whole.union(x)
    if not listed:
        whole = whole.select("h", "ctx", F.array(F.struct("lo", "hi")).alias("spans"))
    return found, materialize(whole.union(compared(todo, config, listed)), "marks", made)


def find_spans(docs: DataFrame, config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """doc_id, th and the byte ranges (first, last) covered by repeats. docs: doc_id, th (a hash of the text), text."""
    made: list[str] = []
    found, marks = _held(docs, config, listed=False, made=made)
    spans = found.join(marks, ["h", "ctx"]).select("doc_id", "th", "place", "before", "extra", F.explode("spans").alias("s"))
    # Only windows of the occurrence's own range: both ends lie in it already, for equal contexts have equal ranges.
    cover = spans.select("doc_id", "th", (F.col("place") + F.col("s.lo")).alias("first"), (F.col("place") + F.col("s.hi") + config.length - 1).alias("last"))
    out = materialize(cover.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")  # a text's own ranges
    for path in made:
        delete(docs.sparkSession, path)
    return out


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SubstringConfig = SubstringConfig()) -> DataFrame:
    """Repeats of `length` bytes and more with all their occurrences: repeat (a hash), length, n_occurrences, doc_id, start
    (a byte of the text). Rows with equal key and text are one text here.

    Each anchor gives its own maximal repeats, which end where the anchor's contexts do. Those of anchors that follow each
    other and occur in the same places, moved by the same bytes, are joined to one; where a part of a repeat occurs
    elsewhere too, that part is a repeat of its own with more occurrences, and the others end at the anchors around it.
    """
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text").distinct()
    made: list[str] = []
    found, held = _held(plain, config, listed=True, made=made)
    occurs = materialize(held.distinct().join(found, ["h", "ctx"]).select("repeat", "doc_id", "th", (F.col("place") + F.col("lo")).alias("start"), (F.col("hi") - F.col("lo") + config.length).alias("length")).distinct(), "occurrences")
    for path in made:
        delete(docs.sparkSession, path)
    first = occurs.groupBy("repeat", "length").agg(F.min(F.struct("doc_id", "th", "start")).alias("f"), F.count("*").alias("n_occurrences")).where("n_occurrences > 1")
    # The places of a repeat against its first one, as a sum that combines map-side.
    moved = occurs.join(first, ["repeat", "length"]).groupBy("repeat", "length", "f", "n_occurrences").agg(F.sum(F.xxhash64("doc_id", "th", F.col("start") - F.col("f.start")).cast("decimal(38,0)")).alias("places"))
    same = Window.partitionBy("f.doc_id", "f.th", "n_occurrences", "places").orderBy("f.start", "length", "repeat")
    reach = F.max(F.col("f.start") + F.col("length")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    runs = moved.withColumn("_new", F.when(F.col("f.start") <= reach, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(same))
    runs = runs.groupBy("f.doc_id", "f.th", "n_occurrences", "places", "_run").agg(F.min(F.struct("f.start", "length", "repeat")).alias("one"), F.max(F.col("f.start") + F.col("length")).alias("end"))
    joined = runs.select(F.col("one.repeat").alias("repeat"), F.col("one.length").alias("length"), "n_occurrences", (F.col("end") - F.col("one.start")).alias("_whole"))
    return joined.join(occurs, ["repeat", "length"]).select("repeat", F.col("_whole").alias("length"), "n_occurrences", "doc_id", "start")


def word_classes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, th, text) with each word of the text as one of 127 characters, by its hash, so that repeats of words are repeats of bytes."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                start, end, row = word_spans(data, offsets)
                body = (SpanHash(data, 3)(start, end) % np.uint64(127) + np.uint64(1)).astype(np.uint8)
                places = np.searchsorted(row, np.arange(hi - lo + 1))
                text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:2], text], names=["doc_id", "th", "text"])

    return docs.mapInArrow(classes, "doc_id bigint, th bigint, text string")


def passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc_id and th of the texts with a passage of so many words that is elsewhere too, whatever its white space and bytes.
    docs: doc_id, th, text. Found as repeats of bytes are, over the classes of the words: unlike words share one in 127 cases."""
    coded = materialize(word_classes(docs), "word-classes")
    return find_spans(coded, SubstringConfig(length=words, gram=8)).select("doc_id", "th")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", config: SubstringConfig = SubstringConfig(), words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, removed (array of first and last byte, both in, not touching), kept (binary) and shared of every row:
    shared says whether a passage of so many words is elsewhere too, which takes nothing away (null if words is)."""
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    spans = find_spans(plain, config).withColumn("shared", F.lit(None).cast("boolean"))
    if words is not None:
        told = spans.drop("shared").unionByName(passages(plain, words).withColumn("shared", F.lit(True)), allowMissingColumns=True)
        spans = told.groupBy("doc_id", "th").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("shared").alias("shared"))
    joined = plain.join(spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans", "shared"), (F.col("th") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    if words is not None:
        joined = joined.withColumn("shared", F.coalesce("shared", F.lit(False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sizes, removed, kept = [], [], []
                for t, s in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    raw = t.as_py().encode()
                    runs = merged([(x["first"], x["last"]) for x in s or ()])
                    out, at = [], 0
                    for a, b in runs:
                        out.append(raw[at:a])
                        at = b + 1
                    kept.append(b"".join([*out, raw[at:]]))
                    sizes.append(len(raw))
                    removed.append([{"first": a, "last": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), part.column(3)], names=["doc_id", "n_bytes", "removed", "kept", "shared"])

    return joined.select("doc_id", "text", "spans", "shared").mapInArrow(cut, "doc_id bigint, n_bytes bigint, removed array<struct<first:int,last:int>>, kept binary, shared boolean")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without what repeats anywhere for 400 bytes; shares_passage says where 50 words are elsewhere too."""
    rows = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=50)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shared").alias("shares_passage"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 by comparing all windows; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        runs = merged([(i, i + length - 1) for i in range(len(r) - length + 1) if seen[r[i : i + length]] > 1])
        gone = sum(b - a + 1 for a, b in runs)
        drop = np.zeros(len(r), dtype=bool)
        for a, b in runs:
            drop[a : b + 1] = True
        out.append((len(r), gone, len(runs), hashlib.sha256(np.frombuffer(r, dtype=np.uint8)[~drop].tobytes()).hexdigest()))
    return out
