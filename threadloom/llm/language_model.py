"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark and kept as sorted hash arrays.

Words are found on the whole text, A-Z in lower case, and an end token closes each text. Levels are counted one after the
other: the words, then the pairs, and so on up to `order`. A task counts its texts' n-grams slice by slice; the counts are
dealt by ranges of a 64-bit hash, and each range is sorted, summed and written as an Arrow file of hashes and counts. An
n-gram's hash is a reversible mix of the number of its first words in the level below and of its last word's number, so
that unequal n-grams never share one (words have hashes of 64 bits); the same file gives the n-gram back. Continuation
counts, discounts and the mass that a context leaves to the level below come from the files by Spark aggregations and are
arrays by number, in files of their own. Workers map the files into memory where the folder is mounted (elsewhere they read
them), look up a slice's n-grams in the order of their hashes, and sum the logarithms of a text's tokens.

    p_k(w | c) = max(a(c w) - D(a(c w)), 0) / a(c) + g(c) * p_(k-1)(w | shorter c),  p_0 = 1 / (words + 1)

with counts a at the highest level and continuation counts below, and D of modified Kneser-Ney (0.5, 1, 1.5 where the counts
of counts don't give it). A context never seen leaves all to the level below; words never seen share one place.

Nothing is cut off or sampled: the model grows with the corpus. The driver holds one row a file, a range of about
`range_size` n-grams each, and at most `max_ranges` files a level; a task holds one range. Up to 2 ** 32 distinct words (and
n-grams below the highest level) can be numbered; more raise an error.

Defined results: a null or empty text is its end token alone; repeated rows count and are scored each for itself; without
training texts every word is unknown; extra columns pass through, columns named as the operator's own are replaced; an
empty table gives an empty table. Texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed, sql_fixed
from .common import SpanHash, bare_lower, materialize, mix, new_folder, open_store, release_shuffles, sql_crc32, text_slices, word_spans

#: Hashes of the tokens that no text holds.
START, END = np.uint64(0x9D5C3A17E4B86F21), np.uint64(0x27B1F06D8EAC4953)
ADDED = (("n_tokens", "bigint"), ("n_known", "bigint"), ("base_score", "double"), ("score", "double"), ("perplexity", "double"))
LEVEL = "bucket int, file string, n bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, starts bigint"
_MANIFEST = pa.schema([("bucket", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("n", "total", "n1", "n2", "n3", "n4", "starts")]])
SHARES = "number bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, continued bigint"


@dataclass(frozen=True)
class ModelConfig:
    order: int = 2
    #: N-grams of a range before equal ones are summed, about, and the most ranges of a level (a power of two).
    range_size: int = 1 << 20
    max_ranges: int = 1 << 16
    #: Ranges that even a small level is dealt over.
    min_ranges: int = 64


# Hashes of n-grams


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix() made these words from."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
        x *= np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
        x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
        x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
        x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def packed(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix((first.astype(np.uint64) << np.uint64(32)) | last.astype(np.uint64))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they come, or the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[order], first)


def smallest(x: np.ndarray) -> np.ndarray:
    """In the fewest bytes that hold the largest number."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


# Files


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    store, path = open_store(uri)
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))
    with store.open_output_stream(path) as sink, pa.ipc.new_file(sink, batch.schema) as writer:
        writer.write_batch(batch)


@lru_cache(maxsize=4096)
def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the store is a mounted one."""
    from pyarrow import fs

    store, path = open_store(uri)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    # What is mapped stays so as long as an array is held; the file needn't stay open for it.
    source.close()
    return {n: c.to_numpy(zero_copy_only=True) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


@dataclass
class Level:
    """One level of the model: `files` has a name for each range of hashes or None, `first` the number of its first n-gram."""

    folder: str
    files: list[str | None]
    first: np.ndarray
    #: Files of the arrays by number, `width` numbers each; none at the highest level.
    by_number: list[str | None] = field(default_factory=list)
    width: int = 1
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: not there) and counts of n-grams by their hashes."""
        order = np.argsort(keys)
        ordered = keys[order]
        number, count = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        shift = np.uint64(64 - (len(self.files) - 1).bit_length())
        of = (ordered >> shift).astype(np.int64) if len(self.files) > 1 else np.zeros(len(keys), np.int64)
        for i in np.unique(of).tolist():
            if self.files[i] is None:
                continue
            lo, hi = np.searchsorted(of, [i, i + 1])
            arrays = read_arrays(f"{self.folder}/{self.files[i]}")
            have, want = arrays["hash"], ordered[lo:hi]
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = have[at] == want
            number[order[lo:hi][hit]] = self.first[i] + at[hit]
            count[order[lo:hi][hit]] = arrays["n"][at[hit]]
        return number, count

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        """The hashes of n-grams by their numbers."""
        out = np.zeros(len(numbers), dtype=np.uint64)
        of = np.searchsorted(self.first, numbers, side="right") - 1
        for i in np.unique(of).tolist():
            here = of == i
            out[here] = read_arrays(f"{self.folder}/{self.files[i]}")["hash"][numbers[here] - self.first[i]]
        return out

    def values(self, numbers: np.ndarray, *names: str) -> list[np.ndarray]:
        """Arrays by number: total and rest of an n-gram as a context, a (its continuation count)."""
        out = [np.zeros(len(numbers), dtype=np.float64) for _ in names]
        order = np.argsort(numbers)
        ordered = numbers[order]
        of = ordered // self.width
        for i in np.unique(of).tolist():
            if i < 0 or self.by_number[i] is None:
                continue
            lo, hi = np.searchsorted(of, [i, i + 1])
            arrays = read_arrays(f"{self.folder}/{self.by_number[i]}")
            for o, n in zip(out, names, strict=True):
                o[order[lo:hi]] = arrays[n][ordered[lo:hi] - i * self.width]
        return out


@dataclass
class Grams:
    """Of each token of some rows (`order` - 1 start tokens a row included) the row and the place in it; and for each level
    the n-gram that ends there: its hash (0 where its parts aren't known), its number (-1 where the level hasn't it) and count."""

    row: np.ndarray
    place: np.ndarray
    hashes: list[np.ndarray]
    numbers: list[np.ndarray]
    counts: list[np.ndarray]
    #: Numbers of the distinct words, and which of them each token is.
    words: np.ndarray
    which: np.ndarray


@dataclass
class Model:
    """What workers need to find the files: lists of names, nothing of the n-grams themselves."""

    order: int
    levels: list[Level]
    #: Training tokens, distinct words among them, distinct pairs that words close, and the share that words leave to unseen ones.
    tokens: int = 0
    words: int = 0
    continued: int = 0
    rest: float = 1.0

    def grams(self, data: np.ndarray, offsets: np.ndarray, upto: int) -> Grams:
        low = bare_lower(data)
        start, end, word_row = word_spans(low, offsets)
        n_rows, pads = len(offsets) - 1, self.order - 1
        sizes = np.bincount(word_row, minlength=n_rows) + 1 + pads
        close = np.cumsum(sizes)
        hashes = np.full(int(close[-1]) if n_rows else 0, START, dtype=np.uint64)
        hashes[close - 1] = END
        hashes[np.arange(len(word_row)) + word_row * (1 + pads) + pads] = SpanHash(low)(start, end)
        row = np.repeat(np.arange(n_rows), sizes)
        place = np.arange(len(row)) - np.repeat(close - sizes, sizes)
        # Words repeat, so that each distinct one is looked up once.
        words, which = np.unique(hashes, return_inverse=True)
        word, often = self.levels[0].find(words) if self.levels else (np.zeros(len(words), np.int64),) * 2
        numbers, keys, counts = [word[which]], [hashes], [often[which]]
        for k in range(2, upto + 1):
            known = np.flatnonzero((place >= k - 1) & (numbers[0] >= 0) & (np.roll(numbers[-1], 1) >= 0))
            keys.append(np.zeros(len(row), dtype=np.uint64))
            keys[-1][known] = packed(numbers[-1][known - 1], numbers[0][known])
            numbers.append(np.full(len(row), -1, dtype=np.int64))
            counts.append(np.zeros(len(row), dtype=np.int64))
            if k <= len(self.levels):
                numbers[-1][known], counts[-1][known] = self.levels[k - 1].find(keys[-1][known])
        return Grams(row, place, keys, numbers, counts, word, which)

    def suffix(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """Of n-grams of level k by number, the number of what is left without the first word, in the level below."""
        if k == 1:
            return np.zeros(len(numbers), dtype=np.int64)
        code = unmix(self.levels[k - 1].hashes(numbers))
        first, last = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(2**32 - 1)).astype(np.int64)
        return last if k == 2 else self.levels[k - 2].find(packed(self.suffix(k - 1, first), last))[0]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What n-grams that were seen once, twice, and more often give to the level below."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / n, 0.0), float(k)) for k, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discounted(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(a > 0, a - np.where(a >= 3, d[2], np.where(a >= 2, d[1], d[0])), 0.0)


# Counting


def manifest_row(bucket: int, file: str, counts: np.ndarray, starts: int = 0) -> pa.Table:
    """A row of LEVEL: how many n-grams a file has, the sum of their counts, and how many have a count of 1, 2, 3 and 4."""
    few = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    return pa.table([pa.array([x], f.type) for x, f in zip((bucket, file, len(counts), int(counts.sum()), *few, starts), _MANIFEST, strict=True)], schema=_MANIFEST)


def _count(rows: DataFrame, model: Model, k: int, text: str, ranges: int) -> DataFrame:
    """bucket, code and n of the n-grams of level k, summed within slices. The code is the hash of a word, or what the hash is mixed from."""
    bits = np.uint64(64 - (ranges - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                found = model.grams(data, offsets, k)
                hashes = found.hashes[-1][found.place >= k - 1]
                # In order of codes, which neighbours in a shuffled block share the beginning of.
                code, n = counted(hashes if k == 1 else unmix(hashes))
                hashes = code if k == 1 else mix(code)
                if k == 1:
                    n = np.where(hashes == START, 0, n)
                bucket = (hashes >> bits).astype(np.int32) if ranges > 1 else np.zeros(len(hashes), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(code.view(np.int64)), pa.array(n)], names=["bucket", "code", "n"])

    return rows.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket int, code bigint, n bigint")


def _write_level(counts: DataFrame, folder: str, k: int) -> DataFrame:
    """Sorts, sums and writes each range; a row of LEVEL for each. Files of attempts that failed are in no row."""

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy().view(np.uint64)
        hashes, n = counted(code if k == 1 else mix(code), table.column("n").to_numpy())
        name = f"level-{k}-{key[0].as_py():06d}-{uuid.uuid4().hex[:12]}.arrow"
        write_arrays(f"{folder}/{name}", {"hash": hashes, "n": smallest(n)})
        return manifest_row(key[0].as_py(), name, n, starts=int((hashes == START).sum()) if k == 1 else 0)

    return materialize(counts.groupBy("bucket").applyInArrow(write, LEVEL), f"lm-level-{k}")


def _shares(model: Model, k: int, spark: SparkSession) -> DataFrame:
    """What the n-grams of level k say of those of the level below, as contexts and as continuations, summed within a range."""
    level, top = model.levels[k - 1], k == model.order
    files = spark.createDataFrame([(i, f) for i, f in enumerate(level.files) if f], "bucket int, file string")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                arrays = read_arrays(f"{level.folder}/{level.files[i]}")
                numbers = level.first[i] + np.arange(len(arrays["hash"]))
                first = (unmix(arrays["hash"]) >> np.uint64(32)).astype(np.int64)
                a = arrays["n"].astype(np.int64) if top else level.values(numbers, "a")[0].astype(np.int64)
                seen = a > 0
                contexts, at = np.unique(first[seen], return_inverse=True)
                sums = [np.bincount(at, weights=w, minlength=len(contexts)).astype(np.int64) for w in (a[seen], a[seen] == 1, a[seen] == 2, a[seen] >= 3)]
                after, n = counted(model.suffix(k, numbers[seen]))
                none = lambda m: np.zeros(m, np.int64)
                columns = [np.concatenate([contexts, after]), *[np.concatenate([s, none(len(after))]) for s in sums], np.concatenate([none(len(contexts)), n])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["number", "total", "n1", "n2", "n3", "continued"])

    rows = files.repartition(max(1, sum(f is not None for f in level.files))).mapInArrow(share, SHARES)
    sums = [F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3", "continued")]
    return rows.groupBy("number").agg(*sums)


def _write_numbers(shares: DataFrame, model: Model, k: int, d: tuple[float, float, float]) -> DataFrame:
    """Files of arrays by number for level k: total and rest as a context, a as a continuation."""
    level = model.levels[k - 1]
    size, width, folder = level.size, level.width, level.folder

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        at = table.column("number").to_numpy() - part * width
        n = min(width, size - part * width)
        c = {x: table.column(x).to_numpy() for x in ("total", "n1", "n2", "n3", "continued")}
        a, total, rest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n)
        a[at], total[at] = c["continued"], c["total"]
        used = c["total"] > 0
        rest[at[used]] = (d[0] * c["n1"] + d[1] * c["n2"] + d[2] * c["n3"])[used] / c["total"][used]
        name = f"numbers-{k}-{part:06d}-{uuid.uuid4().hex[:12]}.arrow"
        write_arrays(f"{folder}/{name}", {"a": smallest(a), "total": smallest(total), "rest": rest})
        return manifest_row(part, name, a[a > 0])

    dealt = shares.withColumn("part", F.floor(F.col("number") / width).cast("int"))
    return materialize(dealt.groupBy("part").applyInArrow(write, LEVEL), f"lm-numbers-{k}")


def train(rows: DataFrame, text: str = "text", config: ModelConfig = ModelConfig(), folder: str | None = None) -> Model:
    """The model of all texts, its files in the folder (of the shared folder, unless one is given)."""
    if config.order < 2:
        raise ValueError("an order of 2 at least")
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "language-model")
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    model = Model(config.order, [])
    chars = rows.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    for k in range(1, config.order + 1):
        # A word takes some five characters; what a slice repeats is summed before, words to a quarter or so.
        ranges, rows_expected = config.min_ranges, chars // (20 if k == 1 else 5)
        while ranges < config.max_ranges and ranges * config.range_size < rows_expected:
            ranges *= 2
        made = {r.bucket: r for r in _write_level(_count(rows, model, k, text, ranges), folder, k).collect()}  # a row a range
        release_shuffles(spark)
        sizes = [made[i].n if i in made else 0 for i in range(ranges)]
        model.levels.append(Level(folder, [made[i].file if i in made else None for i in range(ranges)], np.concatenate([[0], np.cumsum(sizes)]), width=config.range_size // 8))
        if k < config.order and model.levels[-1].size >= 2**32:
            raise ValueError(f"level {k} has more n-grams than 32 bits can number")
        if k == 1:
            model.tokens, model.words = sum(r.total for r in made.values()), sum(r.n - r.starts for r in made.values())
        if k == config.order:
            model.levels[-1].discounts = discounts(*(sum(r[c] for r in made.values()) for c in ("n1", "n2", "n3", "n4")))
    for k in range(config.order, 1, -1):
        below = model.levels[k - 2]
        made = {r.bucket: r for r in _write_numbers(_shares(model, k, spark), model, k - 1, model.levels[k - 1].discounts).collect()}  # a row a range
        below.by_number = [made[i].file if i in made else None for i in range(-(-below.size // below.width))]
        below.discounts = discounts(*(sum(r[c] for r in made.values()) for c in ("n1", "n2", "n3", "n4")))
        if k == 2:
            model.continued = sum(r.total for r in made.values())
            few = [sum(r[c] for r in made.values()) for c in ("n1", "n2")]
            d, more = below.discounts, sum(r.n for r in made.values()) - sum(few)
            model.rest = (d[0] * few[0] + d[1] * few[1] + d[2] * more) / model.continued if model.continued else 1.0
    return model


# Scoring


def probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token that isn't a start token its row, its count in training and its probability."""
    found = model.grams(data, offsets, model.order)
    numbers, at = found.numbers, np.flatnonzero(found.place >= model.order - 1)
    word, count = numbers[0][at], found.counts[0][at]
    seen = word >= 0
    own = model.levels[0].values(found.words, "a", "total", "rest") if model.levels[0].size else [np.zeros(len(found.words))] * 3
    a = own[0][found.which[at]]
    p = np.full(len(at), 1 / (model.words + 1)) * model.rest
    if model.continued:
        p += np.where(seen, discounted(a, model.levels[0].discounts) / model.continued, 0.0)
    for k in range(2, model.order + 1):
        level, below, context = model.levels[k - 1], model.levels[k - 2], numbers[k - 2][at - 1]
        total, rest = [x[found.which[at - 1]] for x in own[1:]] if k == 2 else below.values(context, "total", "rest") if below.size else (np.zeros(len(at)),) * 2
        used = (context >= 0) & (total > 0)
        number = numbers[k - 1][at]
        a = found.counts[k - 1][at].astype(np.float64) if k == model.order else level.values(number, "a")[0] if level.size else np.zeros(len(at))
        a = np.where(number >= 0, a, 0.0)
        p = np.where(used, discounted(a, level.discounts) / np.maximum(total, 1) + np.where(used, rest, 1.0) * p, p)
    return found.row[at], count, p


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs with n_tokens, n_known (seen in training), base_score (add-one words), score (log10 of the text) and
    perplexity (a token's)."""
    names = [n for n, _ in ADDED]
    base = docs.drop(*[n for n in names if n != text])
    whole = float(model.tokens + model.words + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                row, count, p = probabilities(model, data, offsets)
                first = np.searchsorted(row, np.arange(hi - lo))
                n = np.diff(np.append(first, len(row)))
                # Sums of many small numbers, with digits to spare: a text's score doesn't hang on where a slice is cut.
                sums = [np.add.reduceat(np.log10(x).astype(np.longdouble), first).astype(np.float64) for x in ((count + 1) / whole, p)]
                known = np.add.reduceat((count > 0).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *map(pa.array, (n, known, *sums, 10 ** (-sums[1] / n)))], names=[*batch.schema.names, *names])

    return base.mapInArrow(judge, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], *[f"{n} {t}" for n, t in ADDED]]))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    scored = score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), fixed(F.col("base_score"), 9).alias("base_score"), fixed(F.col("score"), 9).alias("score"))


def _sql_discounts(table: str) -> str:
    """Rows of one: d1, d2, d3 from a table of counts a."""
    of = [f"(SELECT count(*) FILTER (a = {i})::DOUBLE FROM {table})" for i in (1, 2, 3, 4)]
    each = ", ".join(f"CASE WHEN n1 * n2 * n3 * n4 > 0 THEN least(greatest({k} - {k + 1} * (n1 / (n1 + 2 * n2)) * n{k + 1} / n{k}, 0), {k}) ELSE {k / 2} END AS d{k}" for k in (1, 2, 3))
    return f"SELECT {each} FROM (SELECT {', '.join(f'{x} AS n{i + 1}' for i, x in enumerate(of))})"


_LESS = "(CASE WHEN {a} >= 3 THEN d3 WHEN {a} = 2 THEN d2 ELSE d1 END)"
_REST = "(d1 * count(*) FILTER (a = 1) + d2 * count(*) FILTER (a = 2) + d3 * count(*) FILTER (a >= 3))"
#: The same in DuckDB, for an order of 2. Tab and line break stand for the start and end tokens: no word holds them.
OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({sql_crc32("doc_id::VARCHAR")} % 7 = 2, false) AS held_out,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_prepend(chr(9), words)) AS v, unnest(list_append(words, chr(10))) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS tokens, count(*) AS words FROM c),
b AS (SELECT v, w, count(*) AS a FROM t WHERE NOT held_out GROUP BY v, w),
u AS (SELECT w, count(*) AS a FROM b GROUP BY w),
db AS ({_sql_discounts("b")}),
du AS ({_sql_discounts("u")}),
x AS (SELECT v, sum(a)::DOUBLE AS total, {_REST} / sum(a)::DOUBLE AS rest FROM b, db GROUP BY v, d1, d2, d3),
g AS (SELECT sum(a)::DOUBLE AS total, {_REST} / sum(a)::DOUBLE / (SELECT words + 1 FROM s) AS rest FROM u, du GROUP BY d1, d2, d3),
p1 AS (SELECT w, greatest(a - {_LESS.format(a="a")}, 0) / total AS p FROM u, du, g),
p AS (SELECT t.doc_id, t.held_out, c.c, coalesce(p1.p, 0) + coalesce(g.rest, 1.0 / (s.words + 1)) AS low, x.total, x.rest,
  CASE WHEN b.a IS NULL THEN 0 ELSE greatest(b.a - {_LESS.format(a="b.a")}, 0) END AS over, s.tokens, s.words
  FROM t CROSS JOIN s CROSS JOIN db LEFT JOIN g ON true LEFT JOIN c ON t.w = c.w LEFT JOIN p1 ON t.w = p1.w LEFT JOIN x ON t.v = x.v LEFT JOIN b ON t.v = b.v AND t.w = b.w)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(tokens) AS train_tokens,
  {sql_fixed("fsum(log10((coalesce(c, 0) + 1)::DOUBLE / (tokens + words + 1)::DOUBLE))", 9)} AS base_score,
  {sql_fixed("fsum(log10(CASE WHEN total IS NULL THEN low ELSE over / total + rest * low END))", 9)} AS score
FROM p GROUP BY doc_id, held_out
"""
