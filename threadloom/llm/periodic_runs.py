"""Periodic run detection: stretches of words that repeat with a short period, and the text with the repetitions taken out.

A run is a stretch of consecutive words with smallest period q, at least max(least, exponent * q) words long, that no
neighbouring word extends. Shifted by q it overlaps itself, by `overlap` words at least whatever q is, and so every word
of a run lies in a k-gram of that many words that the text holds twice. Words outside such k-grams can't join a run and are
masked; the Main-Lorentz division finds the runs of each stretch of words that is left: halves are searched each for itself,
and runs across the middle come from the common extensions of the two halves, by Z-functions.

K-grams are compared by 64-bit hashes, where a collision only leaves a word unmasked; runs are found on the words themselves.

Defined results: a null or empty text has no runs and collapses to an empty text; repeated rows are judged each for itself;
extra columns pass through, columns named as the operator's own are replaced; an empty table gives an empty table. Texts are
searched whole, in time of n log n for the words that aren't masked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import let
from .common import SpanHash, joined_words, mix, text_slices, word_spans

RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD_PATTERN = r"([^\x20\x09-\x0D]+)"


@dataclass(frozen=True)
class RunConfig:
    #: Words in the shortest run, and how often its period fits into it at least (2 or more).
    least: int = 6
    exponent: int = 4

    @property
    def overlap(self) -> int:
        """Words by which any run overlaps itself when shifted by its period: the least of its length less its period."""
        return min(max(self.least, self.exponent * q) - q for q in range(1, self.least + 1))


def repeated_kgrams(words: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """For each word (by hash) whether it lies in a k-gram that occurs twice or more in its row."""
    n = len(words) - k + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if n < 2:
        return covered[:-1] > 0
    with np.errstate(over="ignore"):
        gram = row[:n].astype(np.uint64)
        for j in range(k):
            gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    at = at[np.argsort(gram[at], kind="stable")]
    same = gram[at][1:] == gram[at][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    np.add.at(covered, at[twice], 1)
    np.add.at(covered, at[twice] + k, -1)
    return np.cumsum(covered)[:-1] > 0


def z_function(s: list[int]) -> list[int]:
    """For each place how long what starts there equals the beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(s: list[int], low: int, middle: int, high: int, config: RunConfig) -> Iterator[tuple[int, int, int]]:
    """Start, end and period of stretches of s[low:high] that are long enough and reach over or up to the middle."""
    most = min((high - low) // config.exponent, middle - low, high - middle)
    if most < 1:
        return
    left, right = s[low:middle], s[middle:high]
    # Forward from the middle: against later places of the right half, and against the end of the left one.
    ahead = z_function([*right, -1, *s[middle - most : high]])
    # Backward from the middle, likewise.
    back = z_function([*left[::-1], -1, *s[low : middle + most][::-1]])
    p = np.arange(1, most + 1)
    forward, backward = np.array(ahead), np.array(back)

    def within(z: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
        return np.where(at < limit, z[np.minimum(at, limit)], 0)

    ends = np.concatenate([middle + forward[len(right) + 1 + most - p], middle + p + within(forward, p, len(right))])
    starts = np.concatenate([middle - p - within(backward, p, len(left)), middle - backward[len(left) + 1 + most - p]])
    periods = np.concatenate([p, p])
    for i in np.flatnonzero(ends - starts >= np.maximum(config.least, config.exponent * periods)):
        yield int(starts[i]), int(ends[i]), int(periods[i])


def main_lorentz(s: list[int], config: RunConfig = RunConfig()) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of each run of s, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    waiting = [(0, len(s))]
    while waiting:
        low, high = waiting.pop()
        if high - low < max(config.least, config.exponent):
            continue
        middle = (low + high) // 2
        for start, end, p in crossing(s, low, middle, high, config):
            # What goes on beyond this part is found where the part was cut off.
            if (start == low and start > 0 and s[start - 1] == s[start - 1 + p]) or (end == high and end < len(s) and s[end] == s[end - p]):
                continue
            # A stretch whose smallest period is shorter is a run of that period too, between the same words.
            found[start, end] = min(p, found.get((start, end), p))
        waiting += [(low, middle), (middle, high)]
    return sorted(((start, end - start, p) for (start, end), p in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, config: RunConfig) -> list[tuple[int, int, int, int]]:
    """Row, start, length and period of each run; start counts words of the row."""
    if not len(row):
        return []
    open_ = repeated_kgrams(SpanHash(data)(start, end), row, config.overlap)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], open_, [0]])))
    out = []
    first = np.searchsorted(row, np.arange(row[-1] + 1))
    for low, high in edges.reshape(-1, 2).tolist():
        cuts = [low, *(np.flatnonzero(row[low + 1 : high] != row[low : high - 1]) + low + 1).tolist(), high]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < config.least:
                continue
            ids: dict[bytes, int] = {}
            symbols = [ids.setdefault(data[x:y].tobytes(), len(ids)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            r = int(row[a])
            out += [(r, a - int(first[r]) + at, n, q) for at, n, q in main_lorentz(symbols, config)]
    return out


def find_runs(docs: DataFrame, text: str = "text", config: RunConfig = RunConfig()) -> DataFrame:
    """The rows of docs with n_words, runs (by start, then period) and collapsed: the words that no run holds after its first
    period, one blank apart."""
    names = ["n_words", "runs", "collapsed"]
    base = docs.drop(*[c for c in names if c != text])
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"runs array<{RUN}>").fields, T.StructField("collapsed", T.StringType())])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(text)):
                start, end, row = word_spans(data, offsets)
                found = runs_of(data, start, end, row, config)
                first = np.searchsorted(row, np.arange(hi - lo + 1))
                dropped = np.zeros(len(row), dtype=bool)
                for r, begin, n, q in found:
                    dropped[first[r] + begin + q : first[r] + begin + n] = True
                left = ~dropped
                body, _, places = joined_words(data, start[left], end[left], row[left], hi - lo)
                columns = list(zip(*found, strict=True)) or [()] * 4
                ends = np.searchsorted(np.array(columns[0], dtype=np.int64), np.arange(hi - lo + 1))
                runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns[1:]], fields=list(kind))
                collapsed = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), collapsed], names=[*batch.schema.names, *names]
                )

    return base.mapInArrow(search, schema)


def planted(key: Column, text: Column) -> Column:
    """The text of the registered query: of one key in ten, by its CRC-32, the words from some word on repeat those that
    follow it, with a period that the same number gives. A null key leaves its text as it is."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        return let(F.struct((g % n).alias("a"), F.floor((n - g % n) / (3 + g % 8)).cast("bigint").alias("p")), lambda x: F.array_join(
            F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, F.when(i < x.a, i).otherwise(x.a + (i - x.a) % (x.p + 1)).cast("int"))), " "
        ))

    return F.when((h % 10 == 0) & text.rlike(WORD_PATTERN), let(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 1), repeat)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, some with repetitions put in."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    picked = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("_r"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
    return picked.select(
        "doc_id", "n_runs", (-F.col("_r.start")).alias("start"), F.col("_r.length").alias("length"), (-F.col("_r.period")).alias("period"),
        F.floor(F.col("_r.length") * 1000 / -F.col("_r.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )
