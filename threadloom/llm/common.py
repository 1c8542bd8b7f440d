"""What the operators of this subpackage share: the shared folder, Arrow text buffers, word and span hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..session import shared_dir

#: The white space that parts words: blank and \t \n \v \f \r. Any other byte belongs to a word.
WS = np.zeros(256, dtype=bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that are worked on at once; a longer single text is still taken whole.
SLICE_BYTES = 1 << 20


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str, made: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors don't matter. The folder is
    added to `made`, for whoever deletes it when nothing reads it any more."""
    path = new_folder(df.sparkSession, label)
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM collect what it no longer holds, so that Spark's cleaner deletes the shuffle files of finished jobs
    now; by itself it would when the driver's memory fills, however full the disks are."""
    spark._jvm.System.gc()


def open_store(uri: str):
    """The file system of a folder or file, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a string column, their UTF-8 bytes and the offsets of the rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over an array of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """Hashes of any byte span of a buffer from prefix sums: sum of T[b_i] * B^(i - start), mod 2^64, then mixed."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) & (2**64 - 1)
        self.base = (self.base & ~7) | 5  # 5 mod 8: of the largest order
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64((seed * 0x51_7CC1B7 + 1) % 2**63))
        up, self.down = self._tables(len(data) + 1, seed)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * up[: len(data)], out=self.prefix[1:])

    def _tables(self, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(seed)
        if have is None or len(have[0]) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = pow(self.base, -1, 2**64)
            tables = []
            for b in (self.base, inverse):
                step = np.full(size, np.uint64(b))
                step[0] = 1
                with np.errstate(over="ignore"):
                    tables.append(np.multiply.accumulate(step))
            have = (tables[0], tables[1])
            if n <= 8 * SLICE_BYTES:
                self._powers[seed] = have
        return have

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each stretch of true bytes that no row's edge cuts, and the row it belongs to."""
    if not len(inside):
        return (np.zeros(0, np.int64),) * 3
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the buffer, and the row it belongs to."""
    return spans_of(~WS[data], offsets)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """As threadloom.operators.graph has it, the state of each round as a table; a table goes when the next one is there."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        paths.append(new_folder(spark, "edges"))
        df.write.parquet(paths[-1])
        if len(paths) > 1:
            delete(spark, paths[-2])
        return spark.read.schema(df.schema).parquet(paths[-1])

    return graph.components(edges, keep)


def bounded_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` rows, those of the smallest hash of the columns `by`, or all if there are no more: rows are kept by a
    threshold on the hash, so that no task sends more to the driver than its share. Equal tables give equal samples."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(*by), 1) < F.lit(int(most / n * 2**63)))


def bare_lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased, and nothing else."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row one blank apart: the bytes, where each word starts in them, and the offsets of the rows."""
    length = end - start
    blank = np.zeros(len(row), dtype=np.int64)
    blank[:-1] = row[1:] == row[:-1]
    at = np.cumsum(length + blank) - length - blank
    out = np.full(int((length + blank).sum()), 0x20, dtype=np.uint8)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[step + np.repeat(at, length)] = data[step + np.repeat(start, length)]
    size = np.bincount(row, weights=length + blank, minlength=n_rows).astype(np.int64)
    return out, at, np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])


def sql_crc32(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    steps = f"flatten(list_transform({octets}, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"
