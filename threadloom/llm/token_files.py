"""Token-ID / binary output: Arrow files of fixed-size lists.

Documents are dealt by ranges of their key and sorted; each task encodes its documents, appends an end id, packs the
stream of ids into sequences of one length and writes them, with a mask of what is not padding, as record batches of
fixed-size lists of an Arrow IPC file. Every sequence of a file lies at a known place, so that a mapped file gives it
without a copy (`Sequences`). Beside each file stands an index of its documents (key, start, n_tokens).

File names hold the attempt; only files named in the manifest, written when a task has succeeded, count, so that retried
and speculative tasks do no harm. Folders are opened by URI with pyarrow.fs, and may be on any store it knows.

Defined results: a null or empty text is its end id alone; rows with equal keys stay, in the order of their texts; null
keys come first; extra columns are ignored; an empty table gives no rows; texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, text_slices

MANIFEST = "part int, file string, index string, n_docs bigint, n_tokens bigint, n_slices int"
#: Slices of an index that one task reads back: some 64 MB of text.
READ_SLICES = 64
#: What the byte-level BPE's own pattern takes as white space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Pieces of a text at whose edges that pattern always parts: a run of other characters with one blank before it, or white space.
_UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@dataclass(frozen=True)
class TokenFormat:
    tokenizer: str
    end_id: int = 2
    sequence_length: int = 2048
    #: Sequences in a record batch.
    batch_sequences: int = 256
    #: Units whose ids a worker remembers; further units are encoded each time.
    remembered: int = 600_000
    #: New units that are encoded as one string.
    joined: int = 256


def default_format() -> TokenFormat:
    import public_tokenizers

    return TokenFormat(public_tokenizers.path("byte_bpe_50k.json"))


class Encoder:
    """Ids of texts as the tokenizers library gives them. Where its pre-tokenizer is the byte-level pattern, the ids of a
    text are those of its units one after the other, and units seen before aren't encoded again."""

    def __init__(self, fmt: TokenFormat):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(fmt.tokenizer)
        # Tokens that were added to the vocabulary are found in a text before it is cut into units.
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), fmt.end_id + 1) <= 65536 else "<u4")
        self.by_unit = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.known: dict[str, bytes] = {}
        self.most = fmt.remembered
        self.joined = fmt.joined
        self.end = np.array([fmt.end_id], dtype=self.dtype).tobytes()
        # Tokens that begin with a blank: of units that do, these are the first ones.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if self.by_unit:
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> dict[str, bytes]:
        """The ids of each unit. Those with a blank before them are encoded many in one string, which is cut again where
        a token opens with a blank."""
        open_, rest = [], []
        for u in units:
            (open_ if u[0] == " " and len(u) > 1 and u[1] not in _SPACE else rest).append(u)
        out = dict(zip(rest, self._encode(rest), strict=True))
        groups = [open_[i : i + self.joined] for i in range(0, len(open_), self.joined)]
        size = self.dtype.itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not part its units at blanks")
            raw, ends = ids.tobytes(), [*(cuts[1:] * size).tolist(), len(ids) * size]
            at = 0
            for u, end in zip(group, ends, strict=True):
                out[u] = raw[at:end]
                at = end
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as bytes."""
        if not self.by_unit:
            return [x + self.end for x in self._encode(texts)]
        known, find, out = self.known, _UNIT.findall, []
        if self.added is not None and any(map(self.added.search, texts)):
            # Texts with one are encoded whole, the others by units.
            plain = [i for i, t in enumerate(texts) if not self.added.search(t)]
            ids = dict(zip(plain, self([texts[i] for i in plain]), strict=True))
            return [ids[i] if i in ids else self._encode([t])[0] + self.end for i, t in enumerate(texts)]
        split = [find(t) for t in texts]
        new = set().union(*split).difference(known)
        fresh = self._units(list(new))
        if len(known) + len(fresh) <= self.most:
            known.update(fresh)
            fresh = {}
        for units in split:
            if fresh and not fresh.keys().isdisjoint(units):
                out.append(b"".join([known[u] if u in known else fresh[u] for u in units]) + self.end)
            else:
                out.append(b"".join([known[u] for u in units]) + self.end)
        return out


_encoders: dict[TokenFormat, Encoder] = {}


def encoder(fmt: TokenFormat) -> Encoder:
    if fmt not in _encoders:
        _encoders[fmt] = Encoder(fmt)
    return _encoders[fmt]


def _file(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if path.count("/") and isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store, path


class _Packer:
    """Writes a stream of ids to a file of fixed-size lists."""

    def __init__(self, uri: str, fmt: TokenFormat, dtype: np.dtype):
        self.n, self.rows, self.dtype = fmt.sequence_length, fmt.batch_sequences, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), self.n)), ("mask", pa.list_(pa.bool_(), self.n))])
        store, path = _file(uri)
        self.sink = store.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.bytes = self.total = 0

    def add(self, ids: bytes) -> None:
        self.waiting.append(ids)
        self.bytes += len(ids)
        self.total += len(ids) // self.dtype.itemsize
        if self.bytes >= self.n * self.rows * self.dtype.itemsize:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype=self.dtype)
        step = self.n * self.rows
        at = 0
        while len(ids) - at >= step or last and at < len(ids):
            part = ids[at : at + step]
            at += len(part)
            pad = -len(part) % self.n
            mask = np.ones(len(part) + pad, dtype=bool)
            if pad:
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(pad, dtype=self.dtype)])
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.n), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.n)], schema=self.schema))
        self.waiting = [ids[at:].tobytes()]
        self.bytes = len(self.waiting[0])

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


def write_sequences(docs: DataFrame, key: str, text: str, folder: str, fmt: TokenFormat) -> DataFrame:
    """Writes the documents in ascending order of their key; returns the manifest, a row for each file in order."""
    kind = pa.int64() if docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    ordered = docs.select(F.col(f"`{key}`").cast("bigint" if kind == pa.int64() else "string").alias("key"), F.col(f"`{text}`").alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, starts, index_writer, slices = TaskContext.get().partitionId(), None, 0, None, 0
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}"
        schema = pa.schema([("key", kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        encode, n_docs = encoder(fmt), 0
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, _, _ in text_slices(texts):
                if packer is None:
                    packer = _Packer(f"{name}.arrow", fmt, encode.dtype)
                    store, path = _file(f"{name}.index.arrow")
                    sink = store.open_output_stream(path)
                    index_writer = pa.ipc.new_file(sink, schema)
                ids = encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                sizes = np.array([len(x) for x in ids], dtype=np.int64) // encode.dtype.itemsize
                index_writer.write_batch(pa.record_batch([batch.column("key").slice(lo, hi - lo), pa.array(starts + np.cumsum(sizes) - sizes), pa.array(sizes)], schema=schema))
                starts += int(sizes.sum())
                slices += 1
                n_docs += len(ids)
                for x in ids:
                    packer.add(x)
        if packer is not None:
            packer.close()
            index_writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{name}.arrow"], "index": [f"{name}.index.arrow"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([packer.total], pa.int64()), "n_slices": pa.array([slices], pa.int32())})

    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


class Sequences:
    """A written file: sequence i and its mask, without a copy where the file can be mapped."""

    def __init__(self, uri: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.batches = self.reader.num_record_batches
        self.rows = self.reader.get_batch(0).num_rows if self.batches else 0
        self.length = self.reader.schema.field("ids").type.list_size

    def batch(self, i: int, column: str = "ids") -> np.ndarray:
        """Record batch i as a matrix; sequences are its rows."""
        flat = self.reader.get_batch(i).column(column).flatten()
        return flat.to_numpy(zero_copy_only=column == "ids").reshape(-1, self.length)

    def sequence(self, i: int, column: str = "ids") -> np.ndarray:
        return self.batch(i // self.rows, column)[i % self.rows]

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, n of them, piece by piece."""
        step = self.rows * self.length
        while n > 0:
            flat = self.batch(start // step).reshape(-1)[start % step : start % step + n]
            yield flat
            start, n = start + len(flat), n - len(flat)

    def close(self) -> None:
        self.source.close()


def read_documents(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Each document as the files have it: key, start among all ids, n_tokens and the CRC-32 of its ids as 32-bit little-endian integers.

    A task reads READ_SLICES slices of one file's index and the ids that they point to; files open at any place.
    """
    # A row for each file: numbering them in one partition costs as much as there are files.
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pieces = based.select("file", "index", "base", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1, F.lit(READ_SLICES))).alias("first"), "n_slices")
    n = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("n_slices") / READ_SLICES)), F.lit(0)).alias("n")).first().n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, (store, path) = Sequences(row["file"]), _file(row["index"])
                with store.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for i in range(row["first"], min(row["first"] + READ_SLICES, row["n_slices"])):
                        part = index.get_batch(i)
                        sums = []
                        for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for ids in file.span(start, n):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        starts = pa.array(np.asarray(part.column("start")) + row["base"])
                        yield pa.RecordBatch.from_arrays([part.column("key"), starts, part.column("n_tokens"), pa.array(sums, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])
                file.close()

    # Dealt by number, one piece to a task: rows this small would all be put into one otherwise.
    return pieces.repartition(max(1, int(n))).mapInArrow(read, f"key {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_sequences(docs, "doc_id", "text", new_folder(spark, "tokens"), default_format())
    return read_documents(manifest).withColumnRenamed("key", "doc_id")
