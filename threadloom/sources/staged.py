"""Staged bundles: records as JSON lines with sorted keys, those that can't be written as lines of errors, and one manifest.

One pass writes all. Each task writes files of its own and says on success what they hold: names, lines, digests. The
manifest is made of what the tasks that count have said, is put in place last, and names every file; files of attempts that
failed, or ran twice, are in no manifest and are not read. If the job fails there is no manifest; the files of tasks that had
ended or failed are deleted, and what a killed one leaves is in nobody's way when the bundle is written again.

Readers refuse another contract, errors (unless they ask for them), files or lines that don't agree with the manifest, and
records of another source than the manifest's.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

CONTRACT = "2"
#: Columns by which an error names its record, where records have them.
NAMING = ("source_message_id", "source_guid", "guid", "conversation_source_id", "source_record_key")
_ERROR = "scope string, error_type string, error string, " + ", ".join(f"{c} string" for c in NAMING)


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_of(value):
    """What JSON has no form for: times in ISO form, decimals as text. Anything else raises."""
    if isinstance(value, datetime.datetime | datetime.date | datetime.time):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    raise TypeError(f"{type(value).__name__} has no form in JSON")


def line(record: dict) -> bytes:
    """One line with sorted keys; raises where a value has no form in JSON (bytes, NaN, infinite numbers, text that isn't UTF-8)."""
    return json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False, default=text_of).encode() + b"\n"


class _Lines:
    """A file that is opened with its first line."""

    def __init__(self, root: str, name: str):
        self.root, self.name, self.n, self.digest, self.sink = root, name, 0, hashlib.sha256(), None

    def write(self, text: bytes) -> None:
        if self.sink is None:
            store, path = _store(f"{self.root}/{self.name}")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.sink = store.open_output_stream(path)
        self.sink.write(text)
        self.digest.update(text)
        self.n += 1

    def close(self) -> list[tuple[str, int, str]]:
        if self.sink is None:
            return []
        self.sink.close()
        return [(self.name, self.n, self.digest.hexdigest())]


@dataclass
class Written(WriterCommitMessage):
    messages: list = field(default_factory=list)
    errors: list = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.source = {k: options[k] for k in ("source_type", "source_sha256")}
        self.parser = {k: options.get(f"parser_{k}", "") for k in ("name", "version")}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = uuid.uuid4().hex
        messages, errors = _Lines(self.root, f"messages/{name}.jsonl"), _Lines(self.root, f"errors/{name}.jsonl")
        same = {"contract_version": CONTRACT, "record_type": "message", **self.source}
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 500):
                    for record in batch.slice(at, 500).to_pylist():
                        try:
                            if not record.get("source_record_key"):
                                raise ValueError("a record needs a source_record_key")
                            messages.write(line({**record, **same}))
                        except (TypeError, ValueError) as e:
                            errors.write(line({"scope": "message", "error_type": type(e).__name__, "error": str(e)[:1000], **{c: str(record[c]) for c in NAMING if record.get(c) is not None}}))
            return Written(messages.close(), errors.close())
        except BaseException:
            messages.close()
            errors.close()
            self._delete([messages.name, errors.name])
            raise

    def commit(self, said: list[Written | None]) -> None:
        parts = [w for w in said if w is not None]
        files = {kind: sorted(f for w in parts for f in getattr(w, kind)) for kind in ("messages", "errors")}
        manifest = {
            "contract_version": CONTRACT, "source": self.source, "parser": self.parser, "counts": {k: sum(f[1] for f in v) for k, v in files.items()},
            "files": {k: [dict(zip(("name", "lines", "sha256"), f, strict=True)) for f in v] for k, v in files.items()},
        }
        store, root = _store(self.root)
        store.create_dir(root, recursive=True)
        draft = f"{root}/.manifest-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(line(manifest))
        store.move(draft, f"{root}/manifest.json")

    def abort(self, said: list[Written | None]) -> None:
        self._delete([f[0] for w in said if w is not None for f in [*w.messages, *w.errors]])

    def _delete(self, names: list[str]) -> None:
        from pyarrow import fs

        for name in names:
            store, path = _store(f"{self.root}/{name}")
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)


class StagedBundle(DataSource):
    """Format "staged_bundle", to write: options path, source_type, source_sha256, parser_name, parser_version."""

    @classmethod
    def name(cls) -> str:
        return "staged_bundle"

    def writer(self, schema: T.StructType, overwrite: bool) -> StagedWriter:
        return StagedWriter(dict(self.options))


def write_staged(records: DataFrame, path: str, source_type: str, source_sha256: str, parser: tuple[str, str] = ("", "")) -> None:
    """Records (with a source_record_key) as a bundle. A folder that has a manifest already is refused."""
    spark = records.sparkSession
    if manifest_of(path) is not None:
        raise ValueError(f"{path} holds a bundle already")
    spark.dataSource.register(StagedBundle)
    options = {"path": path, "source_type": source_type, "source_sha256": source_sha256, "parser_name": parser[0], "parser_version": parser[1]}
    records.write.format("staged_bundle").options(**options).mode("append").save()


def manifest_of(path: str) -> dict | None:
    """The manifest, one small file; None if there is none."""
    from pyarrow import fs

    store, root = _store(path.rstrip("/"))
    if store.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _lines(spark: SparkSession, path: str, manifest: dict, kind: str, schema: str) -> DataFrame:
    """The lines of the files that the manifest names; raises where a file is missing, or has other lines than it says."""
    files = manifest["files"][kind]
    if not files:
        return spark.createDataFrame([], schema)
    names = [f"{path.rstrip('/')}/{f['name']}" for f in files]
    told = spark.createDataFrame([(f["name"].rsplit("/", 1)[1], f["lines"]) for f in files], "file string, lines bigint")
    have = spark.read.text(names).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("n"))
    wrong = told.join(have, "file", "left").where("NOT n <=> lines").agg(F.count("*"), F.min("file")).first()
    if wrong[0]:
        raise ValueError(f"{wrong[0]} files have other lines than the manifest says, {wrong[1]} is one")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(names)


def read_staged(spark: SparkSession, path: str, schema: str, allow_errors: bool = False) -> DataFrame:
    """The records of a bundle, once all gates are passed. schema: that of the records, without the fields of the contract."""
    manifest = manifest_of(path)
    if manifest is None or manifest.get("contract_version") != CONTRACT:
        raise ValueError("no manifest of this contract")
    counts = manifest["counts"]
    if counts["errors"] and not allow_errors:
        raise ValueError(f"the bundle has {counts['errors']} errors")
    for kind in ("messages", "errors"):
        if counts[kind] != sum(f["lines"] for f in manifest["files"][kind]):
            raise ValueError(f"the manifest says {counts[kind]} {kind}, its files have others")
    kept = [f.name for f in T._parse_datatype_string(schema).fields]
    extra = [c for c in ("contract_version", "source_type", "source_sha256") if c not in kept]
    rows = _lines(spark, path, manifest, "messages", ", ".join([schema, *[f"{c} string" for c in extra]]))
    own = {"contract_version": CONTRACT, **manifest["source"]}
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(v) for c, v in own.items()])
    if rows.where(~same).limit(1).count():
        raise ValueError("a record is of another source or contract than the manifest")
    return rows.select(*kept)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """scope, error_type, error and what names the record, for each record that couldn't be written."""
    manifest = manifest_of(path)
    if manifest is None:
        raise ValueError("no manifest")
    return _lines(spark, path, manifest, "errors", _ERROR)

