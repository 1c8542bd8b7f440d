"""Runs that are published whole: tables in fresh folders, and one small manifest that is put in place last.

A manifest is never changed: each is a file of its own with the next number, renamed to its name only where no other writer
has taken it (who loses reads again and goes on from the other's). It has every run: its fingerprint, the status of its last
attempt, and the folders of its last completed one. Readers take the manifest of the largest number and read exactly the
folders it names; so a write that dies midway, or rows of attempts that failed, are in nobody's way, and what was published
before stays readable until a new version is complete. A fingerprint that is completed is not run again; one that failed, or
was left running, is tried again under its run's id.

The driver handles one file of a few hundred bytes a run; rows are written and read by tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Publication:
    """A folder of runs, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())
        self._once = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._once[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")

    # Manifests

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self) -> tuple[int, dict[int, dict]]:
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._at(f"{self.path}/manifests/{numbers[-1]:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], {int(k): v for k, v in json.loads(text).items()}

    def _change(self, change: Callable[[dict[int, dict]], object]) -> object:
        """Puts the manifest that change makes of the last one in place; again from the start if another writer was faster."""
        while True:
            number, runs = self._load()
            before = json.dumps(runs, sort_keys=True)
            out = change(runs)
            if json.dumps(runs, sort_keys=True) == before:
                return out
            draft = self._at(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
            stream = self._fs.create(draft, False)
            try:
                stream.write(json.dumps(runs, sort_keys=True).encode())
            finally:
                stream.close()
            try:
                self._context.rename(draft, self._at(f"{self.path}/manifests/{number + 1:012d}.json"), self._once)
                return out
            except Exception as e:  # the JVM's FileAlreadyExistsException, wrapped by the gateway
                self._fs.delete(draft, False)
                if number + 1 not in self._numbers():
                    raise e

    def runs(self) -> DataFrame:
        """run_id, fingerprint, status (running, completed, failed), error and rows (of all its tables, as published)."""
        rows = [(i, r["fingerprint"], r["status"], r["error"], sum(r["rows"].values()) if r["tables"] else None) for i, r in sorted(self._load()[1].items())]
        return self.spark.createDataFrame(rows, "run_id bigint, fingerprint string, status string, error string, rows bigint")

    # Writing

    def begin(self, fingerprint: str, run_id: int | None = None, again: bool = False) -> tuple[int, bool]:
        """The id of the fingerprint's run, and whether it is completed already and nothing is to be done. A run that isn't
        completed is running from here on. again: completed ones are run again, to be replaced by their new version."""

        def change(runs: dict[int, dict]) -> tuple[int, bool]:
            found = run_id if run_id in runs else next((i for i, r in runs.items() if run_id is None and r["fingerprint"] == fingerprint), None)
            if found is not None and runs[found]["status"] == "completed" and not again:
                return found, True
            at = found if found is not None else run_id if run_id is not None else max(runs, default=0) + 1
            old = runs.get(at, {"tables": None, "rows": {}})
            runs[at] = {**old, "fingerprint": fingerprint, "status": "running", "error": None, "attempt": uuid.uuid4().hex}
            return at, False

        return self._change(change)

    def _complete(self, run_id: int, tables: dict[str, str], rows: dict[str, int]) -> None:
        self._change(lambda runs: runs[run_id].update(status="completed", error=None, tables=tables, rows=rows))

    def fail(self, run_id: int, error: str) -> None:
        """Marks the attempt as failed; what the run had published before stays."""
        self._change(lambda runs: runs[run_id].update(status="failed", error=error[:2000]))

    @contextmanager
    def attempt(self, run_id: int) -> Iterator[Callable[[str, DataFrame], None]]:
        """Gives a function that writes a table; all that was written is published together when the block ends, and nothing if it raises."""
        tables: dict[str, str] = {}
        rows: dict[str, int] = {}

        def write(name: str, df: DataFrame) -> None:
            folder = f"data/{name}/run-{run_id}-{uuid.uuid4().hex}"
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{folder}")
            tables[name], rows[name] = folder, seen.get["n"]

        try:
            yield write
            self._complete(run_id, tables, rows)
        except BaseException as e:
            self.fail(run_id, f"{type(e).__name__}: {e}")
            raise

    def publish(self, fingerprint: str, tables: dict[str, DataFrame], run_id: int | None = None, again: bool = False) -> int:
        """The tables as one run; a no-op if the fingerprint is completed, unless it is to be replaced."""
        at, done = self.begin(fingerprint, run_id, again)
        if not done:
            with self.attempt(at) as write:
                for name, df in tables.items():
                    write(name, df)
        return at

    # Reading

    def read(self, table: str, schema: str | None = None, run_id: int | None = None) -> DataFrame:
        """The table's rows with run_id, of all runs that have published it or of one, as the manifest is now. schema: that of
        the rows, by which a table that nobody has published is empty; without one it raises."""
        runs = self._load()[1]
        found = [f"{self.path}/{r['tables'][table]}" for i, r in sorted(runs.items()) if r["tables"] and table in r["tables"] and run_id in (None, i)]
        if not found:
            if schema is None:
                raise ValueError(f"no run has published {table}")
            # No rows that a Python worker would have to make: the plans of what reads them shrink.
            return self.spark.range(0).select(F.from_json(F.lit("{}"), f"{schema}, run_id bigint").alias("r")).select("r.*")
        # One scan however many runs there are: the run is in the name of the folder.
        rows = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*found)
        return rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"/run-(\d+)-[0-9a-f]{32}/", 1).cast("bigint"))

    def latest(self) -> int | None:
        """The largest id among the runs that have something published."""
        return max((i for i, r in self._load()[1].items() if r["tables"]), default=None)

    def vacuum(self) -> int:
        """Deletes folders that the manifest doesn't name, and older manifests. Not while a run is running, whose folders it can't tell: it raises then."""
        number, runs = self._load()
        if any(r["status"] == "running" for r in runs.values()):
            raise RuntimeError("a run is running; mark it as failed if it is dead")
        named = {f for r in runs.values() for f in (r["tables"] or {}).values()}
        gone = 0
        data = self._at(f"{self.path}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(folder.getPath(), True))
        for n in self._numbers():
            if n < number:
                self._fs.delete(self._at(f"{self.path}/manifests/{n:012d}.json"), False)
        return gone
