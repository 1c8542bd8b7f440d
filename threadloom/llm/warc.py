"""WARC archives and their index: external merge of locally sorted capture runs.

Each task writes its pages as gzip members of WARC files of bounded size and, for each file, a run: the index entries of
its captures, sorted by URL key and time. Runs are merged by loser trees, first in groups while there are more than a
fan-in, then in ranges of keys, each by a task that seeks in every run; the ranges in order are the capture histories
of all URLs in one global order. Ranges are cut by key, time and page, so that one URL with many captures is cut too.
Reading back goes through the merged index.

Of records with equal payloads of min_revisit bytes and more, that of the smallest page is a response and the others
are revisits, which hold its headers and refer to it.

Defined results: a null payload is empty; a null URL has an empty key and no target header; rows that share the smallest
page_id of equal payloads are all responses; a null page_id is never the smallest unless all are null, which makes all
responses; extra columns are ignored; an empty table gives no rows; payloads are written and digested whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import dense_ids
from .common import materialize, new_folder

EPOCH = datetime.datetime(1970, 1, 1)
ENTRY = pa.schema([("urlkey", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
ENTRY_SQL = "urlkey string, captured bigint, page_id bigint, url string, file string, offset bigint, length bigint, record_type string, payload_digest string"


@dataclass(frozen=True)
class WarcConfig:
    min_revisit: int = 100
    #: A file is closed when it has so many bytes.
    file_bytes: int = 64 << 20
    level: int = 1
    #: Entries in a batch of a run; a merge holds one batch of each of its runs.
    run_batch: int = 2048
    fan_in: int = 256
    #: Keys by which each run tells how its entries lie.
    samples: int = 32
    #: Entries of a range of the merged index, about.
    range_entries: int = 100_000
    #: First captures of repeated payloads are broadcast if they are so many at most.
    broadcast_rows: int = 200_000
    #: Bytes of archives that a task reads back, about.
    read_bytes: int = 8 << 20


def _store(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _create(uri: str):
    from pyarrow import fs

    store, path = _store(uri)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query: com,example,www)/a?b."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    m = re.search(r"[/?]", rest)
    host, path = (rest[: m.start()], rest[m.start() :]) if m else (rest, "/")
    host = host.rpartition("@")[2].lower()
    host, _, port = host.partition(":")
    return f"{','.join(reversed(host.split('.')))}{':' + port if port else ''}){path}"


def _header(value: str) -> str:
    """A header's value: what isn't printable ASCII is percent-encoded, percent signs stay."""
    return "".join(c if " " < c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed. captured: seconds since 1970."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {(EPOCH + datetime.timedelta(seconds=captured)).isoformat()}Z",
        *([f"WARC-Target-URI: {_header(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says: its headers by lower-case name, HTTP headers likewise, and the payload it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"headers": headers, "http": {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


def with_revisits(pages: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """pages: page_id, url, payload, captured. Adds digest, revisit and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"), "captured").withColumn("digest", F.sha2("payload", 256))
    firsts = materialize(
        rows.where(F.octet_length("payload") >= config.min_revisit).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-captures"
    )
    few = firsts.limit(config.broadcast_rows + 1).count() <= config.broadcast_rows
    joined = rows.join(F.broadcast(firsts) if few else firsts, F.col("digest") == F.col("_digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "captured", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def _sort_key(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0, e[4], e[5]


def _write_run(uri: str, entries: list[tuple], config: WarcConfig) -> None:
    with _create(uri) as sink, pa.ipc.new_file(sink, ENTRY) as out:
        for i in range(0, len(entries), config.run_batch):
            out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*entries[i : i + config.run_batch], strict=True), ENTRY.types, strict=True)], schema=ENTRY))


def _sample(entries: list[tuple], n: int) -> list[tuple]:
    return [entries[len(entries) * i // n][:3] for i in range(n)] if entries else []


RUNS = "run string, warc string, n bigint, sample array<struct<urlkey:string,captured:bigint,page_id:bigint>>"


def _run_row(run: str, warc: str, n: int, sample: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("urlkey", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64())]))
    return pa.record_batch([pa.array([run]), pa.array([warc]), pa.array([n], pa.int64()), pa.array([[dict(zip(("urlkey", "captured", "page_id"), s, strict=True)) for s in sample]], kind)], names=["run", "warc", "n", "sample"])


def write_archives(pages: DataFrame, folder: str, config: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes with_revisits' rows; returns the runs. Names hold the attempt, and only runs of tasks that succeeded are listed."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, entries, at, warc = None, [], 0, ""

        def close() -> pa.RecordBatch:
            sink.close()
            entries.sort(key=_sort_key)
            run = warc.removesuffix(".warc.gz") + ".run.arrow"
            _write_run(run, entries, config)
            return _run_row(run, warc, len(entries), _sample(entries, config.samples))

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "captured", "payload", "digest", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                page_id, url, captured, payload, digest, refers_to, revisit = (c[i].as_py() for c in columns)
                if sink is None:
                    warc, at, entries = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, []
                    sink = _create(warc)
                squeeze = zlib.compressobj(config.level, zlib.DEFLATED, 31)
                raw = squeeze.compress(record(page_id, url, captured or 0, payload.encode(), digest, refers_to, revisit)) + squeeze.flush()
                sink.write(raw)
                entries.append((url_key(url), captured or 0, page_id, url, warc, at, len(raw), "revisit" if revisit else "response", digest))
                at += len(raw)
                if at >= config.file_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return materialize(pages.mapInArrow(write, RUNS), "warc-runs")


class Run:
    """A sorted run, read batch by batch from the first entry not below lo."""

    def __init__(self, uri: str, lo: tuple | None = None):
        store, path = _store(uri)
        self.source = store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.next, self.rows, self.i = 0, [], 0
        if lo is not None:  # the last batch whose first entry is below lo
            a, b = 0, self.reader.num_record_batches
            while b - a > 1:
                m = (a + b) // 2
                first = self.reader.get_batch(m).slice(0, 1).to_pylist()[0]
                a, b = (m, b) if _order((first["urlkey"], first["captured"], first["page_id"])) < lo else (a, m)
            self.next = a
        self.head: tuple | None = None
        self.advance()
        while lo is not None and self.head is not None and _order(self.head) < lo:
            self.advance()

    def advance(self) -> None:
        if self.i >= len(self.rows):
            if self.next >= self.reader.num_record_batches:
                self.head = None
                self.source.close()
                return
            columns = [c.to_pylist() for c in self.reader.get_batch(self.next).columns]
            self.rows, self.i, self.next = list(zip(*columns, strict=True)), 0, self.next + 1
        self.head = self.rows[self.i]
        self.i += 1


def _order(e: tuple) -> tuple:
    return e[0], e[1], e[2] is not None, e[2] or 0


class LoserTree:
    """Each inner node holds the run that lost there; the root's winner is replaced along its own path: log2 k comparisons an entry."""

    def __init__(self, runs: list[Run]):
        self.runs, self.k = runs, max(1, len(runs))
        self.losers = [0] * self.k
        winners = [0] * (2 * self.k)
        for i in range(self.k):
            winners[self.k + i] = i
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self._less(b, a) else (a, b)
        self.winner = winners[1] if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head, self.runs[b].head
        return x is not None and (y is None or _sort_key(x) < _sort_key(y))

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (entry := self.runs[self.winner].head) is not None:
            yield entry
            self.runs[self.winner].advance()
            now, node = self.winner, (self.winner + self.k) // 2
            while node > 0:
                if self._less(self.losers[node], now):
                    now, self.losers[node] = self.losers[node], now
                node //= 2
            self.winner = now


def _merge_groups(runs: DataFrame, folder: str, config: WarcConfig) -> DataFrame:
    """One pass: groups of fan_in runs become a run each."""
    numbered = dense_ids(runs, ["run"], "no").withColumn("g", F.floor((F.col("no") - 1) / config.fan_in))
    groups = numbered.groupBy("g").agg(F.collect_list("run").alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names in batch.column("runs").to_pylist():
                uri, n, part, sample = f"{folder}/{uuid.uuid4().hex}.run.arrow", 0, [], []
                with _create(uri) as sink, pa.ipc.new_file(sink, ENTRY) as out:
                    for e in LoserTree([Run(r) for r in names]):
                        part.append(e)
                        n += 1
                        if len(part) == config.run_batch:
                            sample.append(part[0][:3])
                            out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), ENTRY.types, strict=True)], schema=ENTRY))
                            part = []
                    if part:
                        sample.append(part[0][:3])
                        out.write_batch(pa.record_batch([pa.array(c, t) for c, t in zip(zip(*part, strict=True), ENTRY.types, strict=True)], schema=ENTRY))
                yield _run_row(uri, "", n, _sample(sample, config.samples))

    return materialize(groups.repartition("g").select("runs").mapInArrow(merge, RUNS), "warc-runs")


def merged_index(runs: DataFrame, folder: str, config: WarcConfig = WarcConfig()) -> DataFrame:
    """All entries in one order by URL key, time and page: index_part (long) and index_row (long) tell each one's place."""
    spark = runs.sparkSession
    while runs.count() > config.fan_in:
        runs = _merge_groups(runs, folder, config)
    rows = runs.orderBy("run").collect()  # fan_in at most
    total = sum(r.n for r in rows)
    # A sampled key stands for n / samples entries of its run.
    keys = sorted((_order((s.urlkey, s.captured, s.page_id)), r.n / len(r.sample)) for r in rows for s in r.sample)
    n, cuts, seen = max(1, -(-total // config.range_entries), min(8, total // 2000)), [], 0.0
    for key, weight in keys:
        if seen >= total * (len(cuts) + 1) / n and len(cuts) < n - 1 and (not cuts or key > cuts[-1]):
            cuts.append(key)
        seen += weight
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    names = [r.run for r in rows]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                lo, hi = bounds[part]
                out, at = [], 0
                schema = pa.schema([("index_part", pa.int64()), ("index_row", pa.int64()), *ENTRY])
                pack = lambda out: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                for e in LoserTree([Run(r, lo) for r in names]):
                    if hi is not None and _order(e) >= hi:
                        break
                    out.append((part, at, *e))
                    at += 1
                    if len(out) == config.run_batch:
                        yield pack(out)
                        out = []
                if out:
                    yield pack(out)

    return spark.range(0, len(bounds), 1, len(bounds)).mapInArrow(merge, f"index_part bigint, index_row bigint, {ENTRY_SQL}")


def read_archives(index: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """Fetches the record of each index entry from its archive and reads it. Tasks read about config.read_bytes of archives each,
    however many archives there are: records of one archive are read by several tasks if it is larger."""
    index = materialize(index.select("file", "offset", "length", "urlkey", "captured", "index_part", "index_row"), "warc-index")
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, source = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != open_file:
                    if source is not None:
                        source.close()
                    store, path = _store(row["file"])
                    open_file, source = row["file"], store.open_input_file(path)
                source.seek(row["offset"])
                got = parse(zlib.decompress(source.read(row["length"]), 31))
                h, revisit = got["headers"], got["headers"]["warc-type"] == "revisit"
                digest = h["warc-payload-digest"].partition(":")[2]
                if not revisit and hashlib.sha256(got["payload"]).hexdigest() != digest:
                    raise ValueError(f"the payload at {row['offset']} of {row['file']} isn't what was digested")
                out.append((int(h["x-page-id"]) if "x-page-id" in h else None, int(got["http"]["content-length"]), digest, h["warc-type"], int(h["x-refers-to-page-id"]) if revisit else None, row["urlkey"], row["captured"], row["index_part"], row["index_row"]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "index_part", "index_row"])
        if source is not None:
            source.close()

    ordered = index.repartitionByRange(max(1, -(-total // config.read_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, urlkey string, captured bigint, index_part bigint, index_row bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the archives and back; pages have no time, so that a page's is its number of seconds after 2024-01-01."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.select("page_id", "url", F.col("html").alias("payload"), (F.lit(1_704_067_200) + F.coalesce("page_id", F.lit(0))).alias("captured"))
    folder = new_folder(spark, "warc")
    runs = write_archives(with_revisits(rows), folder)
    return read_archives(merged_index(runs, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


#: The same in DuckDB, but for the columns urlkey and captured, which come from the archives.
OP8_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
u AS (SELECT d.*, f.first, regexp_replace(coalesce(regexp_extract(url, '://(.*)$', 1), ''), '#.*$', '') AS rest FROM d LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?]*')), '.')), ',') || ')' || CASE WHEN rest SIMILAR TO '[^/?]*' THEN '/' ELSE regexp_extract(rest, '[/?].*$') END AS urlkey,
  1704067200 + page_id AS captured
FROM u
"""
