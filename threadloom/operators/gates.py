"""Gates between stages: bundles against their own report, sources against what came of them, published rows before they are
read, results against a second derivation; and the moves from older schemas. Faults are rows (…, code, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views as vw
from .integrity import _n

MANIFEST = "source struct<type:string,sha256:string>, counts struct<unsupported:bigint,duplicates:bigint,reconciliation_errors:bigint>"
REPORT = """reconciliation_version string, status string, ok boolean, source struct<type:string,sha256:string,actual_sha256:string>, bundle struct<messages_jsonl_records:bigint,errors_jsonl_records:bigint>,
  checks map<string,boolean>, failed_checks array<string>, parse_failures array<string>, unsupported_records array<string>, duplicate_records array<string>"""
# Columns of a published reconciliation that must be 0, and those that must be equal.
ZERO = ("membership_count_delta", "invalid_response_session_count", "invalid_silence_session_count", "invalid_event_session_count")
EQUAL = ("a4_source_membership_count", "a3_processed_membership_count", "sender_accounted_membership_count")


def bundle_faults(bundles: DataFrame, messages: DataFrame, errors: DataFrame) -> DataFrame:
    """Bundles (bundle_id, manifest and report as JSON) against their rows (bundle_id): (bundle_id, code). A bundle whose
    manifest or report is missing or no JSON has that fault alone."""
    count = lambda rows, name: rows.groupBy("bundle_id").agg(F.count("*").alias(name))
    b = bundles.select("bundle_id", F.col("manifest").alias("_m"), F.col("report").alias("_r"), F.from_json("manifest", MANIFEST).alias("m"), F.from_json("report", REPORT).alias("r"))
    b = b.join(count(messages, "_messages"), "bundle_id", "left").join(count(errors, "_errors"), "bundle_id", "left").fillna(0, ["_messages", "_errors"])
    valid = lambda c: F.is_valid_utf8(c) & F.coalesce(F.json_object_keys(c).isNotNull(), F.lit(False))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    length = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    differ = lambda x, y: ~x.eqNullSafe(y)
    m, r = lambda path: F.col(f"m.{path}"), lambda path: F.col(f"r.{path}")
    ready = valid(F.col("_m")) & valid(F.col("_r"))
    alone = {
        "RECONCILIATION_MANIFEST_MISSING": F.col("_m").isNull(), "RECONCILIATION_MANIFEST_INVALID": F.col("_m").isNotNull() & ~valid(F.col("_m")),
        "RECONCILIATION_MISSING": valid(F.col("_m")) & F.col("_r").isNull(), "RECONCILIATION_INVALID": valid(F.col("_m")) & F.col("_r").isNotNull() & ~valid(F.col("_r")),
    }
    checks = {
        "RECONCILIATION_VERSION_UNSUPPORTED": differ(r("reconciliation_version"), F.lit("1")),
        "RECONCILIATION_FAILED": differ(r("status"), F.lit("ok")) | differ(r("ok"), F.lit(True)),
        "RECONCILIATION_FAILED_CHECKS": some(r("failed_checks")),
        "RECONCILIATION_PARSE_FAILURES": some(r("parse_failures")),
        "RECONCILIATION_INTERNAL_CHECK_FAILED": F.exists(F.coalesce(F.map_values(r("checks")), F.array().cast("array<boolean>")), lambda v: ~F.coalesce(v, F.lit(False))),
        "RECONCILIATION_SOURCE_TYPE_MISMATCH": differ(r("source.type"), m("source.type")),
        "RECONCILIATION_SOURCE_SHA_MISMATCH": differ(r("source.sha256"), m("source.sha256")) | differ(r("source.actual_sha256"), m("source.sha256")),
        "RECONCILIATION_MESSAGE_COUNT_MISMATCH": differ(r("bundle.messages_jsonl_records"), F.col("_messages")),
        "RECONCILIATION_ERROR_COUNT_MISMATCH": differ(r("bundle.errors_jsonl_records"), F.col("_errors")),
        "RECONCILIATION_UNSUPPORTED_COUNT_MISMATCH": differ(m("counts.unsupported"), length(r("unsupported_records"))),
        "RECONCILIATION_DUPLICATE_COUNT_MISMATCH": differ(m("counts.duplicates"), length(r("duplicate_records"))),
        "A1_RECONCILIATION_ERRORS": F.coalesce(m("counts.reconciliation_errors"), F.lit(0)) != 0,
    }
    cases = {**alone, **{code: ready & c for code, c in checks.items()}}
    return b.select("bundle_id", F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in cases.items()]))).alias("code"))


def source_accounts(inventory: DataFrame, **outcomes: DataFrame) -> DataFrame:
    """inventory and each outcome (say emitted, errors, unsupported, duplicates): source_key. Every key of the inventory must
    have one outcome; a key twice in the inventory needs two, and so on."""
    told = reduce(DataFrame.unionByName, [rows.groupBy("source_key").agg(F.count("*").alias("_told")) for rows in outcomes.values()]).groupBy("source_key").agg(F.sum("_told").alias("_told"))
    both = inventory.groupBy("source_key").agg(F.count("*").alias("_have")).join(told, "source_key", "full").fillna(0, ["_have", "_told"])
    return vw.issues(_n(both.where("_told < _have"), "SOURCE_RECORD_UNACCOUNTED"), _n(both.where("_have > 0 AND _told > _have"), "SOURCE_RECORD_ACCOUNTED_TWICE"), _n(both.where("_have = 0"), "OUTCOME_WITHOUT_SOURCE"))


def reader_faults(published: DataFrame, wanted: DataFrame) -> DataFrame:
    """Published reconciliations of conversations against the invariants, and what is wanted (conversation_id) but has no
    reconciliation that is ok: (conversation_id, code). Columns that an older publication lacks are not judged."""
    have = set(published.columns)
    off = lambda c, v: ~F.col(c).cast("bigint").eqNullSafe(F.lit(v))
    checks = [(f"{c.upper()}_NOT_ZERO", off(c, 0)) for c in ZERO if c in have]
    if "uses_latest_processing_run" in have:
        checks.append(("PROCESSING_RUN_NOT_LATEST", off("uses_latest_processing_run", 1)))
    if have.issuperset(EQUAL):
        first, *rest = (F.col(c) for c in EQUAL)
        checks.append(("MEMBERSHIPS_UNACCOUNTED", first.isNull() | reduce(lambda x, y: x | y, [F.coalesce(c != first, F.lit(True)) for c in rest])))
    rows = published.select("conversation_id", F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in checks], F.lit(None).cast("string")))).alias("code"))
    twice = published.groupBy("conversation_id").count().where("count > 1").select("conversation_id", F.lit("RECONCILIATION_DUPLICATE").alias("code"))
    per = published.groupBy("conversation_id").agg(F.min(F.coalesce(F.col("reconciliation_ok").cast("int"), F.lit(0))).alias("_ok"))
    asked = wanted.select("conversation_id").distinct().join(per, "conversation_id", "left").where("_ok IS NULL OR _ok <> 1").select("conversation_id", F.when(F.col("_ok").isNull(), "RECONCILIATION_ROW_MISSING").otherwise("RECONCILIATION_NOT_OK").alias("code"))
    return rows.unionByName(twice).unionByName(asked)


def metrics_differ(told: DataFrame, again: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Results against a second derivation of them: rows that one side lacks, and for each metric the rows that differ by more
    than the tolerance or in being null. One join; keys may be null."""
    b = again.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(x).alias(f"_{x}") for x in metrics], F.lit(True).alias("_b"))
    both = told.select(*keys, *metrics, F.lit(True).alias("_a")).join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full")
    off = lambda x: F.when(F.col(x).isNull() | F.col(f"_{x}").isNull(), F.col(x).isNull() != F.col(f"_{x}").isNull()).otherwise(F.abs(F.col(x) - F.col(f"_{x}")) > tolerance)
    per = both.agg(F.count_if(F.col("_a").isNull()).alias("ROW_MISSING"), F.count_if(F.col("_b").isNull()).alias("ROW_UNEXPECTED"), *[F.count_if(F.col("_a") & F.col("_b") & off(x)).alias(f"{x.upper()}_DIFFERS") for x in metrics])
    return vw.issues(per.select(F.expr(f"stack({len(per.columns)}, " + ", ".join(f"'{c}', {c}" for c in per.columns) + ") AS (code, n)")))


def backfill_sha(runs: DataFrame) -> DataFrame:
    """source_sha256 from the metadata of runs that have none: `source.sha256`, where the metadata is JSON."""
    return runs.withColumn("source_sha256", F.coalesce("source_sha256", F.get_json_object("metadata_json", "$.source.sha256")))


def backfill_conversation_sources(legacy: DataFrame, runs: DataFrame, message_sources: DataFrame, messages: DataFrame) -> DataFrame:
    """Older conversation sources with a snapshot key (digest, else fingerprint, else a key of their own), and the relations
    that only message sources know: one for each (type, snapshot, source conversation) not there yet, of the least conversation."""
    key = F.coalesce("_sha", F.concat(F.lit("fingerprint:"), "_print"))
    r = runs.select("import_run_id", F.col("source_sha256").alias("_sha"), F.col("source_fingerprint").alias("_print"))
    cols = ["conversation_id", "import_run_id", "source_type", "source_snapshot_key", F.col("_sha").alias("source_sha256"), "source_conversation_id"]
    old = legacy.join(r, "import_run_id", "left").withColumn("source_snapshot_key", F.coalesce(key, F.concat(F.lit("legacy-conversation-source:"), F.col("conversation_source_id").cast("string"))))
    old = old.select("conversation_source_id", *cols, F.lit(None).cast("string").alias("recovered_from"))
    named = message_sources.where("source_conversation_id <> ''").select("message_id", "import_run_id", "source_type", "source_conversation_id")
    found = named.join(messages.select("message_id", "conversation_id"), "message_id").join(r, "import_run_id").withColumn("source_snapshot_key", key).where("source_snapshot_key IS NOT NULL")
    unique = ["source_type", "source_snapshot_key", "source_conversation_id"]
    first = found.groupBy(*unique).agg(F.min(F.struct("conversation_id", "import_run_id", "_sha")).alias("f")).join(old.select(*unique).distinct(), unique, "left_anti")
    new = first.select(F.lit(None).cast("bigint").alias("conversation_source_id"), "f.conversation_id", "f.import_run_id", "source_type", "source_snapshot_key", F.col("f._sha").alias("source_sha256"), "source_conversation_id", F.lit("message_source").alias("recovered_from"))
    return old.unionByName(new)


def backfill_links(message_sources: DataFrame, runs: DataFrame, conversation_sources: DataFrame, memberships: DataFrame) -> DataFrame:
    """The membership behind each message source: by type, snapshot and source conversation, and the conversation these name."""
    r = runs.select("import_run_id", F.coalesce("source_sha256", F.concat(F.lit("fingerprint:"), "source_fingerprint")).alias("source_snapshot_key"))
    c = conversation_sources.select("conversation_source_id", "conversation_id", "source_type", "source_snapshot_key", "source_conversation_id")
    s = message_sources.where("source_conversation_id <> ''").select("message_source_id", "message_id", "import_run_id", "source_type", "source_conversation_id").join(r, "import_run_id")
    return s.join(c, ["source_type", "source_snapshot_key", "source_conversation_id"]).join(memberships.select("membership_id", "message_id", "conversation_id"), ["message_id", "conversation_id"]).select("message_source_id", "conversation_source_id", "membership_id", F.lit(0).cast("bigint").alias("position"))


def schema_actions(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """have and wanted: object, version. What to do with each: create, keep, rebuild (older), refuse (newer) or leave (not wanted)."""
    h = have.select("object", F.col("version").alias("_have"))
    action = F.when(F.col("version").isNull(), "leave").when(F.col("_have").isNull(), "create").when(F.col("_have") < F.col("version"), "rebuild").when(F.col("_have") > F.col("version"), "refuse").otherwise("keep")
    return wanted.select("object", "version").join(h, "object", "full").select("object", action.alias("action"))


def report(checks: DataFrame) -> DataFrame:
    """Checks (code, n, severity) as one row: status, a JSON report with sorted keys, and the digest of that report."""
    each = F.sort_array(F.collect_list(F.struct("code", "n", "severity")))
    worst = F.max(F.when(F.col("severity") == "ERROR", 2).when(F.col("severity") == "WARNING", 1).otherwise(0))
    one = checks.agg(each.alias("checks"), F.when(worst == 2, "FAIL").when(worst == 1, "WARNING").otherwise("PASS").alias("status"))
    return one.select("status", F.to_json(F.struct("checks", "status")).alias("report")).withColumn("fingerprint", F.sha2("report", 256))


RECORD = """source_record_key string, contract_version string, record_type string, source_type string, source_sha256 string, source_guid string, source_message_id string, conversation_source_id string, timestamp_utc string,
  timestamp_raw string, conversation_sources string, attachments string"""
STAGING_MANIFEST = """contract_version string, source struct<type:string,sha256:string,snapshot_method:string,snapshot_includes_committed_wal:boolean>, parser struct<name:string,version:string>, outputs struct<messages:string>,
  counts struct<messages_seen:bigint,messages_emitted:bigint,attachments_seen:bigint,errors:bigint>, source_record_key struct<version:string,scope:string>"""
# What a snapshot of a chat database must declare.
CHAT_TYPE, CHAT_KEY_VERSION, CHAT_KEY_SCOPE, CHAT_SNAPSHOT = "imessage_chat_db", "2", "source_snapshot+message_rowid", "sqlite_online_backup_v1"


def staging_faults(lines: DataFrame, manifests: DataFrame) -> DataFrame:
    """Staged bundles as they lie in files against their contract: (bundle_id, code, severity, n). lines: bundle_id, value (a
    line of the messages); manifests: bundle_id, manifest (JSON). Records are judged line by line without Python, counts and
    repeated keys by one aggregate each; a bundle without a manifest that is JSON has only faults of that and of its lines."""
    from . import canonical as ca

    sha = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    valid = lambda c: F.try_parse_json(c).isNotNull()
    m = manifests.select("bundle_id", F.col("manifest").alias("_json"), F.when(F.json_object_keys("manifest").isNotNull(), F.from_json("manifest", STAGING_MANIFEST)).alias("m"))
    rows = lines.select("bundle_id", "value", F.from_json("value", RECORD).alias("r"), F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False)).alias("_object")).join(m.select("bundle_id", "m"), "bundle_id", "left")
    r, q = lambda name: F.col(f"r.{name}"), lambda name: F.col(f"m.{name}")
    chat = q("source.type").eqNullSafe(F.lit(CHAT_TYPE))
    told = F.col("m").isNotNull() & F.col("_object")
    differ = lambda x, y: ~x.eqNullSafe(y)
    by_row = ca.stable_key(q("source.sha256"), F.lit("message"), r("source_message_id"))
    by_ids = ca.stable_key(q("source.sha256"), r("source_guid"), r("source_message_id"), r("conversation_source_id"))
    version = q("source_record_key.version")
    key = F.when(sha(q("source.sha256")), F.when(chat & (version == CHAT_KEY_VERSION), by_row).when(version == "1", by_ids))
    array = lambda c: F.from_json(c, "array<string>")
    is_list = lambda c: c.rlike(r"^\s*\[")
    relations, files = F.when(is_list(r("conversation_sources")), array(r("conversation_sources"))), F.when(is_list(r("attachments")), array(r("attachments")))
    objects = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.json_object_keys(x).isNotNull())
    field = lambda a, name: F.transform(objects(a), lambda x: F.get_json_object(x, f"$.{name}"))
    size = lambda a: F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)).cast("bigint")
    names = F.filter(field(relations, "source_conversation_key"), lambda x: x.isNotNull() & (x != ""))
    one = lambda condition: F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0).cast("bigint")
    untimed = blank(r("timestamp_utc")) & r("timestamp_raw").isNotNull()
    per_line = {
        "EMPTY_LINE": one(F.trim("value") == ""), "MESSAGE_JSON_INVALID": one((F.trim("value") != "") & ~valid(F.col("value"))), "MESSAGE_NOT_OBJECT": one(valid(F.col("value")) & ~F.col("_object")),
        "SOURCE_RECORD_KEY_INVALID": one(told & ~sha(r("source_record_key"))), "CONTRACT_VERSION_MISMATCH": one(told & differ(r("contract_version"), q("contract_version"))), "RECORD_TYPE_INVALID": one(told & differ(r("record_type"), F.lit("message"))),
        "SOURCE_TYPE_MISMATCH": one(told & differ(r("source_type"), q("source.type"))), "SOURCE_SHA256_MISMATCH": one(told & differ(r("source_sha256"), q("source.sha256"))), "SOURCE_MESSAGE_ID_MISSING": one(told & blank(r("source_message_id"))),
        "SOURCE_CONVERSATION_ID_MISSING": one(told & blank(r("conversation_source_id"))), "SOURCE_RECORD_KEY_CONTRACT_UNKNOWN": one(told & key.isNull()), "SOURCE_RECORD_KEY_MISMATCH": one(told & key.isNotNull() & differ(r("source_record_key"), key)),
        "TIMESTAMP_INVALID": one(told & ~blank(r("timestamp_utc")) & ca.parse_timestamp(r("timestamp_utc"))["us"].isNull()), "IMESSAGE_TIMESTAMP_CONVERSION_MISSING": one(told & chat & untimed), "TIMESTAMP_UNNORMALIZED": one(told & ~chat & untimed),
        "CONVERSATION_SOURCES_NOT_LIST": one(told & ~is_list(r("conversation_sources"))), "CONVERSATION_SOURCE_NOT_OBJECT": F.when(told, size(relations) - size(objects(relations))).otherwise(0), "CONVERSATION_SOURCE_KEY_MISSING": F.when(told, size(objects(relations)) - size(names)).otherwise(0),
        "CONVERSATION_SOURCE_DUPLICATE": F.when(told, size(names) - size(F.array_distinct(names))).otherwise(0), "IMESSAGE_CONVERSATION_SOURCES_MISSING": one(told & chat & (F.size(names) == 0)),
        "ATTACHMENTS_NOT_LIST": one(told & ~is_list(r("attachments"))), "ATTACHMENT_NOT_OBJECT": F.when(told, size(files) - size(objects(files))).otherwise(0),
        "ATTACHMENT_SOURCE_ID_MISSING": F.when(told, size(F.filter(field(files, "source_attachment_id"), blank))).otherwise(0), "ATTACHMENT_SHA256_INVALID": F.when(told, size(F.filter(field(files, "sha256"), lambda x: x.isNotNull() & ~sha(x)))).otherwise(0),
    }
    sums = rows.groupBy("bundle_id").agg(*[F.sum(c).alias(code) for code, c in per_line.items()], F.count_if("_object").alias("_records"), F.sum(F.when(F.col("_object"), size(files)).otherwise(0)).alias("_files"))
    keys = rows.where(told & sha(r("source_record_key"))).groupBy("bundle_id", r("source_record_key").alias("k")).agg((F.count("*") - 1).alias("c")).groupBy("bundle_id").agg(F.sum("c").alias("SOURCE_RECORD_KEY_DUPLICATE"))
    b = m.withColumn("_manifest", F.lit(True)).join(sums, "bundle_id", "full").join(keys, "bundle_id", "left").withColumns({"_lines": F.col("_records").isNotNull(), "_records": F.coalesce("_records", F.lit(0)), "_files": F.coalesce("_files", F.lit(0))})
    have, chat = F.col("m").isNotNull(), q("source.type").eqNullSafe(F.lit(CHAT_TYPE))
    count = lambda name: q(f"counts.{name}")
    per_bundle = {
        "MANIFEST_MISSING": one(F.col("_json").isNull()), "MANIFEST_INVALID": one(F.col("_json").isNotNull() & ~have), "MESSAGES_MISSING": one(F.col("_manifest") & ~F.col("_lines")),
        "CONTRACT_VERSION_UNSUPPORTED": one(have & differ(q("contract_version"), F.lit("1"))), "MANIFEST_SOURCE_INVALID": one(have & q("source").isNull()), "MANIFEST_PARSER_INVALID": one(have & (blank(q("parser.name")) | blank(q("parser.version")))),
        "MANIFEST_OUTPUTS_INVALID": one(have & blank(q("outputs.messages"))), "MANIFEST_COUNTS_INVALID": one(have & q("counts").isNull()), "SOURCE_RECORD_KEY_CONTRACT_MISSING": one(have & q("source_record_key").isNull()),
        "SOURCE_TYPE_MISSING": one(have & blank(q("source.type"))), "SOURCE_SHA256_INVALID": one(have & ~sha(q("source.sha256"))),
        "IMESSAGE_RECORD_KEY_CONTRACT_INVALID": one(chat & (differ(q("source_record_key.version"), F.lit(CHAT_KEY_VERSION)) | differ(q("source_record_key.scope"), F.lit(CHAT_KEY_SCOPE)))),
        "IMESSAGE_SNAPSHOT_METHOD_INVALID": one(chat & differ(q("source.snapshot_method"), F.lit(CHAT_SNAPSHOT))), "IMESSAGE_WAL_PROVENANCE_MISSING": one(chat & differ(q("source.snapshot_includes_committed_wal"), F.lit(True))),
        "MESSAGES_SEEN_MISMATCH": one(have & differ(count("messages_seen"), F.col("_records"))), "MESSAGES_EMITTED_MISMATCH": one(have & differ(F.coalesce(count("messages_emitted"), count("messages_seen")), F.col("_records"))),
        "ATTACHMENTS_SEEN_MISMATCH": one(have & differ(count("attachments_seen"), F.col("_files"))), "A1_EXTRACTION_ERRORS": one(have & differ(count("errors"), F.lit(0).cast("bigint"))),
    }
    cases = {**per_bundle, **{code: F.col(code) for code in per_line}, "SOURCE_RECORD_KEY_DUPLICATE": F.col("SOURCE_RECORD_KEY_DUPLICATE")}
    severity = lambda code: "WARNING" if code in ("EMPTY_LINE", "TIMESTAMP_UNNORMALIZED", "ATTACHMENT_SOURCE_ID_MISSING") else "ERROR"
    each = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity(code)).alias("severity"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for code, c in cases.items()])
    return b.select("bundle_id", F.explode(each).alias("c")).select("bundle_id", "c.code", "c.severity", "c.n").where("n > 0")
