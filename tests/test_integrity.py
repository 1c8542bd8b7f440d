"""Audits and normalisation that no registered query reaches."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import canonical as ca
from threadloom.operators import gates as gt
from threadloom.operators import integrity as ig
from threadloom.operators import packets as pk
from threadloom.operators import views as vw


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_staged_records(spark):
    sha = "a" * 64
    key = hashlib.sha256("\u001f".join([sha, "g", "1", "c"]).encode()).hexdigest()
    schema = """record_id long, source_type string, source_sha256 string, guid string, source_message_id string, source_conversation_id string, source_record_key string, contract string, timestamp_us long, timestamp_precision string,
      refs array<struct<conversation_key:string>>, attachments array<struct<position:int>>"""
    good = (1, "csv", sha, "g", "1", "c", key, "1", 5, "second", [("c",)], [(0,), (1,)])
    bad = (2, "csv", "x", "g", "1", "d", key, "2", 5, None, [("c",), ("c",), ("",)], [(0,), (0,)])
    none = (3, "csv", sha, None, None, None, None, None, None, "second", [], None)
    report = ig.staged_records(spark.createDataFrame([good, bad, none], schema), spark.createDataFrame([(4, 1)], "messages long, errors long"))
    assert {r.code: r.n for r in report.collect()} == {
        "CONTRACT_VERSION_UNSUPPORTED": 2, "RECORD_KEY_MISSING": 1, "RECORD_KEY_MISMATCH": 1, "RECORD_KEY_DUPLICATE": 1, "SOURCE_SHA_INVALID": 1, "TIMESTAMP_PRECISION_INVALID": 1, "TIMESTAMP_MISSING_FOR_PRECISION": 1,
        "CONVERSATION_RELATION_MISSING": 1, "CONVERSATION_RELATION_KEY_EMPTY": 1, "CONVERSATION_RELATION_DUPLICATE": 1, "ATTACHMENT_POSITION_INVALID": 1, "MESSAGE_COUNT_MISMATCH": 1, "SOURCE_ERRORS_PRESENT": 1,
    }
    clean = ig.staged_records(spark.createDataFrame([good], schema), spark.createDataFrame([(1, 0)], "messages long, errors long"))
    assert {r.severity for r in clean.collect()} == {"OK"}


def test_evidence_and_verdicts(spark):
    sessions = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "conversation_id long, message_id long, session_no long")
    conflicts = spark.createDataFrame([(1, 1, [10, 11, 12]), (1, 3, [])], "conversation_id long, session_no long, source_message_ids array<long>")
    assert rows(ig.conflict_ids_in_session(conflicts, sessions), "message_id") == [(11,), (12,)]
    assert rows(ig.session_provenance(conflicts, sessions), "session_no") == [(3,)]
    verdict = lambda *r: ig.release_verdict(spark.createDataFrame(list(r), "name string, status string, sha string")).first().verdict
    assert [verdict(("a", "VALID", "1"), ("b", "VALID", "1")), verdict(("a", "VALID", "1"), ("b", "VALID", "2")), verdict(("a", None, "1")), verdict(("a", "VALID", None), ("b", "VALID", "1"))] == ["READY", "BLOCKED", "BLOCKED", "BLOCKED"]
    arrays = spark.createDataFrame([("[1, 2]",), ("[1, 1]",), ("[]",), ("{}",), (None,), ('["a"]',)], "j string")
    assert [(r.j, r.ids, r.ok) for r in ig.id_arrays(arrays, "j").collect()] == [("[1, 2]", [1, 2], True), ("[1, 1]", None, False), ("[]", [], True), ("{}", None, False), (None, None, False), ('["a"]', None, False)]


def test_a_changed_row_changes_the_stores_fingerprint(spark):
    table = spark.createDataFrame([(1, "a"), (2, None)], "i long, t string")
    print_of = lambda df: ig.store_fingerprint({"t": df}).first().fingerprint
    assert print_of(table) == print_of(table.orderBy(F.desc("i"))) != print_of(table.withColumn("t", F.coalesce("t", F.lit(""))))


def test_memberships_and_metadata(spark):
    refs = spark.createDataFrame([(1, 0, "x", None), (1, 1, "y", None), (2, 0, "y", None), (2, 1, "z", "c")], "record_id long, position long, conversation_key string, canonical_key string")
    of = spark.createDataFrame([(1, 7), (2, 7)], "record_id long, canonical_id long")
    assert rows(ca.memberships(refs, of), "conversation", "position", "is_primary") == [("c", 1, False), ("x", 0, True), ("y", 1, False)]
    raw = spark.createDataFrame([("g", 2, 0, 600000000000000000, 1, 0, "AAEC"), (" ", 3, 5, None, 0, None, None)], "associated_message_guid string, associated_message_type long, date_edited long, date_retracted long, is_read long, is_sent long, edit_history string")
    one, two = ca.apple_metadata(raw).collect()
    assert one.associated.target_guid == "g" and one.edited is None and one.retracted.us == (978_307_200 + 600_000_000) * 10**6 and one.flags == ["is_read"] and one.edit_history_bytes == 3
    assert two.associated is None and two.edited.raw == 5 and two.flags == [] and two.edit_history_bytes is None
    files = spark.createDataFrame([("p", True, None), ("p", False, "s"), (None, None, "s"), (None, None, None)], "path string, found boolean, sha string")
    assert [r.a for r in files.select(ca.availability(F.col("path"), F.col("found"), F.col("sha")).alias("a")).collect()] == ["external", "missing", "external", "unknown"]
    safe = spark.createDataFrame([(bytearray(b"\x00\xff"),), (None,)], "b binary").select(ca.json_safe(F.col("b"), True).alias("j")).collect()
    assert [r.j for r in safe] == ['{"encoding":"base64","data":"AP8="}', None]
    hashes = spark.createDataFrame([(None, ""), (None, None), ("k", "")], "k string, t string").select(ca.source_hash(F.col("k"), F.col("t")).alias("h")).collect()
    assert hashes[0].h != hashes[1].h and hashes[2].h == "k"


def test_reads_of_repeated_identities_fail(spark):
    m = spark.createDataFrame([(1, 10, 5), (2, 11, 5)], "membership_id long, message_id long, conversation_id long")
    assert rows(vw.analytic_read(m, m.withColumn("x", F.lit(1))), "membership_id", "x") == [(1, 1), (2, 1)]
    for left, right in ((m.union(m), m), (m, m.union(m.limit(1)))):
        with pytest.raises(Exception, match="twice"):
            vw.analytic_read(left, right).collect()


def test_packets_of_odd_selections(spark):
    m = spark.createDataFrame([(1, 1, 1, 5, "a"), (1, 2, 2, None, None), (2, 3, 3, 5, "b")], "conversation_id long, message_id long, membership_id long, timestamp_us long, text string")
    chosen = lambda *ids: spark.createDataFrame([(7, i) for i in ids], "packet_id long, message_id long")
    faults = lambda *ids: rows(pk.selection_faults(m, chosen(*ids), 1, 1), "code", "n")
    assert faults(3) == [] and faults() == [] and faults(1) == [("CONTEXT_TIME_UNKNOWN", 1)]
    assert faults(1, 3, 3, 9, 2) == [("SELECTED_ID_DUPLICATE", 1), ("SELECTED_ID_MISSING", 1), ("SELECTED_TIME_UNKNOWN", 1), ("SEVERAL_CONVERSATIONS", 2)]
    got = pk.with_provenance(pk.packet_rows(m, chosen(1), 0, 5), spark.createDataFrame([(1, ["k"], ["s"], [])], "message_id long, source_record_keys array<string>, source_snapshot_keys array<string>, parser_versions array<string>"))
    assert rows(got, "message_id", "selected", "source_provenance_status") == [(1, True, "complete"), (2, False, "missing")]
    assert rows(pk.packet_faults(pk.packet_headers(got, False), got), "code", "n") == [("A6_PACKET_SOURCE_PROVENANCE_UNVERIFIED", 1), ("A6_PACKET_UNKNOWN_TIMESTAMP", 1)]
    alone = {r.code for r in pk.packet_faults(pk.packet_headers(got), got.limit(0)).collect()}
    assert {"A6_PACKET_MESSAGES_INVALID", "A6_PACKET_MESSAGE_COUNT_MISMATCH", "A6_PACKET_SELECTED_FLAG_MISMATCH"} <= alone


def test_gates_of_empty_tables(spark):
    none = spark.createDataFrame([], "source_key long")
    assert rows(gt.source_accounts(none, emitted=none), "n", "severity") == [(0, "OK")] * 3
    assert gt.report(gt.source_accounts(none, emitted=none)).first().status == "PASS"
    assert gt.bundle_faults(spark.createDataFrame([], "bundle_id long, manifest string, report string"), spark.createDataFrame([], "bundle_id long"), spark.createDataFrame([], "bundle_id long")).count() == 0
    old = spark.createDataFrame([(1, False), (2, True)], "conversation_id long, reconciliation_ok boolean")
    assert rows(gt.reader_faults(old, spark.createDataFrame([(1,), (2,), (3,)], "conversation_id long")), "conversation_id", "code") == [(1, "RECONCILIATION_NOT_OK"), (3, "RECONCILIATION_ROW_MISSING")]


def test_staged_bundles(spark):
    sha = "a" * 64
    key = lambda i: hashlib.sha256("\u001f".join([sha, "", str(i), "c"]).encode()).hexdigest()
    manifest = {"contract_version": "1", "source": {"type": "csv", "sha256": sha}, "parser": {"name": "p", "version": "1"}, "outputs": {"messages": "m"}, "counts": {"messages_seen": 1, "attachments_seen": 1, "errors": 0}, "source_record_key": {"version": "1"}}
    good = {"source_record_key": key(1), "contract_version": "1", "record_type": "message", "source_type": "csv", "source_sha256": sha, "source_message_id": "1", "conversation_source_id": "c", "timestamp_utc": "2024-01-01T00:00:00Z", "timestamp_raw": "x", "attachments": [{"source_attachment_id": "1", "sha256": sha}]}
    bad = {**good, "contract_version": "2", "record_type": "x", "source_type": "json", "source_sha256": None, "source_message_id": "", "timestamp_utc": "soon", "conversation_sources": [{"source_conversation_key": "k"}, {"source_conversation_key": "k"}, {}, 3], "attachments": [1, {"sha256": "z"}]}
    chat = {**manifest, "source": {"type": "imessage_chat_db", "sha256": "x"}, "counts": {"messages_seen": 0, "attachments_seen": 0, "errors": 2}, "parser": None}
    lines = [(1, json.dumps(good)), (2, json.dumps(good)), (2, json.dumps(bad)), (2, " "), (2, "{"), (2, "[1]"), (3, json.dumps({**good, "timestamp_utc": None, "attachments": {}, "conversation_sources": 5, "source_record_key": "short"})), (5, "1")]
    bundles = [(1, json.dumps(manifest)), (2, json.dumps(manifest)), (3, json.dumps(chat)), (4, None), (5, "[]")]
    got = {}
    for r in gt.staging_faults(spark.createDataFrame(lines, "bundle_id long, value string"), spark.createDataFrame(bundles, "bundle_id long, manifest string")).collect():
        got.setdefault(r.bundle_id, {})[r.code] = r.n
    assert 1 not in got and got[4] == {"MANIFEST_MISSING": 1, "MESSAGES_MISSING": 1} and got[5] == {"MANIFEST_INVALID": 1, "MESSAGE_NOT_OBJECT": 1}
    assert got[2] == {
        "EMPTY_LINE": 1, "MESSAGE_JSON_INVALID": 1, "MESSAGE_NOT_OBJECT": 1, "CONTRACT_VERSION_MISMATCH": 1, "RECORD_TYPE_INVALID": 1, "SOURCE_TYPE_MISMATCH": 1, "SOURCE_SHA256_MISMATCH": 1, "SOURCE_MESSAGE_ID_MISSING": 1, "SOURCE_RECORD_KEY_MISMATCH": 1, "SOURCE_RECORD_KEY_DUPLICATE": 1,
        "TIMESTAMP_INVALID": 1, "CONVERSATION_SOURCE_NOT_OBJECT": 1, "CONVERSATION_SOURCE_KEY_MISSING": 1, "CONVERSATION_SOURCE_DUPLICATE": 1, "ATTACHMENT_NOT_OBJECT": 1, "ATTACHMENT_SOURCE_ID_MISSING": 1, "ATTACHMENT_SHA256_INVALID": 1, "MESSAGES_SEEN_MISMATCH": 1, "MESSAGES_EMITTED_MISMATCH": 1, "ATTACHMENTS_SEEN_MISMATCH": 1,
    }
    assert got[3].keys() == {
        "MANIFEST_PARSER_INVALID", "SOURCE_SHA256_INVALID", "IMESSAGE_RECORD_KEY_CONTRACT_INVALID", "IMESSAGE_SNAPSHOT_METHOD_INVALID", "IMESSAGE_WAL_PROVENANCE_MISSING", "SOURCE_RECORD_KEY_INVALID", "SOURCE_TYPE_MISMATCH", "SOURCE_SHA256_MISMATCH", "SOURCE_RECORD_KEY_CONTRACT_UNKNOWN", "IMESSAGE_TIMESTAMP_CONVERSION_MISSING",
        "CONVERSATION_SOURCES_NOT_LIST", "IMESSAGE_CONVERSATION_SOURCES_MISSING", "ATTACHMENTS_NOT_LIST", "MESSAGES_SEEN_MISMATCH", "MESSAGES_EMITTED_MISMATCH", "A1_EXTRACTION_ERRORS",
    }


def test_first_reply_does_not_hang_on_the_order_of_relations(spark):
    messages = spark.createDataFrame([(0,), (1,), (2,)], "message_id long")
    none = spark.createDataFrame([], "message_id long, mime_type string")
    sources, runs = spark.createDataFrame([], "message_id long, import_run_id long, source_record_key string"), spark.createDataFrame([], "import_run_id long, source_sha256 string, source_fingerprint string, parser_version string")
    told = [(0, 0, -1, "reply_to"), (0, 0, -2, "Reply"), (7, 1, 3, "reply_to"), (-7, 1, 0, "Reply"), (None, 1, 9, "reply"), (-9, 1, 5, "edit")]
    for order in (told, told[::-1]):
        relations = spark.createDataFrame(order, "relation_id long, source_message_id long, target_message_id long, relation_type string").coalesce(1)
        assert rows(vw.message_provenance(messages, relations, none, sources, runs), "message_id", "reply_to") == [(0, -2), (1, 0), (2, None)]
