"""Lists against rows, nested children and the tables of a resolution, on small cases."""

from threadloom.operators import evidence as ev
from threadloom.operators import sidecars as sc


def found(spark, lists, rows):
    a = spark.createDataFrame(lists, "k string, ids array<long>")
    b = spark.createDataFrame(rows, "k string, id long")
    return {(x.k, x.value, x.kind, x.listed, x.found) for x in ev.differences(a, b, ["k"], "ids", "id").collect()}


def test_lists_and_rows(spark):
    assert found(spark, [("a", [1, 2]), ("b", []), ("c", None)], [("a", 2), ("a", 1)]) == set()
    assert found(spark, [("a", [1, 1, 2]), ("b", [5]), (None, [7, None])], [("a", 1), ("a", 3), ("d", 4), (None, 7)]) == {
        ("a", "1", ev.REPEATED, 2, 1), ("a", "2", ev.MISSING, 1, 0), ("a", "3", ev.EXTRA, 0, 1), ("b", "5", ev.MISSING, 1, 0), ("d", "4", ev.EXTRA, 0, 1), (None, None, ev.MISSING, 1, 0),
    }
    assert found(spark, [], []) == set()
    assert found(spark, [("a", [1]), ("a", [2])], [("a", 1), ("a", 2)]) == set()  # one list in two rows


def test_equal_counts_with_other_ids_differ(spark):
    assert found(spark, [("a", [1, 4])], [("a", 2), ("a", 3)]) == {("a", "1", ev.MISSING, 1, 0), ("a", "4", ev.MISSING, 1, 0), ("a", "2", ev.EXTRA, 0, 1), ("a", "3", ev.EXTRA, 0, 1)}


def test_children_of_repeated_records_are_not_judged(spark):
    staged = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("b", ["x"]), ("c", ["y"]), (None, ["n"])], "source_record_key string, files array<string>")
    records = spark.createDataFrame([("a",), ("b",), ("d",), (None,)], "source_record_key string")
    files = spark.createDataFrame([("a", "z"), ("d", "z")], "source_record_key string, child string")
    out = {(x.source_record_key, x.child, x.code, x.staged, x.stored) for x in ev.vertical_children(staged, records, {"file": ("files", files)}).collect()}
    assert out == {("b", None, "RECORD_REPEATED", 2, 1), ("c", None, "RECORD_MISSING", 1, 0), ("d", None, "RECORD_UNEXPECTED", 0, 1), ("a", "x", "CHILD_LOST", 1, 0), ("a", "z", "CHILD_ADDED", 0, 1), (None, "n", "CHILD_LOST", 1, 0)}


PEOPLE = "participant_id long, canonical_name string, is_self boolean"


def resolution(spark, people, runs=(("r1", 1), ("r2", 4))):
    p = spark.createDataFrame(people, PEOPLE)
    i = spark.createDataFrame([(10, people[0][0], "email", "a@b", "A@B")] if people else [], "identity_id long, participant_id long, identity_type string, normalized_value string, original_value string")
    m = spark.createDataFrame([(k, who, run) for k, (run, who) in enumerate(runs)], "membership_id long, sender_id long, sender_run_id string")
    return p, i, m


def test_resolution_as_it_should_be(spark):
    p, i, m = resolution(spark, [(3, "  ", True), (1, None, True), (5, "Jan  Novák", None), (4, "jan novák", False), (7, "Me", True)])
    want = sc.expected(p, i, m)
    assert {tuple(x) for x in want["members"].collect()} == {(1, 1), (3, 1), (7, 1), (4, 4), (5, 5)}
    assert {tuple(x) for x in want["resolved"].collect()} == {(1, "Me", True, sc.OWNER, 1.0), (4, "jan novák", False, sc.MEMBER, 1.0), (5, "Jan  Novák", False, sc.MEMBER, 1.0)}
    assert [tuple(x) for x in want["candidates"].collect()] == [(4, 5, sc.SAME_NAME, 0.35, sc.NAME_METHOD)]
    assert [x.method for x in want["aliases"].collect()] == [sc.OWNER_ALIAS]
    assert sc.sidecar_faults(p, i, m, {**want, "run_senders": want["run_senders"].drop("_most")}).where("n > 0").count() == 0


def test_a_run_of_two_people(spark):
    p, i, m = resolution(spark, [(1, "A", True), (2, None, True), (3, "B", False), (4, "C", False)], (("r", 1), ("r", 2), ("s", 3), ("s", 4)))
    want = sc.expected(p, i, m)
    told = {**want, "run_senders": want["run_senders"].drop("_most")}
    # r has two ids of one person, s two people: its row should not be there.
    assert {(x.code, x.n) for x in sc.sidecar_faults(p, i, m, told).where("n > 0").collect()} == {("RUN_CROSSES_PEOPLE", 1), ("RUN_UNEXPECTED", 1)}


def test_without_an_owner_or_anybody(spark):
    p, i, m = resolution(spark, [(1, "A", False), (2, "A", None)])
    assert {tuple(x) for x in sc.expected(p, i, m)["members"].collect()} == {(1, 1), (2, 2)}
    p, i, m = resolution(spark, [], ())
    want = sc.expected(p, i, m)
    assert sc.sidecar_faults(p, i, m, {**want, "run_senders": want["run_senders"].drop("_most")}).where("n > 0").count() == 0


def test_merging_over_batches_and_unknown_values(spark):
    from threadloom.operators import readers as rd

    second = 1_000_000
    rows = [(1, "a", i * second, (i + 100) * second, float(i) if i % 3 else None) for i in range(20)] + [(1, "a", None, 5, 1.0), (1, "a", 5, None, 1.0), (None, "a", 0, second, 2.0), (None, None, 0, second, None), (2, "a", 0, 0, 1.0), (2, "a", 0, 0, 3.0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = {tuple(r) for r in rd.merge_candidates(spark.createDataFrame(rows, "conversation_id bigint, kind string, start_us bigint, end_us bigint, importance double")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    # An instant overlaps nothing, and stays by itself.
    assert out == {(1, "a", 0, 119 * second, 19.0, 20), (None, "a", 0, second, 2.0, 1), (None, None, 0, second, None, 1), (2, "a", 0, 0, 1.0, 1), (2, "a", 0, 0, 3.0, 1)}


def test_reconciliation_without_a_completed_run_and_with_nothing(spark):
    from threadloom.operators import views as vw

    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    conversations = table([(1, 7, 2, 1, 1)], "analytics_run_id long, conversation_id long, source_message_count long, known_sender_message_count long, unknown_sender_message_count long")
    runs, processed = table([(1, 5)], "analytics_run_id long, processing_run_id long"), table([(5, 7), (5, 7), (4, 7)], "processing_run_id long, conversation_id long")
    sessions = table([(5, 7, 1), (5, 7, 1), (4, 7, 2)], "processing_run_id long, conversation_id long, session_id long")
    one, two = "analytics_run_id long, conversation_id long, session_id long", "analytics_run_id long, conversation_id long, previous_session_id long, next_session_id long"
    rest = (table([(1, 7, 1)], one), table([], two), table([(1, 7, None)], one))
    run = lambda status, *tables: vw.run_reconciliation(conversations, runs, table([(5, status)], "processing_run_id long, status string"), processed, sessions, *tables).collect()
    assert run("failed", *rest) == []
    [sound] = run("completed", *rest)
    assert (sound.reconciliation_ok, sound.a3_processed_membership_count, sound.membership_count_delta) == (1, 2, 0)
    # A session of an older run, a silence without an end, and a response without a session.
    [wrong] = run("completed", table([(1, 7, 2), (1, 7, None)], one), table([(1, 7, 1, None)], two), table([], one))
    assert (wrong.reconciliation_ok, wrong.invalid_response_session_count, wrong.invalid_silence_session_count, wrong.invalid_event_session_count) == (0, 2, 1, 0)


def test_snapshots_of_nothing_and_with_nulls(spark):
    from threadloom.operators import snapshots as sn

    body = "timestamp_us long, sender_id long, membership_id long, source_record_keys array<string>, source_snapshot_keys array<string>, parser_versions array<string>"
    origin = ", ".join(f"{c} string" for c in sn.PROVENANCE)
    schemas = [
        f"context_id long, missing_message_ids array<long>, omitted_message_ids array<long>, omitted_message_count long, omitted_sha256 string, quality_warnings array<string>, {origin}", f"context_id long, message_id long, {body}",
        "context_id long, phase string, name string, value double", "context_id long, path string, message_ids array<long>", f"context_id long, path string, position int, message_id long, {body}", f"context_id long, path string, phase string, name string, value double, {origin}",
    ]
    faults = lambda *rows: {(x.path, x.code, x.n) for x in sn.snapshot_faults(*[spark.createDataFrame(r, s) for r, s in zip(rows, schemas, strict=True)]).collect()}
    assert faults([], [], [], [], [], []) == set()
    context, same = (1, None, None, None, None, None, None, None, None, None, None), (None, None, 3, None, ["s"], None)
    assert faults([context], [(1, 2, *same)], [(1, "before", "m", None)], [(1, "p", [2])], [(1, "p", 0, 2, *same)], [(1, "p", "before", "m", None, None, None, None, None, None)]) == set()
    assert faults([context], [(1, 2, *same)], [], [(1, "p", [2, 3]), (1, "q", None)], [(1, "p", 0, 2, *same), (1, "p", 1, 4, *same), (1, "p", 2, 2, *same)], []) == {("p", "MESSAGE_SNAPSHOT_DIFFERS_FROM_LIST", 2), ("p", "MESSAGE_OUTSIDE_CONTEXT", 1), ("q", "EVIDENCE_EMPTY", 1)}
    left_out = (1, [9], [], 2, None, [None, "x"], None, None, None, None, None)
    assert {c for _, c, _ in faults([left_out], [], [], [], [], [])} == {"CONTEXT_MISSING_EVIDENCE", "CONTEXT_OMISSION_COUNT_DIFFERS", "CONTEXT_OMISSION_HASH_MISSING", "CONTEXT_OMISSION_NOT_DISCLOSED"}
