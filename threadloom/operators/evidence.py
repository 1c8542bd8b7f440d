"""Arrays of ids, or of children, held against the rows that should say the same.

Both sides become one row a key of sums that don't hang on order: arrays are summed in place, rows with map-side combining.
Only keys whose sums differ are exploded and compared id by id, so that sound tables cost one aggregate and one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of differences between a list and its rows: not in the rows, not in the list, more often in one than in the other.
MISSING, EXTRA, REPEATED = "MISSING", "EXTRA", "REPEATED"


def _hash(x: Column, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), x.cast("string")).cast("decimal(38,0)")


def _of_array(array: Column) -> list[Column]:
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda seed: F.aggregate(F.coalesce(array, F.array().cast("array<string>")), zero, lambda acc, x: (acc + F.coalesce(_hash(x, seed), zero)).cast("decimal(38,0)"))
    return [F.coalesce(F.size(F.coalesce(array, F.array().cast("array<string>"))), F.lit(0)).cast("bigint").alias("_n"), total("a").alias("_x"), total("b").alias("_y")]


def differences(lists: DataFrame, rows: DataFrame, keys: list[str], array: str, value: str) -> DataFrame:
    """keys, value (string), kind, listed and found: every value that a key's arrays don't hold as often as its rows.

    lists: keys and an array; keys that repeat are one list. rows: keys and a value. A key with a null equals itself; a null
    array is empty; a null value is a value. EXTRA has listed 0, MISSING has found 0, REPEATED is all else.
    """
    named = [F.col(k).alias(k) for k in keys]
    a = lists.select(*named, F.transform(array, lambda x: x.cast("string")).alias("_list"))
    b = rows.select(*named, F.col(value).cast("string").alias("_value"))
    sums = lambda c: F.sum(c).cast("decimal(38,0)").alias(c)
    told = a.select(*keys, *_of_array(F.col("_list"))).groupBy(*keys).agg(F.sum("_n").alias("_n"), sums("_x"), sums("_y"))
    have = b.select(*keys, F.lit(-1).cast("bigint").alias("_n"), (-_hash(F.col("_value"), "a")).alias("_x"), (-_hash(F.col("_value"), "b")).alias("_y")).groupBy(*keys).agg(F.sum("_n").alias("_n"), sums("_x"), sums("_y"))
    # One aggregate of both: what is equal cancels out.
    off = told.unionByName(have).groupBy(*keys).agg(F.sum("_n").alias("_n"), sums("_x"), sums("_y")).where("_n <> 0 OR _x <> 0 OR _y <> 0").select(*keys)
    same = lambda left: reduce(lambda x, y: x & y, [left[k].eqNullSafe(off[k]) for k in keys])
    listed = a.join(off, same(a), "left_semi").select(*keys, F.explode("_list").alias("value"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
    found = b.join(off, same(b), "left_semi").select(*keys, F.col("_value").alias("value"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    counts = listed.unionByName(found).groupBy(*keys, "value").agg(F.sum("_a").alias("listed"), F.sum("_b").alias("found")).where("listed <> found")
    kind = F.when(F.col("found") == 0, MISSING).when(F.col("listed") == 0, EXTRA).otherwise(REPEATED)
    return counts.select(*keys, "value", kind.alias("kind"), "listed", "found")


def topic_faults(
    topics: DataFrame, evidence: DataFrame, period_accounts: DataFrame, periods: DataFrame, markers: DataFrame, marker_accounts: DataFrame, marker_summary: DataFrame, marker_periods: DataFrame,
) -> DataFrame:
    """What a reader of topics must refuse: (conversation_id, code, n).

    topics: conversation_id, topic_key, source_message_ids (an array). evidence and markers: conversation_id, topic_key,
    message_id; markers also affection_hit_count and negative_hit_count, evidence also dated (boolean). The accounts have a row
    for each conversation: period_accounts evidence_row_count, topic_count, evidence_message_count, dated_evidence_row_count
    and undated_evidence_row_count; marker_accounts topic_evidence_row_count, marker_evidence_row_count,
    affection_evidence_row_count, negative_evidence_row_count and reconciliation_ok. Other tables: conversation_id, topic_key.
    A conversation without a row in period_accounts isn't judged by it; one with markers must have one in marker_accounts.
    """
    c, t, pair = "conversation_id", ["conversation_id", "topic_key"], ["conversation_id", "topic_key", "message_id"]
    per = lambda rows, code: rows.groupBy(c).agg(F.count("*").alias("n")).select(c, F.lit(code).alias("code"), "n")
    known = topics.select(*t).distinct()
    orphans = lambda rows, code: per(rows.select(*t).distinct().join(known, t, "left_anti"), code)
    again = lambda rows, keys: rows.groupBy(*keys).count().where("count > 1")

    ids = differences(topics, evidence, t, "source_message_ids", "message_id").groupBy(c, "kind").agg(F.count("*").alias("n"))
    found = [
        ids.select(c, F.concat(F.lit("TOPIC_EVIDENCE_ID_"), "kind").alias("code"), "n"),
        per(again(topics, t), "TOPIC_REPEATED"), per(again(evidence, pair), "TOPIC_EVIDENCE_REPEATED"), per(again(markers, pair), "MARKER_EVIDENCE_REPEATED"),
        orphans(evidence, "TOPIC_EVIDENCE_ORPHAN"), orphans(periods, "TOPIC_PERIOD_ORPHAN"), orphans(markers, "MARKER_ORPHAN"), orphans(marker_summary, "MARKER_SUMMARY_ORPHAN"), orphans(marker_periods, "MARKER_PERIOD_ORPHAN"),
        per(markers.select(*pair).distinct().join(evidence.select(*pair).distinct(), pair, "left_anti"), "MARKER_WITHOUT_EVIDENCE"),
    ]
    a, b = F.col("affection_hit_count"), F.col("negative_hit_count")
    found.append(per(markers.where(a.isNull() | b.isNull() | (a < 0) | (b < 0) | ((a == 0) & (b == 0))), "MARKER_HITS_INVALID"))

    of_evidence = evidence.groupBy(c).agg(F.count("*").alias("evidence_row_count"), F.count_distinct("message_id").alias("evidence_message_count"), F.count_if("dated").alias("dated_evidence_row_count"))
    seen = of_evidence.join(topics.groupBy(c).agg(F.count_distinct("topic_key").alias("topic_count")), c, "full").join(
        markers.groupBy(c).agg(F.count("*").alias("marker_evidence_row_count"), F.count_if(a > 0).alias("affection_evidence_row_count"), F.count_if(b > 0).alias("negative_evidence_row_count")), c, "full"
    )
    zero = [x for x in seen.columns if x != c]

    def accounts(told: DataFrame, of: dict[str, Column], name: str) -> DataFrame:
        """A code for each count of a conversation's only account that isn't what is seen."""
        one = told.groupBy(c).agg(F.count("*").alias("_rows"), *[F.first(x).alias(f"_{x}") for x in told.columns if x != c])
        both = one.join(seen, c, "left").fillna(0, zero)
        wrong = F.array_compact(F.array(*[F.when(~F.col(f"_{x}").cast("bigint").eqNullSafe(v.cast("bigint")), f"{name}_{x.upper()}_DIFFERS") for x, v in of.items()]))
        codes = F.when(F.col("_rows") > 1, F.array(F.lit(f"{name}_REPEATED"))).otherwise(wrong)
        return both.select(c, F.explode(codes).alias("code"), F.lit(1).cast("bigint").alias("n"))

    rows = F.col("evidence_row_count")
    found.append(accounts(period_accounts, {
        "evidence_row_count": rows, "topic_count": F.col("topic_count"), "evidence_message_count": F.col("evidence_message_count"), "dated_evidence_row_count": F.col("dated_evidence_row_count"), "undated_evidence_row_count": rows - F.col("dated_evidence_row_count"),
    }, "PERIOD_ACCOUNT"))
    marked = {x: F.col(x) for x in ("marker_evidence_row_count", "affection_evidence_row_count", "negative_evidence_row_count")}
    found.append(accounts(marker_accounts, {"topic_evidence_row_count": rows, **marked, "reconciliation_ok": F.lit(1)}, "MARKER_ACCOUNT"))
    found.append(per(markers.select(c).distinct().join(marker_accounts.select(c).distinct(), c, "left_anti"), "MARKER_ACCOUNT_MISSING"))
    return reduce(DataFrame.unionByName, found)


def vertical_children(staged: DataFrame, records: DataFrame, children: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Staged records and the lists nested in them against the store: (source_record_key, kind, child, code, staged, stored).

    staged: source_record_key and an array of keys for each kind of child. records: source_record_key of the stored records.
    children: for each kind the array's name and its stored rows (source_record_key, child). Codes: RECORD_MISSING,
    RECORD_UNEXPECTED and RECORD_REPEATED, whose child is null; CHILD_LOST, CHILD_ADDED and CHILD_REPEATED by kind. Children
    are judged only of records that are on both sides once. A null key is a key like others.
    """
    k = "source_record_key"
    per = staged.groupBy(k).agg(F.count("*").alias("staged")).join(records.groupBy(k).agg(F.count("*").alias("stored")).withColumnRenamed(k, "_k"), F.col(k).eqNullSafe(F.col("_k")), "full")
    per = per.select(F.coalesce(k, "_k").alias(k), F.coalesce("staged", F.lit(0)).alias("staged"), F.coalesce("stored", F.lit(0)).alias("stored"))
    code = F.when(F.col("stored") == 0, "RECORD_MISSING").when(F.col("staged") == 0, "RECORD_UNEXPECTED").otherwise("RECORD_REPEATED")
    out = [per.where("staged <> stored").select(k, F.lit("record").alias("kind"), F.lit(None).cast("string").alias("child"), code.alias("code"), "staged", "stored")]
    both = per.where("staged = 1 AND stored = 1").select(F.col(k).alias("_k"))
    names = F.create_map(*[F.lit(x) for x in (MISSING, "CHILD_LOST", EXTRA, "CHILD_ADDED", REPEATED, "CHILD_REPEATED")])
    for kind, (array, rows) in sorted(children.items()):
        d = differences(staged, rows, [k], array, "child")
        d = d.join(both, F.col(k).eqNullSafe(F.col("_k")), "left_semi")
        out.append(d.select(k, F.lit(kind).alias("kind"), F.col("value").alias("child"), names[F.col("kind")].alias("code"), F.col("listed").alias("staged"), F.col("found").alias("stored")))
    return reduce(DataFrame.unionByName, out)


def processing_faults(memberships: DataFrame, links: DataFrame, sources: DataFrame, processed: DataFrame, run: DataFrame) -> DataFrame:
    """A processing run against the store it read: (code, membership_id), a null where a count of the run is wrong.

    memberships: membership_id, message_id; links: membership_id, message_source_id; sources: message_source_id,
    source_record_key; processed: membership_id; run: one row of input_membership_count, output_membership_count and
    canonical_message_count.
    """
    m = "membership_id"
    ids = memberships.select(m).distinct()
    traced = links.join(sources.where("source_record_key IS NOT NULL").select("message_source_id"), "message_source_id", "left_semi").select(m).distinct()
    name = lambda rows, code: rows.select(F.lit(code).alias("code"), m)
    have = memberships.agg(F.count_distinct(m).alias("input"), F.count_distinct("message_id").alias("messages")).join(processed.agg(F.count("*").alias("output")), F.lit(True))
    wrong = {"INPUT_MEMBERSHIP_COUNT_DIFFERS": ("input_membership_count", "input"), "OUTPUT_MEMBERSHIP_COUNT_DIFFERS": ("output_membership_count", "output"), "CANONICAL_MESSAGE_COUNT_DIFFERS": ("canonical_message_count", "messages")}
    counts = run.join(have, F.lit(True)).select(F.explode(F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), code) for code, (a, b) in wrong.items()]))).alias("code"), F.lit(None).cast("bigint").alias(m))
    told = processed.select(m)
    return reduce(DataFrame.unionByName, [
        name(ids.join(told, m, "left_anti"), "MEMBERSHIP_NOT_PROCESSED"), name(told.distinct().join(ids, m, "left_anti"), "PROCESSED_WITHOUT_MEMBERSHIP"), name(told.groupBy(m).count().where("count > 1"), "PROCESSED_TWICE"), name(told.distinct().join(traced, m, "left_anti"), "PROVENANCE_MISSING"), counts,
    ])
