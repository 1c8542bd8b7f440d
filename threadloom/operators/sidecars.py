"""The six tables of a resolution of participants, derived again from participants, identities and messages, and compared.

Whoever is explicitly the owner is one person, named by the smallest id; all others stay as they are; equal names are
candidates and merge nobody. Each table is one full outer join with what it should be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import views as vw

# Methods and confidences that the tables must state.
OWNER, MEMBER = "explicit_is_self_union_v1", "a2_participant_membership_v1"
OWNER_ALIAS, MEMBER_ALIAS = "explicit_is_self_alias_v1", "a2_identity_membership_v1"
SAME_NAME, NAME_METHOD, NAME_CONFIDENCE = "same_normalized_canonical_name", "normalized_canonical_name_candidate_v1", 0.35


def expected(participants: DataFrame, identities: DataFrame, processed: DataFrame, normalize: bool = True) -> dict[str, DataFrame]:
    """The tables as they should be, by name. participants: participant_id, canonical_name, is_self; identities: identity_id,
    participant_id, identity_type, normalized_value, original_value; processed: membership_id, sender_id, sender_run_id."""
    own = participants.where("is_self").agg(F.min("participant_id").alias("_own"), F.count("*").alias("_owners"))
    p = participants.join(own, F.lit(True)).withColumn("is_self", F.coalesce("is_self", F.lit(False)))
    p = p.withColumn("resolved_id", F.when(F.col("is_self"), F.col("_own")).otherwise(F.col("participant_id")))
    merged = F.col("is_self") & (F.col("_owners") > 1)
    of = p.select("participant_id", "resolved_id", "is_self", "_owners")
    spoken = F.when(F.col("canonical_name").rlike(r"(?U)\S"), F.struct("participant_id", "canonical_name"))
    people = p.withColumn("_spoken", spoken).groupBy("resolved_id").agg(F.min("_spoken").alias("_s"), F.max("is_self").alias("is_self"), F.max("_owners").alias("_owners"))
    one = F.lit(1.0).alias("confidence")
    resolved = people.select("resolved_id", F.col("_s.canonical_name").alias("canonical_name"), "is_self", F.when(merged, OWNER).otherwise(MEMBER).alias("method"), one)
    aliases = identities.join(of, "participant_id").select("identity_id", "resolved_id", "participant_id", "identity_type", "normalized_value", "original_value", F.when(merged, OWNER_ALIAS).otherwise(MEMBER_ALIAS).alias("method"), one)
    w = Window.partitionBy("_name").orderBy("participant_id")
    named = p.select("participant_id", "resolved_id", tx.person_name(F.col("canonical_name"), normalize).alias("_name")).where("_name IS NOT NULL")
    pairs = named.select(F.col("participant_id").alias("left_id"), F.lead("participant_id").over(w).alias("right_id"), "resolved_id", F.lead("resolved_id").over(w).alias("_right")).where("resolved_id <> _right")
    candidates = pairs.select("left_id", "right_id", F.lit(SAME_NAME).alias("reason"), F.lit(NAME_CONFIDENCE).alias("confidence"), F.lit(NAME_METHOD).alias("method"))
    spoke = processed.join(of.select(F.col("participant_id").alias("sender_id"), "resolved_id"), "sender_id").select("membership_id", "sender_run_id", "resolved_id")
    runs = spoke.groupBy("sender_run_id").agg(F.min("resolved_id").alias("resolved_id"), F.max("resolved_id").alias("_most"))
    return {"members": of.select("participant_id", "resolved_id"), "resolved": resolved, "aliases": aliases, "candidates": candidates, "message_senders": spoke.select("membership_id", "resolved_id"), "run_senders": runs}


def _against(told: DataFrame, want: DataFrame, keys: list[str], name: str, groups: dict[str, list[str]]) -> DataFrame:
    """One row of counts: rows missing, unexpected and repeated, and for each group rows that differ in one of its columns."""
    columns = [c for cs in groups.values() for c in cs]
    b = want.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_want"))
    a = told.groupBy(*keys).agg(F.count("*").alias("_times"), *[F.min(c).alias(c) for c in columns])
    both = a.join(b, keys, "full")
    differ = lambda cs: (F.col("_times") == 1) & F.col("_want") & reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cs])
    counts: dict[str, Column] = {f"{name}_MISSING": F.col("_times").isNull(), f"{name}_UNEXPECTED": F.col("_want").isNull(), f"{name}_REPEATED": F.col("_times") > 1}
    counts |= {f"{name}_{g}_DIFFERS": differ(cs) for g, cs in groups.items()}
    one = both.agg(*[F.count_if(c).alias(code) for code, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in counts])).alias("c")).select("c.code", "c.n")


def sidecar_faults(participants: DataFrame, identities: DataFrame, processed: DataFrame, told: dict[str, DataFrame], normalize: bool = True) -> DataFrame:
    """The six published tables (by the names and with the columns of `expected`) against what they should be: (code, n,
    severity). A run of several people must not be there at all, and is RUN_CROSSES_PEOPLE. Rows told twice have only that fault."""
    want = expected(participants, identities, processed, normalize)
    runs = want["run_senders"].where("resolved_id = _most")
    crossing = want["run_senders"].where("resolved_id <> _most").agg(F.count("*").alias("n")).select(F.lit("RUN_CROSSES_PEOPLE").alias("code"), "n")
    return vw.issues(
        _against(told["members"], want["members"], ["participant_id"], "MEMBER", {"PERSON": ["resolved_id"]}),
        _against(told["resolved"], want["resolved"], ["resolved_id"], "PERSON", {"OWNER": ["is_self"], "NAME": ["canonical_name"], "METHOD": ["method", "confidence"]}),
        _against(told["aliases"], want["aliases"], ["identity_id"], "ALIAS", {"PROVENANCE": ["resolved_id", "participant_id", "identity_type", "normalized_value", "original_value", "method", "confidence"]}),
        _against(told["candidates"], want["candidates"], ["left_id", "right_id"], "CANDIDATE", {"BASIS": ["reason", "confidence", "method"]}),
        _against(told["message_senders"], want["message_senders"], ["membership_id"], "SENDER", {"PERSON": ["resolved_id"]}),
        _against(told["run_senders"], runs, ["sender_run_id"], "RUN", {"PERSON": ["resolved_id"]}), crossing,
    )
