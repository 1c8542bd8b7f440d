"""Queries of topics and markers, and their SQL. Tokens are compared without Unicode compatibility forms, which DuckDB lacks; tests cover those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structure as st
from ..operators import topics as tp
from ..operators.graph import checkpointed
from . import adapters as ad


def _processed(spark, sf_dir: str) -> DataFrame:
    return st.processed(ad.chats(spark, sf_dir), ad.CHATS)


def _candidates(p: DataFrame) -> DataFrame:
    return tp.topic_candidates(p, ad.CHATS, normalize=False)


def _evidence(p: DataFrame) -> DataFrame:
    return tp.topic_evidence(p, _candidates(p), ad.CHATS, normalize=False)


def topic_tokens(spark, sf_dir: str) -> DataFrame:
    return tp.topic_tokens(ad.chats(spark, sf_dir), normalize=False).withColumn("tokens", F.array_join("tokens", " "))


def topic_candidates(spark, sf_dir: str) -> DataFrame:
    return _candidates(_processed(spark, sf_dir)).withColumns({"first_date": F.col("first_date").cast("string"), "last_date": F.col("last_date").cast("string")})


def topic_evidence(spark, sf_dir: str) -> DataFrame:
    return _evidence(_processed(spark, sf_dir)).select("conversation_id", "n", "phrase", "message_id", "sender_id", "occurrences")


def topic_markers(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    return tp.topic_markers(p, _evidence(p)).select("conversation_id", "n", "phrase", "message_id", "affection_count", "negative_count")


def topic_periods(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    return tp.topic_periods(_evidence(p), p).withColumn("period_start", F.col("period_start").cast("string"))


def topic_period_recon(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    e = checkpointed(_evidence(p))
    return tp.topic_period_recon(tp.topic_periods(e, p), e)


def marker_summary(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    return tp.marker_summary(tp.topic_markers(p, _evidence(p)))


def marker_periods(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    e = checkpointed(_evidence(p))
    return tp.marker_periods(tp.topic_markers(p, e), tp.topic_periods(e, p)).withColumn("period_start", F.col("period_start").cast("string"))


def marker_recon(spark, sf_dir: str) -> DataFrame:
    p = _processed(spark, sf_dir)
    m = checkpointed(tp.topic_markers(p, _evidence(p)))
    return tp.marker_recon(m, tp.marker_summary(m))


_STOP = "[" + ", ".join(f"'{w}'" for w in ad.CHATS.stopwords) + "]"
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*')"
_BASE = f"""WITH {ad.sql_processed(ad.SQL_CHATS, ad.CHATS)}, tk AS (SELECT conversation_id, message_id, sender_id, period_date, aff, neg, {_TOKENS} AS ts FROM pm),
gr AS (SELECT conversation_id, message_id, sender_id, period_date, n, ts[i : i + n - 1] AS g FROM (SELECT *, unnest(generate_series(1, len(ts) - n + 1)) AS i FROM tk, (VALUES (1), (2), (3)) v(n) WHERE len(ts) >= n)),
ok AS (SELECT *, list_filter(g, lambda t: NOT list_contains({_STOP}, t)) AS ct FROM gr WHERE NOT list_contains({_STOP}, g[1]) AND NOT list_contains({_STOP}, g[len(g)])),
ph AS (SELECT conversation_id, message_id, sender_id, period_date, n, array_to_string(g, ' ') AS phrase, count(*) AS occurrences FROM ok
  WHERE len(ct) > 0 AND len(list_filter(ct, lambda t: regexp_matches(t, '\\p{{L}}'))) > 0 AND len(list_filter(ct, lambda t: length(t) >= 2 OR regexp_matches(t, '\\p{{N}}'))) = len(ct) GROUP BY 1, 2, 3, 4, 5, 6),
tm AS (SELECT conversation_id, count(DISTINCT message_id) AS messages FROM tk WHERE len(ts) > 0 GROUP BY 1),
pc AS (SELECT conversation_id, n, phrase, count(DISTINCT message_id) AS document_frequency, sum(occurrences)::BIGINT AS occurrences, count(DISTINCT sender_id) AS participants, min(period_date) AS first_date, max(period_date) AS last_date FROM ph GROUP BY 1, 2, 3),
sa AS (SELECT *, document_frequency * (ln((messages + 1)::DOUBLE / (document_frequency + 1)) + 1) * (1 + 0.15::DOUBLE * (n - 1)) AS s FROM pc JOIN tm USING (conversation_id) WHERE document_frequency >= 2 AND document_frequency <= messages),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY round(s, 9) DESC, document_frequency DESC, n DESC, phrase COLLATE "C") AS rank FROM sa) WHERE rank <= 50),
ev AS (SELECT ph.* FROM ph JOIN cand USING (conversation_id, n, phrase)),
mk AS (SELECT ev.*, aff, neg FROM ev JOIN (SELECT DISTINCT conversation_id, message_id, aff, neg FROM pm WHERE aff + neg > 0) USING (conversation_id, message_id)),
evp AS (SELECT *, 'week' AS period_kind, date_trunc('week', period_date)::DATE AS ps FROM ev UNION ALL SELECT *, 'month', date_trunc('month', period_date)::DATE FROM ev),
pmp AS (SELECT *, 'week' AS period_kind, date_trunc('week', period_date)::DATE AS ps FROM pm UNION ALL SELECT *, 'month', date_trunc('month', period_date)::DATE FROM pm),
pt AS (SELECT conversation_id, sender_id AS participant_id, period_kind, ps, count(DISTINCT message_id) AS k FROM pmp WHERE sender_id IS NOT NULL GROUP BY 1, 2, 3, 4),
tpd AS (SELECT conversation_id, n, phrase, sender_id AS participant_id, period_kind, ps, count(DISTINCT message_id) AS message_count, sum(occurrences)::BIGINT AS occurrences FROM evp GROUP BY 1, 2, 3, 4, 5, 6),
tpp AS (SELECT tpd.*, round(message_count::DOUBLE / k, 6) AS share FROM tpd LEFT JOIN pt USING (conversation_id, participant_id, period_kind, ps)),
mkp AS (SELECT *, 'week' AS period_kind, date_trunc('week', period_date)::DATE AS ps FROM mk UNION ALL SELECT *, 'month', date_trunc('month', period_date)::DATE FROM mk),
ms AS (SELECT conversation_id, n, phrase, count(DISTINCT message_id) AS message_count, sum(aff)::BIGINT AS affection_hits, sum(neg)::BIGINT AS negative_hits, count(DISTINCT message_id) FILTER (WHERE aff > 0) AS affection_messages, count(DISTINCT message_id) FILTER (WHERE neg > 0) AS negative_messages FROM mk GROUP BY 1, 2, 3)"""
_BASE = _BASE.replace('phrase COLLATE "C"', "phrase")

QUERIES = {
    "topic_tokens": topic_tokens, "topic_candidates": topic_candidates, "topic_evidence": topic_evidence, "topic_markers": topic_markers, "topic_periods": topic_periods, "topic_period_recon": topic_period_recon,
    "marker_summary": marker_summary, "marker_periods": marker_periods, "marker_recon": marker_recon,
}
ORACLES = {
    "topic_tokens": f"WITH {ad.SQL_CHATS} SELECT conversation_id, message_id, array_to_string({_TOKENS}, ' ') AS tokens FROM msg",
    "topic_candidates": f"{_BASE} SELECT conversation_id, rank, n::BIGINT AS n, phrase, document_frequency, occurrences, participants, first_date::VARCHAR AS first_date, last_date::VARCHAR AS last_date, messages, round(s, 6) AS salience FROM cand",
    "topic_evidence": f"{_BASE} SELECT conversation_id, n::BIGINT AS n, phrase, message_id, sender_id, occurrences FROM ev",
    "topic_markers": f"{_BASE} SELECT conversation_id, n::BIGINT AS n, phrase, message_id, aff AS affection_count, neg AS negative_count FROM mk",
    "topic_periods": f"{_BASE} SELECT conversation_id, n::BIGINT AS n, phrase, participant_id, period_kind, ps::VARCHAR AS period_start, message_count, occurrences, share FROM tpp",
    "topic_period_recon": f"{_BASE}, a AS (SELECT conversation_id, sum(occurrences)::BIGINT AS expected FROM ev GROUP BY 1), b AS (SELECT conversation_id, sum(occurrences) FILTER (WHERE period_kind = 'week')::BIGINT AS weekly, sum(occurrences) FILTER (WHERE period_kind = 'month')::BIGINT AS monthly FROM tpp GROUP BY 1) SELECT conversation_id, expected, weekly, monthly, expected = weekly AND expected = monthly AS ok FROM a FULL JOIN b USING (conversation_id)",
    "marker_summary": f"{_BASE} SELECT conversation_id, n::BIGINT AS n, phrase, message_count, affection_hits, negative_hits, affection_messages, negative_messages FROM ms",
    "marker_periods": f"{_BASE}, q AS (SELECT conversation_id, n, phrase, sender_id AS participant_id, period_kind, ps, count(DISTINCT message_id) AS marker_messages, sum(aff)::BIGINT AS affection_hits, sum(neg)::BIGINT AS negative_hits FROM mkp GROUP BY 1, 2, 3, 4, 5, 6) SELECT conversation_id, n::BIGINT AS n, phrase, participant_id, period_kind, ps::VARCHAR AS period_start, marker_messages, affection_hits, negative_hits, message_count AS topic_messages FROM q LEFT JOIN tpp USING (conversation_id, n, phrase, participant_id, period_kind, ps)",
    "marker_recon": f"{_BASE}, a AS (SELECT conversation_id, sum(aff)::BIGINT AS evidence_affection, sum(neg)::BIGINT AS evidence_negative FROM mk GROUP BY 1), b AS (SELECT conversation_id, sum(affection_hits)::BIGINT AS summary_affection, sum(negative_hits)::BIGINT AS summary_negative FROM ms GROUP BY 1) SELECT conversation_id, evidence_affection, evidence_negative, summary_affection, summary_negative, evidence_affection = summary_affection AND evidence_negative = summary_negative AS ok FROM a FULL JOIN b USING (conversation_id)",
}
