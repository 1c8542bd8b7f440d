"""Importance resampling against a plain Python version, word by word."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from threadloom.llm import resampling
from threadloom.llm.resampling import ResampleConfig

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, config=ResampleConfig()):
    """docs: (doc_id, text). Rows of doc_id, n_features, weight, score, rank, n_words."""

    def split(text):
        words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        runs = [b" ".join(words[i : i + n]) for n in range(1, config.longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r) % config.buckets for r in runs]

    parts = [split(t) for _, t in docs]
    s, t = Counter(b for _, f in parts for b in f), Counter(b for x in target for b in split(x)[1])
    whole, aim, n = sum(s.values()), sum(t.values()), config.buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (whole + n) / ((s[b] + 1.0) * (aim + n)))) for b in s}
    rows = []
    for (doc_id, _), (words, f) in zip(docs, parts, strict=True):
        h = int(hashlib.sha256(f"{config.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= config.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = Counter()
    drawn = {}
    for i, r in enumerate(able[: len(able) * config.percent // 100]):
        drawn.setdefault(r, []).append(i + 1)
    out = []
    for r in rows:
        at = drawn.get(r, [])
        out.append((*r[:4], at[rank[r]] if rank[r] < len(at) else None, r[4]))
        rank[r] += 1
    return Counter(out)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert Counter(map(tuple, resampling.op11_resampling(spark, SF).collect())) == brute(docs, target)


def test_longer_features_and_edges(spark):
    rng = random.Random(5)
    words = ["ab", "Cd", "é", "x1", "Ž", "the", "q" * 90, "-", "\x7f"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(80)]
    # A repeated row, a null key twice, a null and an empty text, ties between unequal keys by words alone.
    docs += [docs[7], docs[7], (None, docs[3][1]), (None, docs[3][1]), (90, None), (91, ""), (92, "the " * 25), (93, "the " * 25)]
    target = ["the ab ab Cd", None, ""]
    config = ResampleConfig(buckets=97, longest=3, percent=40, least_words=20)
    table = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id bigint, text string, weight int, other double").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.ranked(resampling.score(table, aim, config=config), "doc_id", config)
    assert out.columns == ["doc_id", "text", "other", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words) for r in out.collect()) == brute(docs, target, config)
    drawn = resampling.resample(table, aim, config=config).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1)) and all(r.other == 2.0 for r in drawn)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id bigint, text string")
    assert resampling.resample(none, some).collect() == []
    assert resampling.resample(some, none).collect() == []  # a tenth of one document is none
    assert resampling.resample(some, none, config=ResampleConfig(percent=100)).first()["rank"] == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=80), max_size=20))
def test_crc_of_spans(parts):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    start = end - np.array([len(p) for p in parts], dtype=np.int64)
    assert resampling.crc_spans(data, start, end).tolist() == [zlib.crc32(p) for p in parts]
