"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import periodic_runs
from threadloom.llm.periodic_runs import RunConfig

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """Every period against every place; a stretch counts with its smallest period only."""
    ids: dict = {}
    s = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(s) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], s[q:] == s[:-q], [0]]))).reshape(-1, 2)
        for a, b in edges.tolist():
            if b - a + q >= max(least, exponent * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text) -> tuple:
    """A row of the registered query, from its contract alone."""
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for at, length, q in runs for i in range(at + q, at + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), n)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = {brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, sf).collect()} == want
    assert any(r[1] for r in want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (4, 2), (9, 3), (1, 2)]))
def test_division_against_brute_force(words, limits):
    assert periodic_runs.main_lorentz(words, RunConfig(*limits)) == brute_runs(words, *limits)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é"]), max_size=40), min_size=1, max_size=5), st.integers(1, 12), st.integers(0, 30))
def test_masked_words_join_no_run(texts, period, extra):
    # A stretch with a period of its own is put between the others' words.
    texts[0] = [*texts[0], *[f"w{i % period}" for i in range(4 * period + extra)], *texts[0]]
    data = np.frombuffer("".join(" ".join(t) + " " for t in texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((" ".join(t) + " ").encode()) for t in texts])])
    found = periodic_runs.runs_of(data, *periodic_runs.word_spans(data, offsets), RunConfig())
    assert found == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_overlap():
    assert RunConfig().overlap == 5
    assert RunConfig(1, 2).overlap == 1
    assert RunConfig(20, 3).overlap == min(max(20, 3 * q) - q for q in range(1, 40))


def test_long_and_hostile_texts():
    rng = random.Random(3)
    once = ["x"] * 20_000
    assert periodic_runs.main_lorentz([0] * 20_000) == brute_runs(once[:400])[:0] + [(0, 20_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 10_000:
        a, b = b, b + a
    assert periodic_runs.main_lorentz(b) == brute_runs(b[:1]) + []  # a Fibonacci word has no fourth power
    nested = ([0, 0, 0, 0, 0, 0, 1] * 6 + [2]) * 5
    assert periodic_runs.main_lorentz(nested) == brute_runs(nested)
    noise = [rng.randrange(2) for _ in range(3000)]
    assert periodic_runs.main_lorentz(noise) == brute_runs(noise)


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (3, " \t\n", 7), (4, "a " * 6, 8), (4, "a " * 6, 8), (None, "a a a a a", 9), (5, "a\x0bb" * 1, 0), (6, "é é é é é é x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    out = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()}
    assert out[1, None] == out[2, ""] == out[3, " \t\n"] == (0, [], "")
    assert out[4, "a " * 6] == (6, [(0, 6, 1)], "a")
    assert out[None, "a a a a a"] == (5, [], "a a a a a")
    assert out[5, "a\x0bb"] == (2, [], "a b")
    assert out[6, "é é é é é é x"] == (7, [(0, 6, 1)], "é x")
    assert periodic_runs.find_runs(docs).count() == len(rows)
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []
    assert periodic_runs.find_runs(docs).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
