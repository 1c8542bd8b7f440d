"""The language model against dictionaries of word tuples."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import common, language_model
from threadloom.llm.language_model import ModelConfig

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text) -> list:
    return [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), "end"]


class Plain:
    """Counts of tuples, from the formula alone."""

    def __init__(self, texts, order):
        self.order = order
        streams = [["start"] * (order - 1) + tokens(t) for t in texts]
        self.raw = Counter(w for s in streams for w in s if w != "start")
        self.a = {order: Counter(tuple(s[i : i + order]) for s in streams for i in range(len(s) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.a[k] = Counter(g[1:] for g in self.a[k + 1])
        self.d = {}
        for k, a in self.a.items():
            n = [sum(c == i for c in a.values()) for i in (1, 2, 3, 4)]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                self.d[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) for i in (1, 2, 3)]
            else:
                self.d[k] = [0.5, 1.0, 1.5]
        self.after = {k: {} for k in self.a}
        for k, a in self.a.items():
            for g, c in a.items():
                self.after[k].setdefault(g[:-1], []).append(c)

    def p(self, context, word, k=None):
        k = self.order if k is None else k
        if k == 0:
            return 1 / (len(self.raw) + 1)
        context = tuple(context[len(context) - k + 1 :]) if k > 1 else ()
        low = self.p(context, word, k - 1)
        counts = self.after[k].get(context)
        if not counts:
            return low
        c, d = self.a[k].get((*context, word), 0), self.d[k]
        rest = sum(d[min(x, 3) - 1] for x in counts) / sum(counts)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(counts) + rest * low

    def score(self, text):
        s = ["start"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(s[i - self.order + 1 : i], s[i])) for i in range(self.order - 1, len(s)))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "sat", "é", "on", "mat", "A", "dog", "ran", "</s>", "<s>", "x" * 70]
    return [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(25))) for _ in range(n)] + [None, "", " \n", "the the the the the"]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_dictionaries(spark, order):
    train, held = corpus(1), corpus(2, 30) + ["never seen words here", "The Cat sat"]
    # Ranges so small that each level has many files.
    model = language_model.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), config=ModelConfig(order, range_size=64))
    assert len([f for f in model.levels[-1].files if f]) > 4
    plain = Plain(train, order)
    assert (model.tokens, model.words) == (sum(plain.raw.values()), len(plain.raw))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(train + held)], "doc_id bigint, text string, score string")
    out = language_model.score(docs, model)
    assert out.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    for r in out.collect():
        words = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(words), sum(w in plain.raw for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((plain.raw[w] + 1) / (model.tokens + model.words + 1)) for w in words), rel=1e-12)
        assert r.score == pytest.approx(plain.score(r.text), rel=1e-10)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens), rel=1e-10)


def test_sums_to_one(spark):
    train = corpus(3)
    model = language_model.train(spark.createDataFrame([(t,) for t in train], "text string"), config=ModelConfig(3))
    plain = Plain(train, 3)
    words = [w.decode() for w in plain.raw if w != "end"]
    for context in ("the cat", "cat", "", "unheard of", "of the"):
        texts = [f"{context} {w}" for w in [*words, "a-word-that-is-new"]]
        buffer = "".join(texts).encode()
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        row, _, p = language_model.probabilities(model, np.frombuffer(buffer, np.uint8), offsets)
        n = len(context.split())
        place = np.arange(len(row)) - np.searchsorted(row, row)
        # All words, one that is new, and the end of the context itself.
        end = language_model.probabilities(model, np.frombuffer(context.encode(), np.uint8), np.array([0, len(context.encode())]))[2][-1]
        assert p[place == n].sum() + end == pytest.approx(1, abs=1e-12)


def test_learns_something(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r for r in language_model.op13_lm_scoring(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    model = language_model.train(none)
    assert language_model.score(none, model).collect() == []
    r = language_model.score(spark.createDataFrame([("a b",), (None,)], "text string"), model).collect()
    assert [(x.n_tokens, x.n_known, x.base_score, x.score) for x in r] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        language_model.train(none, config=ModelConfig(1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_mix_is_reversible(xs):
    x = np.array(xs, dtype=np.uint64)
    assert language_model.unmix(common.mix(x)).tolist() == xs


def test_a_file_of_each_range_counts_once(spark, tmp_path):
    # Files of attempts whose rows never came are left aside.
    rows = spark.createDataFrame([("a b c",)], "text string")
    model = language_model.train(rows, folder=f"file://{tmp_path}/model")
    (tmp_path / "model" / "level-2-000000-other.arrow").write_bytes(b"torn")
    assert language_model.score(rows, model).first().n_known == 4
