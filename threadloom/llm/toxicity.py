"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted over the whole corpus. Where a text holds digits or signs among letters, letters
repeated three times and more, or letters spaced one by one, the span becomes a lattice of what each character may stand
for, and the Viterbi path under channel and language model replaces it. Words of the restored text and their beginnings
are looked up among those learned from labelled documents: for each the lower bound of its share of toxic documents.
The three largest of a document's words go through a logistic curve that was fitted to left-one-out values.

The labelled rows that the lexicon is learned from are about max_labelled, those of the smallest hash; the trigram
counts cover all documents, and are as many as the alphabet allows, so that the driver gets a bounded table.

Defined results: null and empty texts have no words and get the score of no evidence; equal texts get equal scores, and
repeated rows are scored each for itself; ties among labelled rows go by doc_id; rows with a null label are left out;
without toxic labelled rows every score is that of no evidence; extra columns pass through, a column named as one of the
operator's own is replaced; an empty table gives an empty table. Texts are restored and scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, text_slices

#: What signs and digits may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Costs of the channel, as negative logarithms: a substitution, a sign or digit that stands for nothing, a letter that stands for itself twice.
SUBSTITUTED, DELETED, DOUBLED = 1.0, 10.0, 0.7
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÿ"
SIZE = len(LETTERS) + 1
_CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
_WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(LEET))
#: A run of letters, digits and signs with at least one digit or sign in it.
_MIXED = re.compile(rf"(?<![\w{_SIGNS}])[^\W\d]*[{_SIGNS}][\w{_SIGNS}]*")
_SIGN = re.compile(rf"[{_SIGNS}]")
_TAIL = re.compile(r"([$!+|(@])\1+$|!$")
_RUN = re.compile(r"[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*")
_HAS_RUN = re.compile(r"([^\W\d_])\1\1")
#: Four letters or signs and more, with the same blank, dot, dash, underscore or star between each two.
_SPACED = re.compile(rf"(?<![^\W_])([^\W_]|[{_SIGNS}])([ .\-_*])(?:(?:[^\W_]|[{_SIGNS}])\2){{2,}}(?:[^\W_]|[{_SIGNS}])(?![^\W_])")


@dataclass(frozen=True)
class ToxicityConfig:
    #: Labelled rows that the lexicon is learned from, about, if there are more.
    max_labelled: int = 12_000
    prefixes: tuple[int, ...] = (4, 5, 6, 7)
    #: A word or beginning is kept from this lower bound on.
    least: float = 0.25
    threshold: float = 0.7
    #: Words whose evidence, and spans whose restoration, a task remembers.
    remembered: int = 200_000


# The language model


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, as a cube over the alphabet; class 0 is everything that is no letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(256, dtype=np.int64)
        for c, i in _CLASS.items():
            table[ord(c)] = i
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for lo, hi, _, _ in text_slices(column):
                # Texts are joined by line breaks, which are class 0, so that no trigram of letters spans two.
                joined = "\n\n".join(["", *[t or "" for t in column.slice(lo, hi - lo).to_pylist()], ""]).lower()
                ids = table[np.frombuffer(joined.encode("latin-1", "replace"), dtype=np.uint8)]
                total += np.bincount((ids[:-2] * SIZE + ids[1:-1]) * SIZE + ids[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    sums = docs.select(text).mapInArrow(count, "trigram bigint, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))
    cube = np.zeros(SIZE**3)
    for row in sums.collect():  # SIZE ** 3 rows at most
        cube[row.trigram] = row.n
    return cube.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Negative logarithms of P(c | ab), with bigrams and unigrams mixed in."""
    uni = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SIZE)
    two = counts.sum(axis=0)
    bi = (two + 5 * uni) / (two.sum(axis=1, keepdims=True) + 5)
    tri = (counts + 2 * bi[None, :, :]) / (counts.sum(axis=2, keepdims=True) + 2)
    return -np.log(tri).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each run of a character what it may stand for, with the channel's cost."""
    out = []
    i = 0
    while i < len(span):
        c = span[i]
        j = i + 1
        while j < len(span) and span[j] == c:
            j += 1
        n = j - i
        if c in _CLASS:
            out.append([(c * n, 0.0)] if n < 3 else [(c, 0.0), (c * 2, DOUBLED)])
        elif c in LEET:
            arcs = [(x * k, SUBSTITUTED + DOUBLED * (k > 1)) for x in LEET[c] for k in ((1,) if n == 1 else (1, 2))]
            out.append([*arcs, ("", DELETED)])
        elif c.isalpha():
            out.append([(c, 0.0)])
        else:
            out.append([("", 0.0)])
        i = j
    return out


def viterbi(arcs: list[list[tuple[str, float]]], lm: np.ndarray) -> str:
    """The cheapest path from the start of a word to its end; states are the last two classes, paths are linked lists."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in arcs:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for text, channel in choices:
                p, q, total = a, b, cost + channel
                for c in text:
                    k = _CLASS.get(c, 0)
                    total += float(lm[p, q, k])
                    p, q = q, k
                if (p, q) not in new or total < new[p, q][0]:
                    new[p, q] = (total, (text, path) if text else path)
        states = new
    cost, path = min(((cost + float(lm[a, b, 0]), path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


class Restorer:
    def __init__(self, lm: np.ndarray, remembered: int = 200_000):
        self.lm, self.known, self.most = lm, {}, remembered

    def span(self, s: str) -> str:
        out = self.known.get(s)
        if out is None:
            out = viterbi(lattice(s), self.lm)
            if len(self.known) < self.most:
                self.known[s] = out
        return out

    def _mixed(self, m: re.Match) -> str:
        s = m[0]
        body = _TAIL.sub("", s)
        if sum(c in _CLASS for c in body) < 2 or not any(c in LEET for c in body):
            return s
        return self.span(body)

    def __call__(self, text: str) -> str:
        """The text in lower case with its obfuscated spans restored."""
        t = text.lower()
        t = _SPACED.sub(lambda m: self.span(m[0].replace(m[2], "")), t)
        if _SIGN.search(t):
            t = _MIXED.sub(self._mixed, t)
        return _RUN.sub(lambda m: self.span(m[0]), t) if _HAS_RUN.search(t) else t


# The lexicon


def lower_bound(t: float, n: float, z: float = 1.96) -> float:
    """Wilson's bound of a share of t in n."""
    if n <= 0:
        return 0.0
    p = max(0.0, t) / n
    return (p + z * z / 2 / n - z * math.sqrt(max(0.0, p * (1 - p) / n + z * z / 4 / n / n))) / (1 + z * z / n)


def parts(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *[f"{word[:k]}*" for k in prefixes if len(word) > k]]


@dataclass
class Lexicon:
    bounds: dict[str, float]
    weights: tuple[float, ...]
    prefixes: tuple[int, ...]
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def evidence(self, word: str) -> float:
        """The largest bound of the word's parts."""
        found = max((self.bounds.get(p, 0.0) for p in parts(word, self.prefixes)), default=0.0)
        if len(self.memo) < 400_000:
            self.memo[word] = found
        return found

    def score(self, restored: str) -> float:
        words = set(_WORD.findall(restored))
        known = self.memo
        top = [e for w in words if (e := known[w] if w in known else self.evidence(w))]
        return logistic(self.weights, [*sorted(top, reverse=True)[:3], 0.0, 0.0, 0.0][:3])


def logistic(weights, x) -> float:
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn(texts: list[str | None], labels: list[int], restorer: Restorer, config: ToxicityConfig = ToxicityConfig()) -> Lexicon:
    restored = [restorer(t or "") for t in texts]
    toxic: Counter = Counter()
    for t, y in zip(restored, labels, strict=True):
        if y:
            toxic.update({p for w in set(_WORD.findall(t)) for p in parts(w, config.prefixes)})
    known: dict[str, list[str]] = {}  # parts of a word that toxic documents have

    def in_toxic(w: str) -> list[str]:
        if w not in known:
            known[w] = [p for p in parts(w, config.prefixes) if p in toxic]
        return known[w]

    seen: Counter = Counter()
    for t in restored:
        seen.update({p for w in set(_WORD.findall(t)) for p in in_toxic(w)})
    bounds = {p: b for p, t in toxic.items() if (b := lower_bound(t, seen[p])) >= config.least}
    lexicon = Lexicon(bounds, (), config.prefixes)
    x = np.ones((len(texts), 4))
    for i, (t, y) in enumerate(zip(restored, labels, strict=True)):
        own = set(_WORD.findall(t))
        # A toxic document is judged by what the others have taught.
        found = (max((lower_bound(toxic[p] - 1, seen[p] - 1) for p in in_toxic(w) if p in bounds), default=0.0) for w in own) if y else map(lexicon.evidence, own)
        top = sorted((e for e in found if e >= config.least), reverse=True)[:3]
        x[i, 1:] = [*top, 0.0, 0.0, 0.0][:3]
    return Lexicon(bounds, fit_logistic(x, np.array(labels, dtype=float)), config.prefixes)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Newton's method; the ridge holds the weights where the classes part cleanly."""
    w = np.zeros(x.shape[1])
    if not len(y) or not y.sum():
        return (-6.0, *[0.0] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, config: ToxicityConfig = ToxicityConfig()) -> Lexicon:
    """docs: doc_id, text; labels: doc_id, toxic, the rows that may be learned from."""
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = bounded_sample(chosen, config.max_labelled, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()  # max_labelled rows, about
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r.toxic))
    return learn([r.text for r in rows], [r.toxic for r in rows], Restorer(lm, config.remembered), config)


def score(docs: DataFrame, lm: np.ndarray, lexicon: Lexicon, text: str = "text", config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of docs with score (double), predicted (int) and n_restored, the number of characters that restoring took away or changed in length."""
    names = ["score", "predicted", "n_restored"]
    base = docs.drop(*[n for n in names if n != text])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_restored", T.LongType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(lm, config.remembered)
        for batch in batches:
            column, scores, changed = batch.column(text), [], []
            for lo, hi, _, _ in text_slices(column):
                for t in column.slice(lo, hi - lo).to_pylist():
                    restored = restore(t or "")
                    scores.append(lexicon.score(restored))
                    changed.append(abs(len(t or "") - len(restored)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= config.threshold) for s in scores], pa.int32()), pa.array(changed, pa.int64())], names=[*batch.schema.names, *names])

    return base.mapInArrow(judge, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned only from labelled rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    lm = language_model(trigram_counts(docs))
    scored = score(docs, lm, train(docs, labels, lm))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_restored")


assert all(b > a for a, b in pairwise(ToxicityConfig().prefixes))
