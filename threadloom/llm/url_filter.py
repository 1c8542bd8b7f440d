"""URL filters: gradient-boosted trees on lexical features, after lists of rules.

A rule is a host and a path prefix; it fits its host and all subdomains where the URL's path starts with the rule's, and
the longest rule that fits decides. What no rule decides, trees judge that were fitted to labelled URLs: by length, depth,
digit ratio, entropy, parameter counts and statistics of the host's suffixes in the labelled set.

The trees are fitted on the driver to a bounded sample of the labelled URLs (about max_labelled, those of the smallest hash, so
that the same URLs give the same trees; a URL that repeats weighs as often as it does), both kinds weighing the same; the model that tasks get is bounded by max_suffixes and the trees' size.

Defined results: a null URL or one without "://" has an empty host and path, no rule, and is judged by the trees as an
empty string is; equal URLs get equal verdicts; extra columns pass through, columns of the operator's own names are
replaced; without labelled rows of both kinds the share of blocked ones is the score; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, materialize

#: verdict and rule; the rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
ADDED = (("host", "string"), ("path", "string"), ("rule", "string"), ("score", "double"), ("verdict", "string"))
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class TreeConfig:
    #: Labelled rows that the trees are fitted to, about, if there are more.
    max_labelled: int = 20_000
    max_suffixes: int = 5_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    min_leaf: int = 20
    threshold: float = 0.5


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path of a URL."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[cut:] if rest[cut : cut + 1] == "/" else ""
    return rest[:cut].translate(_LOWER), path[: m.start()] if (m := _PATH_END.search(path)) else path


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in sorted(Counter(s).values())) if s else 0.0


FEATURES = ("length", "host_length", "path_length", "depth", "dots", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "n_params", "has_fragment", "first_segment_length", "suffix_1", "suffix_2", "suffix_1_count")


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def features(url: str | None, host: str, path: str, known: dict[str, tuple[float, int]], prior: float) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    one, two = suffixes(host)
    digits = sum(c.isdigit() for c in url)
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"), digits / max(1, len(url)), sum(c.isdigit() for c in host) / max(1, len(host)),
        entropy(url), entropy(host), len([p for p in query.split("&") if p]), float("#" in url), len(path.split("/")[1]) if "/" in path else 0,
        known.get(one, (prior, 0))[0], known.get(two, (prior, 0))[0], math.log1p(known.get(one, (prior, 0))[1]),
    ]


@dataclass
class Trees:
    """Boosted regression trees under the logistic loss, fitted to histograms of the features."""

    base: float
    prior: float
    known: dict[str, tuple[float, int]]
    nodes: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """nodes of a tree stand as in a heap: (feature, cut, value); a feature of -1 is a leaf."""
        total = np.full(len(x), self.base)
        for tree in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(urls: list[str | None], labels: np.ndarray, config: TreeConfig = TreeConfig(), counts: np.ndarray | None = None) -> Trees:
    """labels: 1 for block; counts: how often each row was seen. Rows are taken in the order given; equal input gives equal trees."""
    counts = np.ones(len(labels)) if counts is None else counts
    n, ones = float(np.sum(counts)), float(np.sum(counts * labels))
    # Both kinds weigh the same, however rare one is, so that 0.5 parts them; a single kind gives its own share.
    both = 0 < ones < n
    weight = counts * (np.where(labels > 0, n / (2 * ones), n / (2 * (n - ones))) if both else 1.0)
    prior = 0.5 if both else (ones + 0.5) / (n + 1)
    parts = [split_url(u) for u in urls]
    seen: dict[str, list[float]] = {}
    for (host, _), y, w, often in zip(parts, labels, weight, counts, strict=True):
        for s in dict.fromkeys(suffixes(host)):
            c = seen.setdefault(s, [0.0, 0.0, 0])
            c[0] += float(y * w)
            c[1] += float(w)
            c[2] += int(often)
    top = sorted(seen, key=lambda s: (-seen[s][2], s))[: config.max_suffixes]
    model = Trees(math.log(prior / (1 - prior)), prior, {s: ((seen[s][0] + 10 * prior) / (seen[s][1] + 10), int(seen[s][2])) for s in top})
    if not 0 < ones < n:
        return model
    x = np.array([features(u, h, p, model.known, prior) for u, (h, p) in zip(urls, parts, strict=True)])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, config.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw = np.full(len(labels), model.base)
    for _ in range(config.trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (labels - p), weight * p * (1 - p)
        size = 2 ** (config.depth + 1) - 1
        tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * size
        where = np.zeros(len(labels), dtype=np.int64)
        for node in range(size):
            rows = np.flatnonzero(where == node)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, -1, 0)
            if node < 2**config.depth - 1 and len(rows) >= 2 * config.min_leaf:
                for j in range(x.shape[1]):
                    b = binned[rows, j]
                    m = len(cuts[j]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, weights=v, minlength=m))[:-1] for v in (grad[rows], hess[rows], np.ones(len(rows))))
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                    gain[(nl < config.min_leaf) | (len(rows) - nl < config.min_leaf)] = -1
                    if len(gain) and (k := int(np.argmax(gain))) is not None and gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                tree[node] = (best[1], float(cuts[best[1]][best[2]]), 0.0)
                where[rows] = 2 * node + 1 + (binned[rows, best[1]] > best[2])
            else:
                tree[node] = (-1, 0.0, config.rate * float(g / (h + 1)))
                raw[rows] += tree[node][2]
        model.nodes.append(tree)
    return model


def train(labelled: DataFrame, config: TreeConfig = TreeConfig()) -> Trees:
    """labelled: url and block (0 or 1). Rows with a null label are left out; URLs that repeat weigh as often as they do."""
    known = labelled.where("block IS NOT NULL").groupBy("url").agg(F.sum(F.col("block").cast("bigint")).alias("bad"), F.count("*").alias("n"))
    rows = sorted(bounded_sample(materialize(known, "url-labels"), config.max_labelled, "url").collect(), key=lambda r: (r.url is not None, r.url or ""))
    both = [(r.url, y, c) for r in rows for y, c in ((0, r.n - r.bad), (1, r.bad)) if c]
    return fit([u for u, _, _ in both], np.array([y for _, y, _ in both], dtype=float), config, np.array([c for _, _, c in both], dtype=float))


def with_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and _listed (the rule's verdict), all null-safe column functions: a host looks up its own suffixes."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    # What follows the first "://": a later one is a matter of the query or fragment.
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    by_host: dict[str, list[Column]] = {}
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        by_host.setdefault(name.translate(_LOWER), []).append(F.struct(F.lit(slash + prefix).alias("prefix"), F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    kind = "array<struct<prefix:string,n:int,rule:string,verdict:string>>"
    table = F.create_map(*[x for k, v in by_host.items() for x in (F.lit(k), F.array(*v))]) if by_host else F.create_map().cast(f"map<string,{kind}>")
    base = pages.drop(*[n for n, _ in ADDED if n != url]).withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    own = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(own, lambda h: F.coalesce(F.try_element_at(table, h), F.array().cast(kind)))), lambda r: F.startswith(F.col("path"), r.prefix))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r.n.alias("n"), r.rule.alias("rule"), r.verdict.alias("verdict"))))
    return base.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "_listed": F.col("_best.verdict")}).drop("_best")


def classify(pages: DataFrame, model: Trees, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """The rows of pages with host, path, rule, score (of the trees, for every row) and verdict added."""
    listed = with_rules(pages, rules, url)
    if url in ("host", "path", "rule"):
        raise ValueError(f"the column of URLs can't be named {url}")
    schema = T.StructType([*listed.schema.fields, T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (url, "host", "path")), strict=True)
            x = np.array([features(u, h, p, model.known, model.prior) for u, h, p in rows]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], names=[*batch.schema.names, "score"])

    judged = listed.mapInArrow(judge, schema)
    return judged.withColumn("verdict", F.coalesce("_listed", F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop("_listed")


#: Words that a page is blocked for, and the share of its words, in percent, that may be of symbols.
SPAM_WORDS = r"\b(casino|jackpot|viagra|porn|xxx|cheap|free money|buy now)\b"
MAX_SYMBOL_WORDS = 20


def content_labels(pages: DataFrame, html: str = "html") -> DataFrame:
    """url and block, 1 where the text of the page itself is spam or junk: labels that neither the URL nor any rule has a part in.
    Pages without text have no label."""
    text = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]*>", " ")
    rows = pages.select("url", F.lower(text).alias("_text"))
    n, junk = F.regexp_count("_text", F.lit(r"\S+")), F.regexp_count("_text", F.lit(r"[#*$%]{2,}(?=\s)"))
    return rows.select("url", F.when(n > 0, (F.col("_text").rlike(SPAM_WORDS) | (junk * 100 > n * MAX_SYMBOL_WORDS)).cast("int")).alias("block")).where("block IS NOT NULL")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; the trees are fitted to URLs labelled by what their pages say."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    # Only the pages of URLs that are learned from are read for their labels.
    chosen = bounded_sample(materialize(pages.select("url").where("url IS NOT NULL").distinct(), "urls"), TreeConfig().max_labelled, "url")
    return classify(pages.select("page_id", "url"), train(content_labels(pages.join(F.broadcast(chosen), "url"))))
