"""Poisson tables at high rates, URLs with a second "://", and samples of repeated URLs."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import source_mix, url_filter


def cdf(rate: float) -> tuple[int, np.ndarray]:
    """First count and P(X <= k) from it on, by lgamma."""
    least = math.floor(rate - 12 * math.sqrt(rate) - 24)
    least = least if least >= 32 else 0
    k = np.arange(least, math.ceil(rate + 12 * math.sqrt(rate) + 24) + 1)
    p = [math.exp(-rate + (i * math.log(rate) - math.lgamma(i + 1) if i else 0)) for i in k.tolist()]
    return least, np.cumsum(p)


def test_poisson_tables(spark):
    rates = [0.001, 0.5, 3.0, 190.0, 261.0, 999.5, 20_000.0]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").withColumn("least", source_mix.least_count(F.col("rate")))
    for r in rows.select("rate", "least", source_mix.poisson_cdf(F.col("rate"), F.col("least")).alias("cdf")).collect():
        least, want = cdf(r.rate)
        assert (r.least, len(r.cdf)) == (least, len(want))
        assert np.abs(np.array(r.cdf) - want).max() < 1e-9
        assert abs(r.cdf[-1] - 1) < 1e-12 and list(r.cdf) == sorted(r.cdf)
    began = time.time()
    big = spark.createDataFrame([(1e6,)], "rate double").withColumn("least", source_mix.least_count(F.col("rate")))
    out = big.select("least", source_mix.poisson_cdf(F.col("rate"), F.col("least")).alias("cdf")).first()
    assert len(out.cdf) < 25_000 and time.time() - began < 20
    middle = out.least + np.searchsorted(out.cdf, 0.5)
    assert abs(middle - 1e6) <= 2


def test_counts_by_halving(spark):
    for n in range(1, 20):
        table = [i / n for i in range(1, n + 1)]
        rows = spark.createDataFrame([(table, u / 37) for u in range(38)], "t array<double>, u double")
        assert all(r.k == sum(x <= r.u for x in table) for r in rows.select("t", "u", source_mix.count_at_most(F.col("t"), F.col("u")).alias("k")).collect())


def test_small_sources_at_high_rates(spark, monkeypatch):
    # One source of a few characters beside a large one, by broadcast and by a shuffle.
    docs = spark.createDataFrame([(i, "large", "x" * 5000) for i in range(200)] + [(1000 + i, "small", "y") for i in range(3)], "doc_id bigint, source string, text string")
    rows = source_mix.mix(docs, ordered=False).where("source = 'small'").select("doc_id", "n_copies", "rate").distinct().collect()
    assert all(abs(r.n_copies - r.rate) < 6 * math.sqrt(r.rate) and r.rate > 200 for r in rows) and len(rows) == 3
    monkeypatch.setattr(source_mix, "BROADCAST_ENTRIES", 0)
    assert sorted(map(tuple, source_mix.mix(docs, ordered=False).where("source = 'small'").select("doc_id", "n_copies", "rate").distinct().collect())) == sorted(map(tuple, rows))


def test_second_scheme_is_no_host(spark):
    urls = [
        "http://example.com?u=http://other.org/en/x", "http://shop.net#a://b/es/", "https://a.net?next=ftp://c/fr/y", "http://example.com/en/?u=http://www.example.com/en/", "://", "a://b://c/en/",
        "http:///es/", "x http://EXAMPLE.com/en/a b", "http://net/es/://net/fr/", "no scheme", None, "http://a\nb.net/es/\nq?x", "http://é.net/fr/é#://",
    ]
    rows = {r.i: r for r in url_filter.with_rules(spark.createDataFrame(list(enumerate(urls)), "i int, url string")).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [(len(rule), rule, verdict) for verdict, rule in url_filter.RULES for name, _, rest in [rule.partition("/")] if (host == name or host.endswith(f".{name}")) and path.startswith(f"/{rest}")]
        _, rule, verdict = max(fits, default=(0, None, None))
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i]._listed) == (host, path, rule, verdict), u
    assert (rows[0].host, rows[0].path, rows[0].rule) == ("example.com", "", None)


def test_repeated_urls_leave_room_for_others(spark):
    hot = spark.range(20_000).select(F.lit("http://hot.com/").alias("url"), (F.col("id") % 2).cast("int").alias("block"))
    others = spark.range(400).select(F.concat(F.lit("http://h"), "id", F.lit(".net/")).alias("url"), F.lit(1).alias("block"))
    fitted = {}

    def note(urls, labels, config, counts):
        fitted.update(zip(zip(urls, labels.tolist(), strict=True), counts.tolist(), strict=True))

    fit, url_filter.fit = url_filter.fit, note
    try:
        url_filter.train(hot.union(others).union(spark.createDataFrame([(None, 1), ("x", None)], "url string, block int")), url_filter.TreeConfig(max_labelled=300))
    finally:
        url_filter.fit = fit
    assert 200 < len({u for u, _ in fitted}) < 400
    assert fitted.get(("http://hot.com/", 0.0), 10_000) == fitted.get(("http://hot.com/", 1.0), 10_000) == 10_000
