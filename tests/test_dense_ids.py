"""Dense ids hold together however often rows are computed."""

import random

from pyspark.sql import functions as F

from threadloom.operators import canonical as ca


def test_ids_of_rows_that_differ_each_time(spark):
    draw = F.udf(lambda i: random.random(), "double").asNondeterministic()
    rows = spark.range(0, 4000, 1, 4).select(draw("id").alias("x"))
    reuse = "spark.sql.exchange.reuse"
    spark.conf.set(reuse, "false")  # as where Spark finds no equal exchange: each side computes its own
    found = sorted((r.n, r.x) for r in ca.dense_ids(rows, ["x"], "n").collect())
    spark.conf.unset(reuse)
    assert [n for n, _ in found] == list(range(1, 4001)) and [x for _, x in found] == sorted(x for _, x in found)
