"""All registered queries of the library, but those of subpackages that may be missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, core, gates, identity, imports, lexical, store, trends


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Whole numbers are 64 bits wide in every result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        narrow = [n for n, t in out.dtypes if t in ("int", "smallint", "tinyint")]
        return out.withColumns({n: out[n].cast("bigint") for n in narrow}) if narrow else out

    return run


QUERIES = {name: _wide(query) for name, query in {**core.QUERIES, **trends.QUERIES, **lexical.QUERIES, **identity.QUERIES, **store.QUERIES, **gates.QUERIES, **imports.QUERIES, **audits.QUERIES}.items()}
ORACLES = {**core.ORACLES, **trends.ORACLES, **lexical.ORACLES, **identity.ORACLES, **store.ORACLES, **gates.ORACLES, **imports.ORACLES, **audits.ORACLES}
