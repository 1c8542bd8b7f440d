"""Numbers whose last digit doesn't hang on the engine, and values that an expression reads more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """Half up to so many digits, by floating-point steps that any engine does alike."""
    scale = F.lit(float(10**digits))
    return F.floor(c * scale + F.lit(0.5)).cast("double") / scale


def sql_fixed(c: str, digits: int) -> str:
    """The same in SQL."""
    return f"floor(({c}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of c, which is computed once however often body reads it: Catalyst never inlines a lambda's variable."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def sorted_median(s: Column) -> Column:
    """Of an array in order; null if it is empty."""
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
