"""Bind an intermediate value once inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used.

    A one-element array hands the value to a lambda; without this, projection
    collapsing would paste the whole expression at every use, which inside a
    higher-order function means once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, array: Column, name: str, *kept: str | Column) -> DataFrame:
    """``kept`` columns with one row per element of a computed array.

    A plain ``explode`` makes the optimizer infer "array is not empty" and push
    it towards the scan, which evaluates the whole array expression two more
    times, before any redistribution of rows. The outer form infers nothing;
    the placeholder row of an empty array is dropped afterwards.
    """
    return df.select(*kept, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
