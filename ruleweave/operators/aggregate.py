"""Aggregates over sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleError, TypeMismatch

FUNCTIONS = ("avg", "count", "max", "min", "sum")


def aggregate(df: DataFrame, by: Sequence[str] | dict[str, Column | str] = (), **values: tuple[str, Column | str]) -> DataFrame:
    """Groups of distinct tuples: aggregate(items, ["l_suppkey"], n=("count", "l_partkey"), q=("sum", "l_linenumber + 3")).

    What is aggregated are the distinct tuples of group and all arguments together,
    neither the input's rows nor each argument's distinct values. sum takes whole
    numbers, avg doubles, the others any type. Without groups an empty input has no
    result row. Spark sums partially before it shuffles, for the distinct step too.
    """
    return _aggregate(df, by, values, DataFrame.distinct)


def aggregate_set(df: DataFrame, by: Sequence[str] | dict[str, Column | str] = (), **values: tuple[str, Column | str]) -> DataFrame:
    """aggregate() of rows that are known to differ in groups and arguments: they are summed where they are, and none is shuffled or kept to be compared."""
    return _aggregate(df, by, values, lambda tuples: tuples)


def _aggregate(df: DataFrame, by: Sequence[str] | dict[str, Column | str], values: dict[str, tuple[str, Column | str]], different: Callable[[DataFrame], DataFrame]) -> DataFrame:
    groups = by if isinstance(by, dict) else {c: F.col(f"`{c}`") for c in by}
    as_column = lambda x: F.expr(x) if isinstance(x, str) else x
    for name, (kind, _) in values.items():
        if kind not in FUNCTIONS:
            raise RuleError(f"{name}: no aggregate {kind!r}")
    tuples = different(df.select(*[as_column(e).alias(n) for n, e in groups.items()], *[as_column(e).alias(f"of {n}") for n, (_, e) in values.items()]))
    for name, (kind, _) in values.items():
        found = tuples.schema[f"of {name}"].dataType
        if kind == "sum" and not isinstance(found, T.LongType):
            raise TypeMismatch(f"{name}: sum of {found.simpleString()}; whole numbers only")
        if kind == "avg" and not isinstance(found, T.DoubleType):
            raise TypeMismatch(f"{name}: avg of {found.simpleString()}; doubles only")
    made = {"avg": F.avg, "count": F.count, "max": F.max, "min": F.min, "sum": F.sum}
    aggs = [made[kind](F.lit(1) if kind == "count" else F.col(f"`of {n}`")).alias(n) for n, (kind, _) in values.items()]
    if groups:
        return tuples.groupBy(*groups).agg(*aggs)
    return tuples.agg(*aggs, F.count(F.lit(1)).alias("of all")).where("`of all` > 0").drop("of all")
