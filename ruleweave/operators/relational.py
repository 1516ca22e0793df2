"""Operators on sets of rows. Every result is a set; no operator keeps repeats."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TypeMismatch, Unconnected, WrongArity

#: Rows up to which one side of a product is sent to all executors.
PRODUCT_ROWS = 100_000
#: Pairs that a task compares, about, where rows that agree on their keys are compared by more.
TASK_PAIRS = 20_000_000
#: Rows of one key that are compared at once with as many of the other side.
BLOCK_ROWS = 4096
MOST_TASKS = 10_000


def derive(df: DataFrame, *names: str, **exprs: Column | str) -> DataFrame:
    """Columns by name and by expression, as a set: derive(orders, "o_custkey", year="o_orderdate div 1000")."""
    return df.select(*names, *[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in exprs.items()]).distinct()


def renamed(df: DataFrame, *names: str) -> DataFrame:
    """df with all columns named anew, by position; "_" leaves a column out. Names that stand twice must be equal."""
    if len(names) != len(df.columns):
        raise WrongArity(f"{len(names)} names for {len(df.columns)} columns")
    df = df.toDF(*[f"_{i}" for i in range(len(names))])
    for i, name in enumerate(names):
        if name != "_" and names.index(name) < i:
            df = df.where(F.col(f"_{names.index(name)}") == F.col(f"_{i}"))
    return df.select(*[F.col(f"_{names.index(n)}").alias(n) for n in dict.fromkeys(names) if n != "_"])


def meet(left: DataFrame, right: DataFrame, *where: Column | str) -> DataFrame:
    """Rows that agree on all shared columns and meet the conditions (equal, range, any comparison).

    Without anything that Spark can hash or sort by, it compares all pairs; then one side must not exceed PRODUCT_ROWS.
    """
    keys = [c for c in left.columns if c in right.columns]
    conditions = [F.expr(c) if isinstance(c, str) else c for c in where]
    if not keys and not conditions:
        raise Unconnected("no shared column and no condition; see product()")
    if not keys:
        made = left.join(right, reduce(Column.__and__, conditions))
        plan = made._jdf.queryExecution().sparkPlan().toString()
        if ("NestedLoop" in plan or "Cartesian" in plan) and all(side.limit(PRODUCT_ROWS + 1).count() > PRODUCT_ROWS for side in (right, left)):
            raise Unconnected(f"no equal columns, and both sides have more than {PRODUCT_ROWS} rows; see within()")
        return made
    return reduce(DataFrame.where, conditions, _compared(left, right, keys) if conditions else left.join(right, keys))


def _compared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on keys, for conditions that are then put to all its pairs; dealt out by the number of pairs.

    Few keys with many rows each have few bytes and very many pairs, which Spark would
    leave to a few tasks. A key's rows are dealt into blocks of about BLOCK_ROWS, and
    each block of one side meets each of the other in a task of its own choice.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    sizes = count(left, "left rows").join(count(right, "right rows"), keys)
    groups, pairs = sizes.agg(F.count(F.lit(1)), F.sum(F.col("left rows").cast("double") * F.col("right rows"))).first()
    if (pairs or 0) <= TASK_PAIRS:
        return left.join(right, keys)
    blocks = lambda name: F.ceil(F.col(f"{name} rows") / BLOCK_ROWS).alias(f"{name} blocks")
    sizes = sizes.select(*keys, blocks("left"), blocks("right"))
    sizes = F.broadcast(sizes) if groups <= PRODUCT_ROWS else sizes
    at = ["left block", "right block"]

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(f"{own} blocks"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other} blocks") - 1))
        df = df.join(sizes, keys).select(*df.columns, mine.alias(f"{own} block"), every.alias(f"{other} block"))
        return df.repartition(min(MOST_TASKS, int(pairs // TASK_PAIRS) + 1), *keys, *at)

    return dealt(left, "left", "right").hint("merge").join(dealt(right, "right", "left"), [*keys, *at]).drop(*at)


def matched(left: DataFrame, right: DataFrame, a: str, b: str, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Different pairs of left's a and right's b in join(left, right), an inner join with any conditions.

    A value that stands in one different row of its side makes no pair twice; only pairs
    of a value that stands in several are compared with one another.
    """

    def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        df = df.distinct().withColumn("its rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
        return df.where("`its rows` = 1").drop("its rows"), df.where("`its rows` > 1").drop("its rows")

    (left, lefts), (right, rights) = split(left, a), split(right, b)
    pairs, again = join(left, right).select(a, b), []
    if not lefts.isEmpty():
        again += [join(lefts, right), join(lefts, rights)]
    if not rights.isEmpty():
        again.append(join(left, rights))
    return pairs.union(reduce(DataFrame.union, [x.select(a, b) for x in again]).distinct()) if again else pairs


def within(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows that agree on all shared columns, where right's value is from left's low to left's high.

    The range join goes by buckets of `width`: a row of left is sent to all buckets it
    reaches (few, if width is about the usual high - low), a row of right to its own.
    """
    keys = [c for c in left.columns if c in right.columns]
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    reach = left.where(F.col(low) <= F.col(high)).withColumn("its bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    made = _compared(reach, right.withColumn("its bucket", bucket(value)), [*keys, "its bucket"]).drop("its bucket")
    return made.where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high)))


def product(left: DataFrame, right: DataFrame, most: int = PRODUCT_ROWS) -> DataFrame:
    """All pairs; right is sent to all executors and must not exceed `most` rows."""
    if right.limit(most + 1).count() > most:
        raise Unconnected(f"a product with more than {most} rows")
    return left.crossJoin(F.broadcast(right))


def having(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that agree with some row of right on the shared columns."""
    return left.join(right, [c for c in left.columns if c in right.columns], "left_semi")


def unless(left: DataFrame, right: DataFrame, *where: Column | str) -> DataFrame:
    """Rows of left that no row of right matches: on all shared columns, and on conditions, which may use columns of either.

    Without shared columns and conditions: all of left if right is empty, else nothing.
    """
    keys = [c for c in left.columns if c in right.columns]
    other = right.toDF(*[f"{c} of right" if c in keys else c for c in right.columns])
    conditions = [F.col(f"`{c}`") == F.col(f"`{c} of right`") for c in keys] + [F.expr(c) if isinstance(c, str) else c for c in where]
    return left.join(other, reduce(Column.__and__, conditions, F.lit(True)), "left_anti")


def _aligned(first: DataFrame, *rest: DataFrame) -> list[DataFrame]:
    kinds = [f.dataType for f in first.schema]
    for df in rest:
        if len(df.columns) != len(kinds):
            raise WrongArity(f"{len(df.columns)} columns, {len(kinds)} expected")
        if [f.dataType for f in df.schema] != kinds:
            raise TypeMismatch(f"{df.schema.simpleString()} is no {first.schema.simpleString()}")
    return [first, *(df.toDF(*first.columns) for df in rest)]


def either(*relations: DataFrame) -> DataFrame:
    """Rows of any, by position."""
    return reduce(DataFrame.union, _aligned(*relations)).distinct()


def both(*relations: DataFrame) -> DataFrame:
    """Rows of all, by position."""
    return reduce(DataFrame.intersect, _aligned(*relations))


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that aren't in right, by position."""
    return reduce(DataFrame.subtract, _aligned(left, right))
