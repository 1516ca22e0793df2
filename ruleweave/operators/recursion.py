"""Least fixpoints: relations defined in terms of themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RoundLimit, RuleError

#: Rows up to which what a round has found is sent to all executors, so that the rows so far stay where they are.
SENT_ROWS = 100_000
#: Rows so far up to which shuffling them takes less than finding out how many a round has found.
MOVED_ROWS = 2_000_000
#: Values that one row is expanded to at most at once.
SPAN = 1 << 16
#: Values that a task counts, about.
TASK_VALUES = 8 * SPAN
MOST_TASKS = 10_000
MOST_ROUNDS = 10_000
#: Rounds after which the pieces of a relation are put together again, so that plans stay short.
GATHER = 16

Tables = Mapping[str, DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, but only if driver and executors are one machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuleError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ruleweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, where a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    cached = df.persist()  # a checkpoint computes its rows twice otherwise
    try:
        return cached.checkpoint()
    finally:
        cached.unpersist()


def freed(df: DataFrame) -> None:
    """Deletes the files of a DataFrame that stored() gave."""
    context, plan = df.sparkSession.sparkContext, df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.nodeName().startswith("LogicalRDD") or plan.nodeName() == "Scan ExistingRDD" else None
    if file is not None and file.isDefined():
        at = context._jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df computed once, into Parquet files in the shared folder: read by columns, counted by their footers, and of a size that Spark plans by."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.toDF(*[f"_{i}" for i in range(len(df.columns))]).write.parquet(path)
    kinds = T.StructType([T.StructField(f"_{i}", f.dataType, True, f.metadata) for i, f in enumerate(df.schema)])
    return spark.read.schema(kinds).parquet(path).toDF(*df.columns)


def _fresh(found: DataFrame, whole: DataFrame, size: int, few: bool) -> DataFrame:
    """Different rows of found that whole, of `size` rows, doesn't have. If few are expected, they are sent to whole's, if those are many, and whole isn't shuffled."""
    if size > MOVED_ROWS and few:
        found = written(found.distinct())
        if found.count() <= SENT_ROWS:
            names = [f"_{i}" for i in range(len(found.columns))]
            known = whole.toDF(*names).join(F.broadcast(found.toDF(*names)), names, "left_semi")
            return written(found.toDF(*names).join(F.broadcast(known), names, "left_anti").toDF(*found.columns))
    return written(found.subtract(whole))


def fixpoints(bases: Tables, step: Callable[[Tables, Tables], Tables], most_rounds: int = MOST_ROUNDS) -> dict[str, DataFrame]:
    """The least relations that hold their bases and what step derives from them (they may depend on one another).

    step(new, all): what follows from rows of which at least one is new; it gets the
    rows of the last round and all rows so far, by name, and returns rows by name.
    A round works on the new rows only: few of them are sent to the rows so far, if
    those are many; else both are shuffled. Relations without new rows are given as
    empty ones. RoundLimit is raised if rows still come after most_rounds.
    """
    pieces = {n: [written(df.distinct())] for n, df in bases.items()}
    new = {n: p[0] for n, p in pieces.items()}
    more = {n: df.count() for n, df in new.items()}
    sizes = dict(more)
    for _ in range(most_rounds):
        whole = {n: reduce(DataFrame.union, p) for n, p in pieces.items()}
        found = step(new, whole)
        few = sum(more.values()) <= SENT_ROWS
        new = {n: _fresh(found[n].toDF(*df.columns), df, sizes[n], few) if n in found else df.limit(0) for n, df in whole.items()}
        more = {n: df.count() if n in found else 0 for n, df in new.items()}
        new = {n: df if more[n] else df.limit(0) for n, df in new.items()}
        grown = [n for n in more if more[n]]
        if not grown:
            return whole
        for n in grown:
            sizes[n] += more[n]
            pieces[n].append(new[n])
            if len(pieces[n]) > GATHER:
                pieces[n] = [written(reduce(DataFrame.union, pieces[n]))]
    raise RoundLimit(f"still growing after {most_rounds} rounds: {', '.join(grown)}")


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """fixpoints() of one relation: step(new rows, all rows) -> rows."""
    return fixpoints({"": base}, lambda new, whole: {"": step(new[""], whole[""])}, most_rounds)[""]


def closure(edges: DataFrame, most_rounds: int = MOST_ROUNDS, along: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b) reachable over one or more edges (a, b); cycles are fine.

    along: edges have a third column; that of a walk is along(its first part's, its
    second part's), which must be associative. Rows are then (a, b, what comes along).

    A round joins the pairs exactly 1, 2, 4, 8, ... edges apart with all pairs up to
    as far, so that the distance covered doubles, and each distance is made in one way.
    """
    names, extra = edges.columns, [along(F.col("x"), F.col("y"))] if along else []
    ends = lambda *of: of if along else of[:2]
    join = lambda x, y: x.toDF(*ends("start", "middle", "x")).join(y.toDF(*ends("middle", "end", "y")), "middle").select("start", "end", *extra).toDF(*names)
    apart = written(edges.distinct())
    pieces, size = [apart], apart.count()
    more = size
    for round_ in range(most_rounds):
        whole = reduce(DataFrame.union, pieces)
        if round_:
            apart = written(join(apart, apart).distinct())
        new = _fresh(join(apart, whole), whole, size, more <= SENT_ROWS)
        more = new.count()
        if not more:
            return whole
        pieces, size = [*pieces, new], size + more
    raise RoundLimit(f"still growing after {most_rounds} rounds")


def counted(df: DataFrame, column: str, limit: Column | int | str, step: int = 1) -> DataFrame:
    """What the rule "column + step, while column < limit" derives from df, without its rounds, in one pass.

    limit: a number, or a column of df that stays as it is. The last value is the
    first that isn't below the limit (above it, for a negative step).
    """
    if step == 0:
        return df.distinct()
    end = F.col(limit) if isinstance(limit, str) else limit if isinstance(limit, Column) else F.lit(limit)
    at, size = F.col(f"`{column}`"), abs(step)
    room = (end - at if step > 0 else at - end) + size - 1
    rounds = F.greatest(F.lit(0).cast("long"), F.call_function("div", room, F.lit(size).cast("long")))
    # starts of one sequence run into one another: the farthest has all values below the limit, and only last values may repeat
    others, counts = [F.col(f"`{c}`") for c in df.columns if c != column], df.withColumn("rounds left", rounds)
    last = counts.withColumn(column, at + F.col("rounds left") * step).select(*df.columns).distinct()
    first = F.max_by if step < 0 else F.min_by
    whole = counts.where("`rounds left` > 0").groupBy(*others, end.alias("its limit"), F.pmod(at, F.lit(size)).alias("its residue"))
    whole = whole.agg(first("rounds left", at).alias("rounds left"), (F.max if step < 0 else F.min)(at).alias(column))
    # ranges of SPAN values, dealt to tasks by the number of all values
    total = counts.agg(F.sum(F.col("rounds left").cast("double"))).first()[0] or 0
    parts = whole.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("rounds left") - 1, F.lit(SPAN)))))
    parts = parts.repartition(min(MOST_TASKS, int(total // TASK_VALUES) + 1), *others, at, F.col("range"))
    begin = F.col("range") * SPAN
    values = F.sequence(begin, F.least(begin + SPAN, F.col("rounds left")) - 1)
    return parts.withColumn("round", F.explode(values)).withColumn(column, at + F.col("round") * step).select(*df.columns).union(last)


def added_up(spark: SparkSession, start: float, step: float, limit: float, name: str = "x") -> DataFrame:
    """The doubles of "x + step, while x < limit" (step above 0), each by adding to the one before, as rounds would.

    Multiples of the step differ from repeated sums in their last bits, so sums are
    made in order: the driver keeps the one at the end of every SPAN of them, and tasks
    add up the ranges between.
    """
    begins, x = [], float(start)
    while True:
        if x < limit and x + step == x:
            raise RoundLimit(f"{x} + {step} doesn't grow")
        begins.append((x,))
        sums = np.cumsum(np.concatenate(([x], np.full(SPAN, float(step)))))
        if sums[-1] >= limit or sums[-1] == sums[-2]:
            if sums[-1] < limit:
                raise RoundLimit(f"{sums[-1]} + {step} doesn't grow")
            break
        x = float(sums[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                sums = np.cumsum(np.concatenate(([x], np.full(SPAN - 1, float(step)))))
                below = np.concatenate(([True], sums[:-1] < limit))  # a value comes from one below the limit
                yield pa.RecordBatch.from_arrays([pa.array(sums[below])], names=[name])

    return spark.createDataFrame(begins, f"`{name}` double").mapInArrow(run, f"`{name}` double")
