"""Relations from Parquet tables, from constants, and from a clock."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NullValue, RuleError, TypeMismatch, WrongArity

#: The five types of relation columns, as Spark has them; a char is a string of one character.
TYPES: dict[str, T.DataType] = {"bool": T.BooleanType(), "char": T.StringType(), "int": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
PYTHON = {"bool": bool, "char": str, "int": int, "double": float, "string": str}


def schema(columns: dict[str, str]) -> T.StructType:
    """{"name": "type"} -> a schema without nulls; the type's name is kept as metadata."""
    for name, kind in columns.items():
        if kind not in TYPES:
            raise TypeMismatch(f"column {name}: no type {kind!r}")
    return T.StructType([T.StructField(n, TYPES[k], False, {"type": k}) for n, k in columns.items()])


def facts(spark: SparkSession, columns: dict[str, str], rows: Iterable[Sequence]) -> DataFrame:
    """Constants as a relation: strictly typed, without repeats."""
    rows, kinds = [tuple(r) for r in rows], list(columns.values())
    made = schema(columns)
    for row in rows:
        if len(row) != len(kinds):
            raise WrongArity(f"{row}: {len(kinds)} columns expected")
        for value, kind in zip(row, kinds, strict=True):
            if value is None:
                raise NullValue(f"{row}: null")
            if type(value) is not PYTHON[kind] or kind == "char" and len(value.encode()) != 1:
                raise TypeMismatch(f"{row}: {value!r} is no {kind}")
            if kind == "int" and not -(1 << 63) <= value < 1 << 63:
                raise TypeMismatch(f"{row}: {value} has more than 64 bits")
    return spark.createDataFrame(rows, made).distinct()


def relation(df: DataFrame, columns: Sequence[str] | None = None, check: bool = False) -> DataFrame:
    """df as a relation: whole numbers as long, timestamps as microseconds since 1970 (UTC), decimals and floats as double.

    columns: the ones to keep, before anything else, so that a scan reads no more.
    check: fails if a row holds a null, with one scan of the table.
    """
    df = df.select(*columns) if columns is not None else df
    out = []
    for f in df.schema:
        kind, col = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            col = col.cast("long")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            col = col.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.unix_micros(col.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            col = F.unix_micros(col.cast("timestamp"))
        elif not isinstance(kind, (T.StringType, T.BooleanType)):
            raise TypeMismatch(f"column {f.name}: relations have no {kind.simpleString()}")
        out.append(col.alias(f.name))
    df = df.select(*out)
    if check:
        bad = df.where(" OR ".join(f"`{c}` IS NULL" for c in df.columns))
        if not bad.isEmpty():
            raise NullValue("a row holds a null")
    return df


def load(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table as a relation."""
    return relation(spark.read.parquet(f"{folder}/{name}.parquet"), columns)


def ticks(spark: SparkSession, period_ms: int, start_us: int, end_us: int) -> DataFrame:
    """A timer on a virtual clock: (deadline) in microseconds, every period after the start, up to and including the end."""
    if not 0 < period_ms <= ((1 << 63) - 1) // 1000:
        raise RuleError(f"a period of {period_ms} ms")
    n = max(0, (end_us - start_us) // (period_ms * 1000))
    return spark.range(1, n + 1).select((F.col("id") * (period_ms * 1000) + start_us).alias("deadline"))
