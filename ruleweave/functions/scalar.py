"""Scalar expressions of rules, where Spark's plain operator means something else, and how values are printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def quotient(a: Column | str, b: Column | str | int) -> Column:
    """Whole-number division towards zero (Spark's / gives a double); a zero divisor is an error."""
    return F.call_function("div", _column(a), _column(b))


def remainder(a: Column | str, b: Column | str | int) -> Column:
    """The rest of quotient(), with the dividend's sign; a zero divisor is an error."""
    return _column(a) % _column(b)


def joined(*parts: Column | str) -> Column:
    """Strings end to end."""
    return F.concat(*[_column(p) for p in parts])


def printed(df: DataFrame) -> DataFrame:
    """(line): a relation's rows as text, values joined by commas without quotes, doubles with six decimals."""
    texts = []
    for f in df.schema:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        texts.append(F.format_string("%.6f", col) if kind == "double" else col.cast("string"))
    return df.select(F.concat_ws(",", *texts).alias("line"))
