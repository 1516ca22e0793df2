"""Relations with a location column: which rows are here, and which go elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadLocation

_FORM = re.compile(r"tcp:[^:\s]+:\d{1,5}")


def location(host: str, port: int) -> str:
    made = f"tcp:{host}:{port}"
    if not _FORM.fullmatch(made) or not 0 <= port < 1 << 16:
        raise BadLocation(made)
    return made


def local(df: DataFrame, column: str, here: str) -> DataFrame:
    """Rows that stay on this node."""
    if not _FORM.fullmatch(here):
        raise BadLocation(here)
    return df.where(F.col(column) == here)


def outbox(df: DataFrame, column: str, here: str) -> DataFrame:
    """Rows for other nodes; compared as strings, as they stand."""
    if not _FORM.fullmatch(here):
        raise BadLocation(here)
    return df.where(F.col(column) != here)

