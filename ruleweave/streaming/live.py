"""Rule books fed by streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import RuleError
from ..plans.rules import RuleBook


def feed(stream: DataFrame, book: RuleBook, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Puts a stream's rows into a table of the book, batch by batch; each batch ends with refreshed results and callbacks.

    The table must be durable: what a stream has given once it doesn't give again after
    a restart. A repeated batch changes nothing, as tables are sets.
    trigger: as for DataStreamWriter.trigger, for example availableNow=True.
    """

    if table not in book.durable:
        raise RuleError(f"{table} isn't durable: its rows would be lost with the session, and the stream goes on behind them")

    def batch(rows: DataFrame, _: int) -> None:
        book.load(table, rows)
        book.refresh()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def live_timer(spark: SparkSession, period_ms: int) -> DataFrame:
    """A stream (deadline) with a row, in microseconds since 1970, each time the wall clock passes a multiple of the period.

    The clock ticks once a second or faster: of a tick's times, those are deadlines
    that are the first of their period. Deadlines come once each, also if a batch
    holds several; none is from before the stream's start.
    """
    if not 0 < period_ms <= ((1 << 63) - 1) // 1000:
        raise RuleError(f"a period of {period_ms} ms")
    rate = max(1, -(-1000 // period_ms))  # a second's ticks, at least as many as periods
    begin = time.time_ns() // 1000
    source = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    period = F.lit(period_ms * 1000)
    deadline = F.unix_micros("timestamp") - F.pmod(F.unix_micros("timestamp"), period)
    ticks = source.select(deadline.alias("deadline"), F.timestamp_micros(deadline).alias("at")).where(F.col("deadline") >= begin)
    late = f"{max(1, 2 * period_ms // 1000)} seconds"
    return ticks.withWatermark("at", late).dropDuplicatesWithinWatermark(["deadline"]).select("deadline")
