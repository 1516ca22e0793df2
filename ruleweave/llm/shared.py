"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each.
BROADCAST_ROWS = 100_000
BATCH_ROWS = 2500
#: Bits by which rows are screened before a shuffle: a table of a million rows at most, 64 bits each.
KEY_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ruleweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that kept() wrote, once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is, for Spark to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _flagged(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df with a last column `likely`: true where the column is in keys, and by chance where its bit is that of another key.

    The bits of all keys, KEY_BITS at most, are broadcast; df is not shuffled.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(KEY_BITS))
    bits = keys.select(bit.alias("bit")).groupBy(F.expr("cast(bit div 64 as int)").alias("bits at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("its bits"))
    df_ = df.withColumn("bit", bit)
    df_ = df_.join(F.broadcast(bits), F.expr("cast(bit div 64 as int)") == F.col("bits at"), "left")
    return df_.select(*df.columns, F.coalesce(F.expr("getbit(`its bits`, cast(bit % 64 as int)) = 1"), F.lit(False)).alias("likely"))


def matching(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in keys: screened by the keys' bits, then hashed, or not shuffled at all if keys are few."""
    few = small(keys)
    return _flagged(df, keys, column).where("likely").drop("likely").join(few if few is not keys else keys.hint("shuffle_hash"), column, "left_semi")


def parted(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may match, rows that don't) of df by a column of keys; neither is shuffled."""
    flagged = _flagged(df, keys, column)
    return flagged.where("likely").drop("likely"), flagged.where("NOT likely").drop("likely")


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python BATCH_ROWS at a time, unless the caller has set a number: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own default
        spark.conf.set(name, str(BATCH_ROWS))


def bare(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so that extra columns can't clash: bare(docs, id="doc_id")."""
    in_small_batches(df.sparkSession)
    return df.select(*[df[old].alias(new) for new, old in columns.items()])
