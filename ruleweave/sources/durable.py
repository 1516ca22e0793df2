"""Relations that outlive a session: a folder of Parquet, one folder in it for each batch of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class DurableTable:
    """A set of rows in a folder.

    insert() writes a batch aside and then gives its folder the name under which
    read() finds it, so that a batch is there whole or not at all wherever renaming a
    folder is one step (as in HDFS; in an object store it isn't). It reads nothing:
    rows that are there already are left out by read(), and by compact() for good.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def _named(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Folders of the batches that are there."""
        at, files = self._named("batch-*")
        return sorted(x.getPath().toString() for x in files.globStatus(at) or ())

    def read(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*found).distinct()

    def insert(self, rows: DataFrame) -> None:
        name = uuid.uuid4().hex
        rows.select(*[f.name for f in self.schema]).distinct().write.parquet(f"{self.path}/_new-{name}")
        (new, files), (batch, _) = self._named(f"_new-{name}"), self._named(f"batch-{name}")
        if not files.rename(new, batch):
            raise OSError(f"{batch} could not be put in place")

    def compact(self) -> None:
        """All batches as one. Not while others read or write."""
        old = self.batches()
        if len(old) > 1:
            self.insert(self.read())
            for path in old:
                at, files = self._named(path.rsplit("/", 1)[1])
                files.delete(at, True)
