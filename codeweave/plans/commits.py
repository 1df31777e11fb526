"""A log of paid work: each batch's results become visible by one atomic rename.

A batch is written under _pending, then renamed to batch=<id>; readers see none of it or all. The id names the batch's work, so a
run that repeats a batch finds it. Batches that were written but not renamed when a run ended are taken in by the next one,
before it asks what is left to do; those that were cut off while being written are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def table(self) -> DataFrame:
        """The rows of all batches."""
        if not self._fs.exists(self._path(self.folder)) or not any(f.getPath().getName().startswith("batch=") for f in self._fs.listStatus(self._path(self.folder))):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, batch STRING").parquet(self.folder)
        return rows.drop("batch")

    def recover(self) -> int:
        """Take in what an earlier run has written whole; how many batches. One run at a time may use a log."""
        if not self._there("_pending"):
            return 0
        found = 0
        for f in self._fs.listStatus(self._path(f"{self.folder}/_pending")):
            name = f.getPath().getName()
            if self._there(f"_pending/{name}/_SUCCESS") and not self._there(f"batch={name}"):
                self._publish(name)
                found += 1
            else:
                self._fs.delete(f.getPath(), True)
        return found

    def _publish(self, name: str) -> None:
        if not self._fs.rename(self._path(f"{self.folder}/_pending/{name}"), self._path(f"{self.folder}/batch={name}")):
            raise OSError(f"{self.folder}: batch {name} could not be renamed")
        if not self._there("_SUCCESS"):
            self._fs.create(self._path(f"{self.folder}/_SUCCESS")).close()

    def commit(self, name: str, results: DataFrame) -> bool:
        """Write the results of the batch `name` and make them visible; False, without running them, if it is there already."""
        if self._there(f"batch={name}"):
            return False
        results.write.mode("overwrite").parquet(f"{self.folder}/_pending/{name}")
        self._publish(name)
        return True


def batch_name(work: DataFrame, keys: list[str]) -> str:
    """A name of the batch's work, the same in any order of rows."""
    r = work.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*keys)), F.lit(0)).alias("x"), F.coalesce(F.sum(F.xxhash64(*keys, F.lit(1)).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}{int(r['s']) & (1 << 64) - 1:016x}"
