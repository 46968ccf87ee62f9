"""Keyed rows that a stream keeps up to date, of which a batch rewrites only the buckets it touches.

`rows/batch=n/bucket=b` holds a bucket as batch n left it; `current/batch=n` names, for each bucket,
the batch that wrote it last. Batch n reads what `current/batch=n-1` names and writes only under its
own number, so a batch that is repeated after a failure starts from the same rows and replaces
nothing but its own result. What neither of the last two batches names is deleted.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class BucketTable:
    """`schema` lists all columns. A bucket is one task's work: choose `buckets` so that the table divided by it fits."""
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of the keys in `rows`: at most `buckets` numbers reach the driver."""
        return {r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def read(self, spark: SparkSession, batch_id: int, only: set[int] | None = None) -> DataFrame:
        """The rows after a batch (none before batch 0), or those of some buckets."""
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in sorted(self._places(spark, batch_id).items()) if only is None or b in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def latest(self, spark: SparkSession) -> DataFrame:
        """The rows after the last finished batch. Read them before two more batches have passed."""
        fs, folder = _folder(spark, f"{self.path}/current")
        done = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(p.getName().removeprefix("batch=")) for p in done if fs.exists(_child(spark, p, "_SUCCESS"))]
        return self.read(spark, max(numbers, default=-1))

    def write(self, rows: DataFrame, batch_id: int, touched: set[int]) -> None:
        """`rows` are all rows of the touched buckets as this batch leaves them; others stay where they are."""
        spark, here = rows.sparkSession, f"{self.path}/rows/batch={batch_id}"
        (rows.withColumn("bucket", self.bucket()).repartition(max(1, len(touched)), "bucket")
         .write.partitionBy("bucket").mode("overwrite").parquet(here))
        filled = {r.bucket for r in spark.read.schema(f"{self.schema}, bucket int").parquet(here).select("bucket").distinct().collect()}
        before = self._places(spark, batch_id - 1)
        places = {b: n for b, n in before.items() if b not in touched} | dict.fromkeys(filled, batch_id)
        (spark.createDataFrame(list(places.items()), "bucket int, written bigint").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/current/batch={batch_id}"))
        self._prune(spark, batch_id - 2, before)

    def _places(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        if batch_id < 0:
            return {}
        rows = spark.read.schema("bucket int, written bigint").parquet(f"{self.path}/current/batch={batch_id}")
        return {r.bucket: r.written for r in rows.collect()}

    def _prune(self, spark: SparkSession, batch_id: int, kept: dict[int, int]) -> None:
        """Deletes what an old batch names and the one after it (`kept`) does not."""
        fs, named = _folder(spark, f"{self.path}/current/batch={batch_id}")
        if batch_id < 0 or not fs.exists(named):
            return
        for b, n in self._places(spark, batch_id).items():
            if kept.get(b) != n:
                fs.delete(_folder(spark, f"{self.path}/rows/batch={n}/bucket={b}")[1], True)
        fs.delete(named, True)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _child(spark: SparkSession, folder, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder, name)
