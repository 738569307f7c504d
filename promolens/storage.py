"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """A folder of one run in the shared folder, for tables that cut lineage.

    The tables outlive a lost executor, and a rerun starts a folder of its own.
    Files go when the caller calls ``drop``; a query whose result is lazy leaves
    them to the owner of the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.most: int | None = None

    def expect(self, rows: int, each: int = 10_000) -> None:
        """Write tables of about ``rows`` rows from here on: one file a core or one for ``each`` rows, whichever is more."""
        self.most = max(self.spark.sparkContext.defaultParallelism, -(-rows // each))

    def put(self, df: DataFrame, partition_by: list[str] | None = None) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.path}/{self.n}"
        if self.most and not partition_by:
            df = df.coalesce(self.most)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        return self.put(df, partition_by)[0]

    def drop(self, path: str | None = None) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Generations:
    """Tables ``path``/gen=0, gen=1, ... that are written one after the other; only complete ones count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def complete(self) -> list[int]:
        """The generations whose write has ended, in order."""
        at, files = self._folder(self.path)
        if not files.exists(at):
            return []
        names = [x.getPath().getName() for x in files.listStatus(at)]
        numbers = sorted(int(x[4:]) for x in names if x.startswith("gen=") and x[4:].isdigit())
        return [g for g in numbers if files.exists(self._folder(f"{self.path}/gen={g}/_SUCCESS")[0])]

    def next(self) -> int:
        there = self.complete()
        return there[-1] + 1 if there else 0

    def read(self, generations: list[int], schema: str | None = None) -> DataFrame:
        """Their rows with the column gen; with a schema, columns that are not there are null."""
        reader = self.spark.read.schema(f"{schema}, gen int") if schema else self.spark.read
        return reader.option("basePath", self.path).parquet(*[f"{self.path}/gen={g}" for g in generations])
