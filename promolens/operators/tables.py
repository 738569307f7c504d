"""Offers on disk: scopes that are replaced as a whole, counts of a write without a second pass, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import Generations


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows and what Spark counts while they are written: read ``.get`` after the action."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


class ScopedTable:
    """A table whose scopes (a key, or some stores of it) are replaced by runs.

    A run writes its rows, sorted by key, and then the scopes that it replaces; these are
    the commit.  Readers take the rows that no later committed run covers, so they see a
    scope's old rows or its new ones, never both or part of them.  Rows of a run that was
    killed before its commit are never read, and the next run writes over them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "campaign_id", store: str = "store_id"):
        self.spark, self.path, self.key, self.store = spark, path.rstrip("/"), key, store
        self.rows, self.scopes = Generations(spark, f"{self.path}/rows"), Generations(spark, f"{self.path}/scopes")

    def stage(self, batch: DataFrame) -> tuple[int, int]:
        """(run, rows): write the rows of the next run, which nobody reads yet."""
        run = self.scopes.next()
        counted_rows, seen = counted(batch, n=F.count(F.lit(1)))
        counted_rows.repartition(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.rows.path}/gen={run}")
        return run, seen.get["n"]

    def commit(self, run: int, scopes: DataFrame) -> None:
        """Make a staged run the content of its scopes: (key), or (key, store) with null for all of a key."""
        stores = F.col(self.store) if self.store in scopes.columns else F.lit(None).cast("long").alias(self.store)
        scopes.select(self.key, stores).distinct().write.mode("overwrite").parquet(f"{self.scopes.path}/gen={run}")

    def replace(self, batch: DataFrame, scopes: DataFrame) -> tuple[int, DataFrame]:
        """(rows written, empty scopes): replace the scopes that have rows in the batch; the others keep what they have."""
        run, n = self.stage(batch)
        keys = [self.key, *([self.store] if self.store in scopes.columns else [])]
        there = self.spark.read.parquet(f"{self.rows.path}/gen={run}") if n else batch.limit(0)
        full = scopes.join(there.select(self.key).distinct(), self.key, "left_semi")
        if n:
            self.commit(run, full)
        return n, scopes.select(*keys).join(there.select(self.key).distinct(), self.key, "left_anti")

    def read(self) -> DataFrame:
        """The current rows."""
        runs = self.scopes.complete()
        if not runs:
            raise FileNotFoundError(f"no committed run in {self.path}")
        rows = self.rows.read(runs)
        if len(runs) == 1:
            return rows.drop("gen")
        later = self.scopes.read(runs[1:]).select(F.col(self.key).alias("__k"), F.col(self.store).alias("__s"), F.col("gen").alias("__gen"))
        covered = (F.col(self.key) == F.col("__k")) & (F.col("__gen") > F.col("gen")) & (F.col("__s").isNull() | (F.col("__s") == F.col(self.store)))
        return rows.join(later, covered, "left_anti").drop("gen")


def purge_counted(o: DataFrame, d, path: str, grace: int = 14) -> dict[str, int]:
    """Write the offers that did not end more than ``grace`` days before, and count kept and purged ones on the way."""
    from .offers import day

    gone = F.col("valid_to") < F.date_sub(day(d), grace)
    rows, seen = counted(o, kept=F.count_if(~F.coalesce(gone, F.lit(True))), purged=F.count_if(F.coalesce(gone, F.lit(True))))
    rows.where(~gone).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def rejects_counted(df: DataFrame, rules: Sequence[tuple[str, Column]], path: str) -> dict[str, int]:
    """Write good rows and rejects as the folders kind=good and kind=reject of a table, and count both and each reason on the way."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), "good").otherwise("reject"))
    rows, seen = counted(marked, good=F.count_if(F.col("reason").isNull()), **{name: F.count_if(F.coalesce(F.col("reason") == name, F.lit(False))) for name, _ in rules})
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)
    return dict(seen.get)


def cascade_all(tables: dict[str, DataFrame], keys: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows whose parents are gone, through all levels.

    ``keys`` are (child, column, parent, parent's column); a null column has no parent and
    stays.  Children are cleaned after all of their parents; a cycle raises a ValueError.
    """
    out, left = dict(tables), list(keys)
    while left:
        ready = [t for t in {k[0] for k in left} if not any(k[2] in {x[0] for x in left} for k in left if k[0] == t)]
        if not ready:
            raise ValueError("the keys form a cycle")
        for child in sorted(ready):
            for _, column, parent, parent_column in [k for k in left if k[0] == child]:
                alive = out[parent].select(F.col(parent_column).alias("__p")).distinct()
                kept = out[child].join(alive, F.col(column) == F.col("__p"), "left_semi")
                out[child] = kept.unionByName(out[child].where(F.col(column).isNull()))
            left = [k for k in left if k[0] != child]
    return out
