"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about


def crc_rest(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def rest_is(id_col: str, parts: int, rest: int) -> Column:
    """Whether ``crc_rest`` is ``rest``; false for a null id, which no label can name."""
    return F.coalesce(crc_rest(id_col, parts) == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """(y, k, text) of at most ``per_class`` documents of each class, and how many rows of class 0 and 1 there are.

    The sample takes the smallest hashes ``k`` of the id, so reruns agree.  A repeated id
    counts once, as class 1 if any of its labels is 1; null labels and ids don't count.
    """
    found = labels.where(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    found = found.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = [found.where(F.col("y") == y).where(about(per_class, counts.get(y, 0), F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(take[0].unionByName(take[1]))  # 2 * per_class rows of an id and a class
    rows = docs.join(chosen, F.col(id_col) == F.col("__id")).select("y", F.xxhash64("__id").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows, [counts.get(0, 0), counts.get(1, 0)]
