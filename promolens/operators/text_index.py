"""Stored inverted indexes over names: stems for word search, trigrams for similarity and substrings.

An index is a folder of postings (key, id, ...), clustered by key: a key's bucket is a
partition and rows are sorted by key inside it, so a lookup reads the row groups of its
own keys.  A refresh writes one more generation with the postings of the touched ids alone
and the list of these ids; older postings of a touched id no longer count.  ``compact``
writes the live postings as a new version.  A generation counts once its list of ids is
complete, so a broken write is never seen, and the next refresh takes its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import stem_list, stems, trigrams
from ..storage import Generations


class PostingIndex:
    """Postings in generations; subclasses make them from texts."""

    #: Parts of a bucket that tasks of their own sort and write, so that a frequent key is no single task.
    parts = 16

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---- files

    def _ids(self, version: int) -> Generations:
        return Generations(self.spark, f"{self.path}/v{version}/ids")

    def _version(self) -> int:
        """The newest version whose first generation is complete; 0 without any."""
        version = 0
        while self._ids(version + 1).complete():
            version += 1
        return version

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, version: int, generation: int, rows: DataFrame, ids: DataFrame) -> None:
        top = f"{self.path}/v{version}"
        laid = rows.withColumn("bucket", self._bucket(F.col("key"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(self.parts))).sortWithinPartitions("bucket", "key", "id")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{top}/postings/gen={generation}")
        ids.write.mode("overwrite").parquet(f"{top}/ids/gen={generation}")  # last: it makes the generation count

    # ---- content

    def _postings(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError

    def refresh(self, docs: DataFrame, id_col: str = "id", text_col: str = "name") -> None:
        """Index these documents: the first time all, later those that changed.

        A document that is there already loses its old postings; a null or empty text has
        none.  Of repeated ids all texts count.  Where many rows share a text, index the distinct
        texts with the text as id, and join the rows by it: postings then grow with the texts alone.
        """
        version = self._version()
        slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        self._write(version, self._ids(version).next(), self._postings(slim), slim.select("id").distinct())

    def rows(self, keys: list[str] | None = None) -> DataFrame:
        """The live postings of some keys (None: of all)."""
        version = self._version()
        there = self._ids(version).complete()
        if not there:
            raise FileNotFoundError(f"no index in {self.path}")
        found = Generations(self.spark, f"{self.path}/v{version}/postings").read(there)
        if keys is not None:
            # the hash that chose the bucket folds to constants, and these prune partitions
            places = self.spark.createDataFrame([(k,) for k in keys], "key string").select(self._bucket(F.col("key")).alias("b")).distinct().collect() if keys else []
            found = found.where(F.col("bucket").isin([r["b"] for r in places]) & F.col("key").isin(keys))
        if len(there) > 1:
            later = self._ids(version).read(there[1:]).select(F.col("id").alias("__id"), F.col("gen").alias("__gen"))
            found = found.join(later, (F.col("id") == F.col("__id")) & (F.col("__gen") > F.col("gen")), "left_anti")
        return found.drop("gen", "bucket")

    def compact(self) -> None:
        """Write the live postings as one generation of a new version."""
        version = self._version()
        ids = self._ids(version).read(self._ids(version).complete()).select("id").distinct()
        self._write(version + 1, 0, self.rows(), ids)

    def _one(self, column, text: str):
        """The value of an expression over one text."""
        return self.spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


class TextIndex(PostingIndex):
    """Postings of stems: (key, id, tf, length), the length in distinct stems; a repeated id has them for each of its rows."""

    def _postings(self, docs: DataFrame) -> DataFrame:
        # counted inside each row: no postings are grouped
        counted = docs.select("id", stem_list(F.col("text")).alias("all")).withColumn("each", F.array_distinct("all"))
        tf = F.transform("each", lambda s: F.struct(s.alias("key"), F.size(F.filter("all", lambda x: x == s)).alias("tf")))
        return counted.select("id", F.size("each").alias("length"), F.explode(tf).alias("p")).select("p.key", "id", "p.tf", "length")

    def match(self, query: str) -> DataFrame:
        """(id, rank, tf) of the texts that hold every stem of the query; the rank is matched stems over the text's.

        Words of one character do not count; a query without stems matches nothing.
        """
        words = " ".join(w for w in query.split() if len(w) >= 2)
        keys = self._one(stems(F.col("text")), words)
        found = self.rows(keys).groupBy("id", "length").agg(F.count_distinct("key").alias("n"), F.sum("tf").alias("tf"))
        return found.where(F.col("n") == len(keys)).where(F.lit(bool(keys))).select("id", (F.col("n") / F.col("length")).alias("rank"), "tf")


class TrigramIndex(PostingIndex):
    """Postings of trigrams: (key, id, n), with the number of the text's trigrams; a repeated id has them for each of its rows."""

    def _postings(self, docs: DataFrame) -> DataFrame:
        sets = docs.select("id", trigrams(F.col("text")).alias("g"))
        return sets.select("id", F.size("g").alias("n"), F.explode("g").alias("key")).select("key", "id", "n")

    def _rarest_first(self, keys: list[str]) -> list[str]:
        n = {r["key"]: r["count"] for r in self.rows(keys).groupBy("key").count().collect()}  # a row a trigram of the query
        return sorted(keys, key=lambda k: (n.get(k, 0), k))

    def similar(self, query: str, t: float) -> DataFrame:
        """(id, similarity) of the texts with a similarity above ``t`` to the query.

        Such a text has t to 1/t times as many trigrams and shares one of the query's
        rarest, as many as leave less than the needed ones; only those candidates are counted.
        """
        keys = self._rarest_first(self._one(trigrams(F.col("text")), query))
        m = len(keys)
        near = F.col("n").between(m * t, m / t)
        # t * m trigrams at least are shared, so one of the first m - ceil(t * m) + 1 is
        front = keys[: m - int(-(-m * t // 1)) + 1] if m else []
        some = self.rows(front).where(near).select("id").distinct()
        both = self.rows(keys).where(near).join(some, "id", "left_semi").groupBy("id", "n").agg(F.count_distinct("key").alias("both"))
        return both.withColumn("similarity", F.col("both") / (F.col("n") + m - F.col("both"))).where(F.col("similarity") > t).select("id", "similarity")

    def holding(self, query: str, whole_words: bool = False) -> DataFrame | None:
        """(id) of the texts that may hold the query as a substring; the caller compares them with it.

        None if the query has no trigram that every such text has (two characters, or less
        inside a word): then nothing narrows the search.
        """
        keys = self._one(trigrams(F.col("text")), query)
        if not whole_words:
            words = self._one(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), query)
            sure = set()
            for i, w in enumerate(words):
                # a word at an end of the query may go on in the text
                padded = ("  " if i else "") + w + (" " if i < len(words) - 1 else "")
                sure.update(padded[j : j + 3] for j in range(len(padded) - 2))
            keys = [k for k in keys if k in sure]
        return self.rows(self._rarest_first(keys)[:1]).select("id").distinct() if keys else None
