"""Line dedup over levelled sorted runs of line hashes.

The index is a family of runs.  A run is a Parquet table sorted by a 128-bit hash of
the line's key, with the number of documents that hold the key and the largest of
their ids.  Each new batch is merge-anti-joined with the runs: its new keys become a run
of level 0, and its counts of known keys are kept as updates.  When a level has
``fan_out`` runs they are compacted into one run of the next level, so a key is rewritten
O(log n) times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Scratch, ascii_lower, hash128

KEY = ["h1", "h2"]


class LineRuns:
    """Levelled sorted runs (h1, h2, n_docs, last_doc) in the shared folder.

    No key is in two runs.  A document must come in one batch only.  ``add`` takes lines
    (doc, h1, h2); repeated lines of a document count once.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 2):
        self.spark, self.fan_out, self.scratch = spark, fan_out, Scratch(spark, "line-runs")
        self.levels: list[list[tuple[DataFrame, str]]] = []
        self.updates: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines whose key no run holds: a merge-anti-join with each run."""
        for run in self.runs():
            lines = lines.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return lines

    def seen(self, lines: DataFrame) -> DataFrame:
        """The lines whose key some run holds."""
        return lines.join(_union(self.runs()).select(*KEY).hint("merge"), KEY, "left_semi")

    def add(self, lines: DataFrame) -> None:
        """A new run of the batch's new keys, and its counts of known keys as updates."""
        # a count of distinct documents; Spark drops a document's repeats before the shuffle by key
        batch = self.scratch.table(lines.groupBy(*KEY).agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last_doc")))
        new = self.scratch.put(self.unseen(batch).sortWithinPartitions(*KEY))
        if self.runs():
            self.updates.append(self.scratch.table(self.seen(batch)))
        self._push(0, new)

    def _push(self, level: int, run: tuple[DataFrame, str]) -> None:
        """Put a written run on a level; a full level is compacted into one run of the next."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_out:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self.scratch.put(_union([x for x, _ in old]).repartition(*KEY).sortWithinPartitions(*KEY)))
            for _, path in old:
                self.scratch.drop(path)

    def keys(self) -> DataFrame:
        """Every key once, over all runs and updates."""
        return _union(self.runs() + self.updates).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def line_keys(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """(doc, th, pos, h1, h2, batch) of each line whose key has ``min_chars`` code points or more.

    The key is the line without white space at its ends and with A-Z in lower case.
    ``th`` tells apart rows that share an id but not a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.char_length("line") >= min_chars)
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    return trimmed.select("doc", "th", "pos", *hash128(ascii_lower(F.col("line"))), batch.alias("batch"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that ``min_docs`` documents or more share, except in the largest id that holds them.

    Adds n_lines (before dropping), n_dropped and kept_text; input columns of these
    names give way, all others stay.  A null text counts as one empty line.  Rows with
    a null id hold no shared lines and keep their text.  Repeated rows count as one
    document and each gets the same result.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    index = LineRuns(spark)
    # one pass over the texts; the hashes go to the shared folder, dealt into batches by document
    lines = index.scratch.table(line_keys(docs, min_chars, id_col, text_col, batches), ["batch"])
    index.scratch.expect(lines.count(), 100_000)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b))
    shared = index.keys().where(F.col("n_docs") >= min_docs).drop("n_docs")
    drops = (
        lines.join(shared, KEY).where(F.col("doc") < F.col("last_doc"))
        .groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_set("pos").alias("__drop"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__key", F.xxhash64(text)).join(drops, (F.col(id_col) == F.col("__doc")) & (F.col("__key") == F.col("__th")), "left")
    parts = F.split(text, "\n", -1)
    # array_except looks positions up in a hash set, so a long document costs linear time
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__drop")), lambda i: F.get(parts, i))
    out = out.withColumns({
        "n_lines": F.size(parts).cast("long"),
        "n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(kept, "\n")),
    })
    return out.drop("__doc", "__th", "__key", "__drop")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, parts[i] AS line, translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), f AS (
  SELECT k, max(doc_id) AS last_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL AND l.doc_id < f.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL OR l.doc_id >= f.last_doc), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY l.doc_id
"""
