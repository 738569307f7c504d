"""Substring dedup by sliding sentence spans.

A text is cut into sentences that keep their white space, so that they join to the text
again.  Every run of three consecutive sentences, and every run of two long ones, is
hashed; hashes are joined globally, and sentences covered by a repeated run are removed
everywhere but at the run's first place, in order of id and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Scratch, ascii_lower

#: A sentence ends with . ! or ? or at a line feed, and takes the white space after it.
SENTENCE = r"[^.!?\n]++[.!?]*+\s*+|[.!?\s]++"
#: Sentences of a run, and code points that it has at least.
RUNS = ((3, 60), (2, 200))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def spans(docs: DataFrame, runs=RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, pos, k, h1, h2): the runs of k sentences from ``pos`` on, by a 128-bit hash of their trimmed, folded sentences.

    ``th`` tells apart rows that share an id but not a text.
    """
    parts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), sentences(F.col(text_col)).alias("s"))
    key = lambda s: ascii_lower(F.btrim(s, F.lit(WHITE)))
    hashed = parts.select("doc", "th", F.transform("s", lambda s: F.struct(F.xxhash64(key(s)).alias("a"), F.xxhash64(F.lit(7919), key(s)).alias("b"), F.char_length(s).alias("c"))).alias("s"))
    found = []
    for k, least in runs:
        run = lambda i, k=k: F.slice("s", i + 1, k)
        size = lambda i: F.aggregate(run(i), F.lit(0), lambda t, x: t + x["c"])  # noqa: E731,B023
        at = F.when(F.size("s") >= k, F.sequence(F.lit(0), F.size("s") - k)).otherwise(F.array().cast("array<int>"))
        found.append(F.transform(F.filter(at, lambda i: size(i) >= least), lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.xxhash64(run(i)["a"]).alias("h1"), F.xxhash64(F.lit(k), run(i)["b"]).alias("h2"))))  # noqa: B023
    return hashed.select("doc", "th", F.explode(F.concat(*found)).alias("r")).select("doc", "th", "r.pos", "r.k", "r.h1", "r.h2")


def drop_repeated_sentences(docs: DataFrame, runs=RUNS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove sentences that a non-first repeated run covers; the text column holds what is left.

    Adds n_sentences (before) and n_removed; input columns of these names give way.  Null
    texts count as empty.  Rows with a null id keep their text and lend no runs.  Rows
    that repeat an id and its text are one document: the first place of a run is then in
    all of them, and each keeps it.  Other texts of an id are documents of their own.  An empty table gives an empty result.
    """
    # one pass over the texts; both sides of the join read the hashes
    runs_of = Scratch(docs.sparkSession, "spans").table(spans(docs, runs, id_col, text_col))
    place = F.struct("doc", "th", "pos")
    first = runs_of.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    again = runs_of.join(first, ["h1", "h2"]).where(place != F.col("first"))
    covered = again.groupBy(F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_set(F.struct("pos", "k")).alias("__runs"))
    covered = covered.select("__doc", "__th", F.array_distinct(F.flatten(F.transform("__runs", lambda r: F.sequence(r["pos"], r["pos"] + r["k"] - 1)))).alias("__drop"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__key", F.xxhash64(text_col)).join(covered, (F.col(id_col) == F.col("__doc")) & (F.col("__key") == F.col("__th")), "left").withColumn("__parts", sentences(text))
    whole = F.when(F.size("__parts") > 0, F.sequence(F.lit(0), F.size("__parts") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.array_join(F.transform(F.array_except(whole, F.col("__drop")), lambda i: F.get(F.col("__parts"), i)), "")
    out = out.withColumns({
        "n_sentences": F.size("__parts").cast("long"),
        "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
        text_col: F.when(F.col("__drop").isNull(), text).otherwise(kept),
    })
    return out.drop("__doc", "__th", "__key", "__drop", "__parts")


def op6_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_sentences(docs).select("doc_id", "n_sentences", "n_removed", "text")


OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, i - 1 AS pos, p[i] AS piece, translate(trim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*[ \t\n\x0B\f\r]*|[.!? \t\n\x0B\f\r]+') AS p FROM documents))
), r AS (
  SELECT doc_id, pos, 3 AS n, k || chr(0) || lead(k, 1) OVER w || chr(0) || lead(k, 2) OVER w AS h, length(piece) + length(lead(piece, 1) OVER w) + length(lead(piece, 2) OVER w) AS c, 60 AS least FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
  UNION ALL
  SELECT doc_id, pos, 2, k || chr(0) || lead(k, 1) OVER w, length(piece) + length(lead(piece, 1) OVER w), 200 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), q AS (
  SELECT doc_id, pos, n, row_number() OVER (PARTITION BY n, h ORDER BY doc_id, pos) AS place FROM r WHERE h IS NOT NULL AND c >= least
), d AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM q WHERE place > 1
)
SELECT x.doc_id, count(s.pos)::BIGINT AS n_sentences, count(d.pos)::BIGINT AS n_removed, coalesce(string_agg(s.piece, '' ORDER BY s.pos) FILTER (WHERE d.pos IS NULL), '') AS text
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN s ON x.doc_id = s.doc_id LEFT JOIN d ON s.doc_id = d.doc_id AND s.pos = d.pos GROUP BY x.doc_id
"""
