"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

toxicity rejects documents, line dedup rewrites texts, near-dedup keeps the smallest id
of each group, decontamination rejects documents that leak a benchmark item, and mixing
puts the rest in training order.  All but the last return the columns of documents, also
columns that a stage does not know.  Whole texts of any length are read, an empty table
gives an empty result.  A null id takes no part in the comparisons of the three middle
stages, which keep its rows; the classifier judges them by their text like all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import Scratch
from promolens.llm.decontaminate import drop_leaks
from promolens.llm.line_dedup import dedup_lines
from promolens.llm.mixing import mix_documents
from promolens.llm.near_dedup import drop_near_duplicates
from promolens.llm.toxicity import score_documents, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 by a classifier trained on all labels that the input still holds.

    Null and empty texts score as a text without features; without labels of both classes
    all documents stay.  Repeated rows stay or go together.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of 40 code points or more that five documents share; n_chars follows the text.

    Every row stays, with an empty text if all its lines went; a null text stays null.  A
    line is kept in the largest id that holds it, in all rows of that id.
    """
    kept = dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    The smallest id stays.  Null ids, and null and empty texts, are linked with nothing;
    rows that repeat an id stay or go together.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null ids, and null and empty texts, leak nothing, null and empty items are not leaked;
    all rows of an id go if one of them leaks.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken copies in training order, with epoch, position, size, source_size, target and taken.

    Null and empty texts have no words and are never taken.  A null source is a source of
    its own, and rows that repeat an id or have none are documents of their own.  Ties of
    the position go by id.
    """
    return mix_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
]

#: SQL expresses neither the classifier nor the latent search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
