"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are its distinct character n-grams, hashed.  Every feature is
scaled by the log of the ratio of its smoothed document shares in the two classes, and a
logistic regression is fitted on the scaled features (Wang and Manning, 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blobs
from .labelled import crc_rest, rest_is, sample

GRAMS, BITS = (4, 6), 18
#: Documents of each class that the fit uses at most.
PER_CLASS = 2500
#: Bytes of text that are turned into features at a time, and rows at most.
BLOCK, BLOCK_ROWS = 1 << 18, 1 << 12


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BLOCK bytes each; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1
        j = min(n, i + BLOCK_ROWS, max(i + 1, j))
        yield i, j
        i = j


def _grams(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct n-grams of each row, sorted by row; only ``used`` features."""
    raw = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)))[offsets - offsets[0]]
    rows = np.repeat(np.arange(len(starts) - 1, dtype=np.uint32), np.diff(starts))
    points = np.where((points >= 65) & (points <= 90), points + 32, points) * np.uint32(0x9E3779B1)
    keys = []
    for k, n in enumerate(GRAMS):
        m = len(points) - n + 1
        if m < 1:
            continue
        h = points[:m] * np.uint32(0x01000193)
        for i in range(1, n):
            h += points[i : m + i]
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - BITS)
        h |= np.uint32(k << BITS)
        inside = rows[:m] == rows[n - 1 :]
        if used is not None:
            inside &= used[h]
        keys.append((rows[:m][inside] << np.uint32(BITS + 1)) | h[inside])
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint32(BITS + 1)).astype(np.int64), (key & np.uint32((2 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32 by feature
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        used = self.weights != 0
        for i, j in _blocks(offsets):
            row, feature = _grams(data, offsets[i : j + 1], used)
            out[i:j] += np.bincount(row, self.weights[feature], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _counts(batches):
    """(feature, n0, n1): the sample rows of each class that have a feature."""
    import pyarrow as pa

    out = np.zeros((2, len(GRAMS) << BITS), np.int64)
    for batch in batches:
        y = batch.column(0).to_numpy()
        data, offsets = blobs(batch.column(2))
        for i, j in _blocks(offsets):
            row, feature = _grams(data, offsets[i : j + 1])
            for k in (0, 1):
                out[k] += np.bincount(feature[y[i:j][row] == k], minlength=out.shape[1])
    found = np.flatnonzero(out.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(out[0, found]), pa.array(out[1, found])], ["feature", "n0", "n1"])


def _features(given):
    """(y, k, features): the used features of each sample row."""
    import pyarrow as pa

    def run(batches):
        used = given.value != 0
        for batch in batches:
            data, offsets = blobs(batch.column(2))
            out = []
            for i, j in _blocks(offsets):
                row, feature = _grams(data, offsets[i : j + 1], used)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                out += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["y", "k", "features"])

    return run


def fit(classes: np.ndarray, features: list[np.ndarray], ratio: np.ndarray, counts: list[int], steps: int = 150, l2: float = 3e-4) -> Model:
    """Fit on rows of a class and distinct features; ``counts`` are the classes' sizes among all usable labels.

    The rows of a class weigh as much as the class among all labels.  Without rows of
    both classes the score is the share of class 1 (0 without labels).
    """
    size = len(GRAMS) << BITS
    if min(counts) == 0 or not len(classes):
        share = counts[1] / max(1, sum(counts))
        return Model(np.zeros(size, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    y = classes.astype(np.float64)
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    owner = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in features])
    flat = np.concatenate(features)
    x = ratio[flat]
    weight = np.where(y == 1, counts[1] / n[1], counts[0] / n[0])
    weight /= weight.sum()
    w, b = np.zeros(size), float(np.log(counts[1] / counts[0]))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    for _ in range(steps):
        z = np.bincount(owner, x * w[flat], len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(np.bincount(flat, x * g[owner], size) + l2 * w, g.sum())
        t += 1
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        b -= float(step[-1])
    return Model((w * ratio).astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", usable: Column | None = None, per_class: int = PER_CLASS, smooth: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class.

    Null and empty texts have no features.  A repeated id is one label, 1 if any of its
    rows has 1, and lends each of its texts.  Null ids and null labels are not learned.
    Empty tables, or labels of one class only, give a model that tells all texts the same score.
    A feature is used if three of the sample's rows hold it and its log-count ratio is 0.7
    or more either way; features of fewer rows would be learned by heart.
    """
    rows, counts = sample(docs, labels, label, F.lit(True) if usable is None else usable, per_class, id_col, text_col)
    if min(counts) == 0:
        return fit(np.zeros(0, np.int64), [], np.zeros(0), counts)
    rows = Scratch(docs.sparkSession, "toxicity").table(rows)  # 2 * per_class texts
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # the log-count ratios; rare features and those that tell little are not used
    share = lambda c, k: F.log((F.col(c) + smooth) / (n.get(k, 0) + 2 * smooth))
    told = rows.mapInArrow(_counts, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    told = told.where("n0 + n1 >= 3").select("feature", (share("n1", 1) - share("n0", 0)).alias("ratio")).where(F.abs("ratio") >= 0.7).toArrow()
    ratio = np.zeros(len(GRAMS) << BITS)
    ratio[told["feature"].to_numpy()] = told["ratio"].to_numpy()
    given = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # of a fixed size
    found = rows.mapInArrow(_features(given), "y int, k long, features binary").toArrow()  # 2 * per_class rows
    order = np.argsort(found["k"].to_numpy(), kind="stable")
    kept = [np.frombuffer(x.as_buffer(), np.int32) for x in found["features"]]
    return fit(found["y"].to_numpy()[order], [kept[i] for i in order], ratio, counts)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on); input columns of these names give way.

    Whole texts are scored.  Null and empty texts get the score of no features.  Each row
    is scored by itself, so repeated rows get equal scores and rows with a null id theirs;
    a score of just ``threshold`` is predicted 1.  An empty table gives an empty result.
    ``keep`` limits the input columns that come back.
    """
    import pyarrow as pa

    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def scored(batches):
        for batch in batches:
            s = shared.value.score(*blobs(batch.column(batch.num_columns - 1)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return slim.mapInArrow(scored, f"{fields}, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with their input columns; null ids and texts as in ``score_documents``."""
    return score_documents(docs, train(docs, labels, id_col=id_col, text_col=text_col), threshold, id_col, text_col).where("predicted = 0").select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "toxic", crc_rest("doc_id", 4) != 2)
    return score_documents(docs, model, keep=("doc_id",)).select("doc_id", rest_is("doc_id", 4, 2).alias("held_out"), "score", "predicted")
