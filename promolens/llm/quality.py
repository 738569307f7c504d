"""Quality: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by one filter width and cover the
whole text.  Learned filters over embedded bytes are max-pooled in each chunk; the
largest and the mean of the chunks' values go through one logistic unit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs
from .labelled import crc_rest, rest_is, sample

#: Bytes of a chunk, of a filter, between filter positions; embedding size; number of filters.
CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 512, 12, 2, 4, 32
STEP = CHUNK - WIDTH
#: Documents of each class that the fit uses at most; chunks that are convolved at a time.
PER_CLASS, AT_ONCE = 1200, 256


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each chunk in ``data``, its row); every row has one chunk at least."""
    sizes = np.diff(offsets)
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return offsets[:-1][row] + k * STEP, row


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes, with zeros after a text's end."""
    at = starts[:, None] + np.arange(CHUNK)
    out = data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(at < ends[:, None], out, 0).astype(np.uint8)


@dataclass
class Model:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (WIDTH * EMBED, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    top: np.ndarray  # (2 * FILTERS,): of the largest and of the mean over chunks
    bias: float

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED), embedded."""
        x = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(view)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        x = self.windows(chunks)
        y = x.reshape(-1, WIDTH * EMBED) @ self.filters
        return np.maximum(y.reshape(len(chunks), -1, FILTERS).max(1) + self.shift, 0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        starts, row = _chunks(data, offsets)
        most, total, count = np.zeros((n, FILTERS)), np.zeros((n, FILTERS)), np.bincount(row, minlength=n)[:, None]
        for i in range(0, len(row), AT_ONCE):
            r = row[i : i + AT_ONCE]
            h = self.pooled(_cut(data, starts[i : i + AT_ONCE], offsets[1:][r]))
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            most[r[first]] = np.maximum(most[r[first]], np.maximum.reduceat(h, first))
            total[r[first]] += np.add.reduceat(h, first)
        z = np.concatenate((most, total / np.maximum(count, 1)), 1) @ self.top + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[int, str]], counts: list[int], epochs: int = 10, steps: int = 600, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit by gradient descent (Adam) on (class, text) rows; a class weighs as much as among all labels.
    It takes ``epochs`` passes, and ``steps`` steps at least.

    Without rows of both classes the score is the share of class 1 (0 without labels).
    """
    draw = np.random.default_rng(seed)
    f = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    model = Model(f(256, EMBED, scale=0.5), f(WIDTH * EMBED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    share = min(max(counts[1] / max(1, sum(counts)), 1e-9), 1 - 1e-9)
    model.bias = float(np.log(share / (1 - share)))
    if min(counts) == 0 or not rows:
        return model
    model.top = f(2 * FILTERS, scale=0.1)
    y = np.array([r[0] for r in rows], np.float32)
    texts = [np.frombuffer(r[1].encode(), np.uint8) for r in rows]
    per = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, counts[1] / per[1], counts[0] / per[0]).astype(np.float32)
    weight /= weight.mean()
    moments, t = {}, 0

    def adam(name: str, value, grad):
        m, v = moments.get(name, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        moments[name] = m, v
        return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    for _ in range(max(epochs, -(-steps * batch // len(rows)))):
        order = draw.permutation(len(rows))
        for i in range(0, len(rows), batch):
            ids = order[i : i + batch]
            data = np.concatenate([texts[k] for k in ids])
            offsets = np.concatenate(([0], np.cumsum([len(texts[k]) for k in ids])))
            starts, row = _chunks(data, offsets)
            chunks = _cut(data, starts, offsets[1:][row])
            # forward in pieces; of each chunk and filter only the position of the maximum counts
            values, arg = [], []
            for j in range(0, len(chunks), AT_ONCE):
                part = (model.windows(chunks[j : j + AT_ONCE]).reshape(-1, WIDTH * EMBED) @ model.filters).reshape(min(AT_ONCE, len(chunks) - j), -1, FILTERS)
                arg.append(part.argmax(1))
                values.append(np.take_along_axis(part, arg[-1][:, None], 1)[:, 0])
            h, arg = np.maximum(np.concatenate(values) + model.shift, 0), np.concatenate(arg)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            count = np.bincount(row)[:, None]
            most = np.maximum.reduceat(h, first)
            z = np.concatenate((most, np.add.reduceat(h, first) / count), 1)
            p = 1 / (1 + np.exp(-np.clip(z @ model.top + model.bias, -40, 40)))
            g = (weight[ids] * (p - y[ids]) / len(ids)).astype(np.float32)
            # backward
            dz = g[:, None] * model.top
            dh = (dz[:, FILTERS:] / count)[row] + dz[:, :FILTERS][row] * (h == most[row])
            dh = np.where(h > 0, dh, 0).astype(np.float32)
            taps = arg[:, :, None] * STRIDE + np.arange(WIDTH)
            byte = chunks[np.arange(len(chunks))[:, None, None], taps]  # (chunks, FILTERS, WIDTH)
            x = model.embed[byte]
            d_filters = np.einsum("cf,cfwe->wef", dh, x).reshape(WIDTH * EMBED, FILTERS)
            dx = dh[:, :, None, None] * model.filters.reshape(WIDTH, EMBED, FILTERS).transpose(2, 0, 1)
            d_embed = np.zeros_like(model.embed)
            np.add.at(d_embed, byte.reshape(-1), dx.reshape(-1, EMBED))
            t += 1
            model.top, model.bias = adam("top", model.top, z.T @ g + 1e-4 * model.top).astype(np.float32), float(adam("bias", model.bias, g.sum()))
            model.filters = adam("filters", model.filters, d_filters).astype(np.float32)
            model.shift = adam("shift", model.shift, dh.sum(0)).astype(np.float32)
            model.embed = adam("embed", model.embed, d_embed).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled documents of each class.

    Null and empty texts are learned as one chunk of zeros.  A repeated id is one label,
    1 if any of its rows has 1, and lends each of its texts.  Null ids and null labels are
    not learned.  Empty tables, or labels of one class only, give a model that tells all
    texts the same score.
    """
    rows, counts = sample(docs, labels, label, F.lit(True) if usable is None else usable, per_class, id_col, text_col)
    found = rows.collect() if min(counts) else []
    return fit([(r["y"], r["text"]) for r in sorted(found, key=lambda r: (r["k"], r["text"]))], counts)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on); input columns of these names give way.

    Whole texts are scored; null and empty texts are one chunk of zeros.  Each row is
    scored by itself, so repeated rows get equal scores and rows with a null id theirs; a
    score of just ``threshold`` is predicted 1.  An empty table gives an empty result.
    """
    import pyarrow as pa

    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    slim = docs.select(*keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def scored(batches):
        for batch in batches:
            s = shared.value.score(*blobs(batch.column(batch.num_columns - 1)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return slim.mapInArrow(scored, f"{fields}, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, "quality", crc_rest("doc_id", 5) != 0)
    return score_documents(docs, model, keep=("doc_id",)).select("doc_id", rest_is("doc_id", 5, 0).alias("held_out"), "score", "predicted")
