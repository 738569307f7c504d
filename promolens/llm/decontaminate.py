"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words.  TF-IDF vectors of all passages over hashed
terms go through a distributed randomised SVD (Halko, Martinsson and Tropp, 2011): each
task sketches its passages, the sketches are summed by term, and the whitened right
singular vectors give every term a place in the latent space.  Windows about as long as
a benchmark item slide over each document; those whose cosine to the item is high are
candidates.  A candidate is a leak if the longest common subsequence of words covers
enough of the item and enough of the item's rarest words, its answer, occur in it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blobs, blocks, whole_ids, words

TERMS, RANK, OVER = 1 << 13, 40, 4
#: Words of a passage of the SVD; words that are handled at a time.
PASSAGE, BLOCK = 64, 1 << 15
#: Window lengths are multiples of GRID words; a window starts every quarter of its length, at a multiple of four words.
GRID = 16
#: Items, and bytes of their coded words, that are searched in one pass over the documents.
ITEMS, ITEM_BYTES = 50_000, 1 << 24


def _encode(batches):
    """(doc, words as 32-bit hashes)."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = blobs(batch.column(1))
        for i, j in blocks(offsets, 1 << 19):
            raw = data[offsets[i] : offsets[j]]
            cut = offsets[i : j + 1] - offsets[i]
            spaced = np.full(len(raw) + (j - i), 32, np.uint8)
            spaced[np.arange(len(raw)) + np.repeat(np.arange(j - i), np.diff(cut))] = raw
            start, h = words(spaced)
            first = np.searchsorted(start, cut + np.arange(j - i + 1))
            short = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["doc", "words"])


def _rows(batches):
    for batch in batches:
        data, offsets = blobs(batch.column(1))
        yield batch.column(0), data.view(np.uint8), offsets


def _documents(batches, times: int = 1):
    """Groups of about BLOCK (times some) words: (words of all, cuts between documents)."""
    for _, data, offsets in _rows(batches):
        for i, j in blocks(offsets, 4 * BLOCK * times):
            yield np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint32), (offsets[i : j + 1] - offsets[i]) // 4


def _df(batches):
    import pyarrow as pa

    out = np.zeros(TERMS, np.int64)
    n = 0
    for w, cuts in _documents(batches):
        owner = np.repeat(np.arange(len(cuts) - 1, dtype=np.uint32), np.diff(cuts))
        key = np.sort(owner * np.uint32(TERMS) + w % np.uint32(TERMS))  # at most 4096 documents
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        out += np.bincount(key % np.uint32(TERMS), minlength=TERMS)
        n += len(cuts) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS, dtype=np.int32)), pa.array(np.concatenate(([n], out)))], ["term", "n"])


def _passages(w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of passages of PASSAGE words, none across two documents."""
    return np.concatenate([np.arange(a, b, PASSAGE) for a, b in zip(cuts[:-1], cuts[1:]) if b > a] or [np.zeros(0, np.int64)]).astype(np.int64)


def _project(term: np.ndarray, starts: np.ndarray, idf: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products of a basis with the passages' unit TF-IDF vectors, 1 / length of each passage's vector).

    ``columns`` is the basis, one vector a row, times idf; lengths are divided out per
    passage.  One vector of the basis at a time stays in the cache.
    """
    scale = (1 / np.maximum(np.sqrt(np.add.reduceat(idf[term].astype(np.float64) ** 2, starts)), 1e-9)).astype(np.float32)
    out = np.empty((len(columns), len(starts)), np.float32)
    for c, column in enumerate(columns):
        np.add.reduceat(column[term], starts, out=out[c])
    return out * scale, scale


def _sums(name: str, matrix: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in matrix.T)], [name, *(f"y{i}" for i in range(matrix.shape[1]))])


def _summed(parts: DataFrame, name: str, width: int, rows: int) -> np.ndarray:
    """The sum over tasks of a matrix with ``rows`` rows, a fixed number."""
    total = parts.groupBy(name).agg(*[F.sum(f"y{i}").alias(f"y{i}") for i in range(width)]).toArrow()
    out = np.zeros((rows, width))
    if total.num_rows:
        out[total[name].to_numpy()] = np.stack([total[f"y{i}"].to_numpy() for i in range(width)], 1)
    return out


def latent_terms(coded: DataFrame, rank: int = RANK, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(idf of each term, whitened latent vector of each term) from all documents."""
    counts = {r["term"]: r["n"] for r in coded.mapInArrow(_df, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = counts.get(-1, 0)
    idf = np.array([np.log((n + 1) / (counts.get(t, 0) + 1)) for t in range(TERMS)], np.float32)
    width = rank + OVER
    omega = np.random.default_rng(seed).normal(size=(TERMS, width)).astype(np.float32)
    context = coded.sparkSession.sparkContext
    given = context.broadcast((idf, omega))  # of a fixed size
    cols = ", ".join(f"y{i} double" for i in range(width))

    def sketch(batches):
        idf, omega = given.value
        columns = np.ascontiguousarray((omega * idf[:, None]).T)
        out = np.zeros((width, TERMS))
        for w, cuts in _documents(batches, 4):
            if not len(w):
                continue
            starts, term = _passages(w, cuts), (w % TERMS).astype(np.int64)
            z, scale = _project(term, starts, idf, columns)
            z *= scale
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w))))
            for c in range(width):
                out[c] += np.bincount(term, z[c][passage], TERMS)
        yield _sums("term", out.T * idf[:, None])

    y = _summed(coded.mapInArrow(sketch, f"term int, {cols}"), "term", width, TERMS)
    q, _ = np.linalg.qr(y)
    shared = context.broadcast(q.astype(np.float32))

    def gram(batches):
        idf = given.value[0]
        columns = np.ascontiguousarray((shared.value * idf[:, None]).T)
        out = np.zeros((width, width))
        for w, cuts in _documents(batches, 4):
            if len(w):
                b, _ = _project((w % TERMS).astype(np.int64), _passages(w, cuts), idf, columns)
                out += b @ b.T
        yield _sums("i", out)

    values, vectors = np.linalg.eigh(_summed(coded.mapInArrow(gram, f"i int, {cols}"), "i", width, width))
    best = np.argsort(-values)[:rank]
    scale = np.sqrt(np.maximum(values[best] / max(1, n), 1e-12))
    keep = values[best] > 1e-9 * max(values.max(), 1e-30)
    return idf, (idf[:, None] * (q @ vectors[:, best[keep]]) / scale[keep]).astype(np.float32)


def lcs(masks: dict[int, int], size: int, text) -> int:
    """Length of the longest common subsequence of an item, given by its words' bit masks, and ``text``."""
    full = (1 << size) - 1
    v = full
    for w in text:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Items:
    """Benchmark items by window length, with latent directions and bit masks of their words."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], idf: np.ndarray, latent: np.ndarray, answer: int = 8):
        self.by_length: dict[int, tuple] = {}
        self.ids, self.sizes, self.masks, self.answers = ids, [len(t) for t in texts], [], []
        groups: dict[int, list[int]] = {}
        vectors, counts = [], []
        for k, t in enumerate(texts):
            masks: dict[int, int] = {}
            for i, w in enumerate(t.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
            self.masks.append(masks)
            rare = sorted(masks, key=lambda w: (-float(idf[w % TERMS]), w))[:answer]
            self.answers.append(rare + [-2] * (answer - len(rare)))
            counts.append(max(1, len(rare)))
            v = latent[t % TERMS].sum(0) if len(t) else np.zeros(latent.shape[1], np.float32)
            vectors.append(v / max(float(np.linalg.norm(v)), 1e-9))
            if len(t):
                groups.setdefault(-(-len(t) // GRID) * GRID, []).append(k)
        self.answers, self.n_answers = np.array(self.answers, np.int64).reshape(-1, answer), np.array(counts)
        for length, ks in groups.items():
            rare = np.unique(self.answers[ks])
            rare = rare[rare >= 0].astype(np.uint32)
            # the place of each answer word in the group's list; the place after the last one stands for none
            places = np.where(self.answers[ks] < 0, len(rare), np.searchsorted(rare, self.answers[ks].clip(0)))
            maybe = np.zeros(1 << 16, bool)
            maybe[rare & 0xFFFF] = True
            self.by_length[length] = np.array(ks), np.stack([vectors[k] for k in ks]).astype(np.float32), rare, places, maybe


def _search(given, cosine: float, share: float, answers: float):
    """(doc, item, cosine, lcs_share, answer_share) of each document's leaks, the best window of an item."""
    import pyarrow as pa

    def run(batches):
        items, latent = given.value
        longest = 2 * max(items.by_length, default=GRID)
        for docs, data, offsets in _rows(batches):
            best: dict[tuple[int, int], tuple] = {}
            for i, j in blocks(offsets, 4 * BLOCK):
                w = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), np.uint32)
                cuts = (offsets[i : j + 1] - offsets[i]) // 4
                if j > i + 1 or len(w) <= 2 * BLOCK:
                    _leaks(w, cuts, i, items, latent, cosine, share, answers, best)
                    continue
                for at in range(0, len(w), BLOCK):  # a long text in pieces that overlap by the longest window
                    part = w[max(0, at - longest) : at + BLOCK]
                    _leaks(part, np.array([0, len(part)]), i, items, latent, cosine, share, answers, best)
            out = [(docs[i].as_py(), items.ids[k], *v) for (i, k), v in sorted(best.items())]
            names = ["doc", "item", "cosine", "lcs_share", "answer_share"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names)

    return run


def _leaks(w: np.ndarray, cuts: np.ndarray, base: int, items: Items, latent: np.ndarray, cosine: float, share: float, answers: float, best: dict) -> None:
    """Search the documents that ``cuts`` separates in ``w``; the first has the number ``base``."""
    if not len(w):
        return
    # sums of four words each, a document's last ones filled up with nothing; then running sums
    sizes = np.diff(cuts)
    padded = -(-sizes // 4) * 4
    edges = np.concatenate(([0], np.cumsum(padded)))
    term = np.full(edges[-1], TERMS)
    term[np.arange(len(w)) + np.repeat(edges[:-1] - cuts[:-1], sizes)] = w % TERMS
    latent = np.concatenate((latent, np.zeros((1, latent.shape[1]), np.float32)))
    four = latent[term[0::4]]
    for i in (1, 2, 3):
        four += latent[term[i::4]]
    run = np.zeros((len(four) + 1, latent.shape[1]), np.float32)
    np.cumsum(four, axis=0, out=run[1:])
    for length, (ks, vectors, rare, places, maybe) in items.by_length.items():
        step = max(1, length // 4)
        n = np.where(sizes > 0, -(-np.maximum(1, sizes - length + step) // step), 0)
        owner = np.repeat(np.arange(len(sizes)), n)
        start = cuts[owner] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
        low = (start + (edges[:-1] - cuts[:-1])[owner]) // 4
        high = np.minimum(low + length // 4, edges[owner + 1] // 4)
        # the text of a candidate: the window and half a length on both sides; in it, the answer words of the group
        begin, end = np.maximum(start - length // 2, cuts[owner]), np.minimum(start + length + length // 2, cuts[owner + 1])
        at = np.flatnonzero(maybe[w & 0xFFFF])
        place = np.searchsorted(rare, w[at]).clip(0, len(rare) - 1)
        at, place = at[rare[place] == w[at]], place[rare[place] == w[at]]
        from_, to = np.searchsorted(at, begin), np.searchsorted(at, end)
        rows = min(2048, max(16, (1 << 22) // (len(rare) + 1)))
        for a in range(0, len(start), rows):
            v = run[high[a : a + rows]] - run[low[a : a + rows]]
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            near = v @ vectors.T
            win, col = np.nonzero(near >= cosine * norm[:, None])
            if not len(win):
                continue
            # answers first, for all candidates at once
            many = to[a : a + rows] - from_[a : a + rows]
            told = np.zeros((len(v), len(rare) + 1), bool)
            told[np.repeat(np.arange(len(v)), many), place[np.repeat(from_[a : a + rows] - np.cumsum(many) + many, many) + np.arange(many.sum())]] = True
            part = np.zeros(len(win), np.int8)
            for c in places.T:
                part += told[win, c[col]]
            part = part / items.n_answers[ks[col]]
            for x in np.flatnonzero(part >= answers):
                p, k = a + win[x], int(ks[col[x]])
                same = lcs(items.masks[k], items.sizes[k], w[begin[p] : end[p]].tolist()) / items.sizes[k]
                key = (base + int(owner[p]), k)
                if same >= share and (key not in best or same > best[key][1]):
                    best[key] = (float(near[win[x], col[x]] / max(norm[win[x]], 1e-9)), same, float(part[x]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, share: float = 0.6, answers: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, item, cosine, lcs_share, answer_share): one row for each document and item that it leaks.

    Whole texts and all items are searched, in blocks of items.  Rows with null ids, and
    null and empty texts, leak nothing and are not leaked.  A repeated document row
    repeats its rows; a repeated item id is searched with each of its texts and keeps the
    best.  An empty table gives an empty result.  Ids that are no whole numbers raise a
    TypeError.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    code = lambda df, i, t: whole_ids(df, i).where(F.col(i).isNotNull() & F.col(t).isNotNull()).select(F.col(i).cast("long").alias("doc"), F.col(t).alias("text")).mapInArrow(_encode, "doc long, words binary")
    coded = scratch.table(code(docs, id_col, text_col))
    bench = scratch.table(code(benchmark, item_col, item_text_col))
    schema = "doc long, item long, cosine double, lcs_share double, answer_share double"
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    if n == 0:
        return spark.createDataFrame([], schema)
    idf, latent = latent_terms(coded)
    parts, out = max(-(-n // ITEMS), -(-size // ITEM_BYTES)), None
    for b in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("doc", "words"), F.lit(parts)) == b).collect()  # about ITEMS items of ITEM_BYTES
        rows.sort(key=lambda r: (r["doc"], bytes(r["words"])))
        given = spark.sparkContext.broadcast((Items([r["doc"] for r in rows], [np.frombuffer(bytes(r["words"]), np.uint32) for r in rows], idf, latent), latent))
        found = coded.mapInArrow(_search(given, cosine, share, answers), schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that leak no item, with their input columns.

    Rows without an id, and null and empty texts, stay.  All rows of an id go if one of them leaks.
    """
    leaks = find_leaks(docs, benchmark, id_col=id_col, **how).select(F.col("doc").alias("__leak")).distinct()
    return docs.join(leaks, F.col(id_col) == F.col("__leak"), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "cosine", "lcs_share", "answer_share")
