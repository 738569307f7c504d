"""Suffix-array dedup with a logarithmic family of levels.

Matches of ``length`` bytes are found at content-defined anchors (see ``anchors``).  Runs
of windows whose k-gram occurs once match nothing.  Equal extents match as a whole and
form a class.  Where one k-gram has several different extents, parts of them may still
match: those classes' texts go to the index.

The index takes them in batches.  A batch is a suffix array over its windows, sorted by
anchor, offset and text; it is merge-scanned with every level, and neighbours in the
merged order that are equal over the whole length are matches.  Then the batch becomes a
level, and levels of equal size merge, so that a text is rewritten O(log n) times.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, runs
from .common import Scratch, blobs, whole_ids

#: Places that are sent to the tasks at most (16 bytes each); classes of a k-gram that one task compares; windows that it sorts at a time.
AT_ONCE, MOST_CLASSES, WINDOWS = 2_000_000, 4_000, 50_000
LEVEL = "kh long, x long, o long, m long, body binary"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _grams(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = blobs(batch.column(1))
            found = [runs(data[a:b], length)[0] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found or [np.zeros(0, np.uint64)])))], ["kh"])

    return run


def _anchors(length: int):
    """(kh, x, doc, th, p, o, m): k-gram, extent, row by id and text, first window, anchor - p, last window - p."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = blobs(batch.column(1))
            docs, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for i in range(len(docs)):
                kh, x, first, last, anchor = runs(data[offsets[i] : offsets[i + 1]], length)
                if len(kh):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (_signed(kh), _signed(x), np.full(len(kh), docs[i]), np.full(len(kh), hashes[i], np.int32), first, anchor - first, last - first)], ["kh", "x", "doc", "th", "p", "o", "m"])

    return run


def _picked(length: int, given=None):
    """(kh, x, o, m, body) of the runs at given first windows.

    The places are in ``given``, sorted by document, or in the rows' third column.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = blobs(batch.column(1))
            out = []
            if given is None:
                lists = batch.column(2)
                at = [(i, lists[i].values.to_numpy()) for i in range(len(lists))]
            else:
                docs, places = given.value
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
                at = [(i, places[lo[i] : hi[i]]) for i in np.flatnonzero(hi > lo)]
            for i, spots in at:
                raw = data[offsets[i] : offsets[i + 1]]
                kh, x, first, last, anchor = runs(raw, length)
                for j in np.flatnonzero(np.isin(first, spots)):
                    out.append((_signed(kh[j : j + 1])[0], _signed(x[j : j + 1])[0], anchor[j] - first[j], last[j] - first[j], raw[first[j] : last[j] + length].tobytes()))
            cols = list(zip(*out)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], ["kh", "x", "o", "m", "body"])

    return run


def _scan(length: int):
    """Merge-scan of rows (kh, x, o, m, body, new) sorted by kh: (kh, x, w), the windows with an equal neighbour.

    Only pairs with a new side count, as old ones were scanned before.
    """

    def matches(group: list[tuple]) -> list[tuple]:
        # every window: its group and offset to the anchor first, then its bytes
        n = np.array([m + 1 for _, _, _, m, _, _ in group])
        owner = np.repeat(np.arange(len(group)), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.cumsum([0] + [len(g[4]) for g in group[:-1]])
        flat = np.frombuffer(b"".join(g[4] for g in group), np.uint8)
        body = np.lib.stride_tricks.sliding_window_view(flat, length)[starts[owner] + w]
        _, kind = np.unique([g[0] for g in group], return_inverse=True)
        at = kind[owner].astype(np.uint64) << np.uint64(16) | (np.array([g[2] for g in group])[owner] - w).astype(np.uint64)
        rows = np.concatenate((at.astype(">u8").view(np.uint8).reshape(-1, 8), body), axis=1)
        order = np.argsort(np.ascontiguousarray(rows).view(f"V{length + 8}").reshape(-1).view(f"S{length + 8}"), kind="stable")
        same = (rows[order[1:]] == rows[order[:-1]]).all(1)
        new = np.array([g[5] for g in group])[owner][order]
        # a run of equal neighbours counts where one of them is new
        head = np.concatenate(([True], ~same))
        runs_ = np.cumsum(head) - 1
        size, fresh = np.bincount(runs_), np.bincount(runs_, new)
        hit = order[((size > 1) & (fresh > 0))[runs_]]
        return [(group[i][0], group[i][1], int(k)) for i, k in zip(owner[hit], w[hit])]

    def run(batches):
        import pyarrow as pa

        def out(rows):
            cols = list(zip(*rows)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["kh", "x", "w"])

        ready, count, open_ = [], 0, []  # whole groups, and the group that is still growing
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if open_ and open_[-1][0] != row[0]:
                    if len(open_) > 1:
                        ready += open_
                        count += sum(g[3] + 1 for g in open_)
                    open_ = []
                    if count >= WINDOWS:
                        yield out(matches(ready))
                        ready, count = [], 0
                open_.append(row)
        if len(open_) > 1:
            ready += open_
        if ready:
            yield out(matches(ready))

    return run


def _windows(length: int):
    """(kh, x, w, h1, h2): every window of a class, for k-grams with very many classes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for kh, x, o, m, body in zip(*(batch.column(c).to_pylist() for c in range(5))):
                h = [hashlib.blake2b(body[w : w + length], digest_size=16, salt=int(o - w).to_bytes(8, "little")).digest() for w in range(m + 1)]
                h = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m + 1, kh)), pa.array(np.full(m + 1, x)), pa.array(np.arange(m + 1)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["kh", "x", "w", "h1", "h2"])

    return run


class SuffixLevels:
    """Sorted levels (kh, x, o, m, body) in the shared folder, with sizes that grow geometrically."""

    def __init__(self, spark: SparkSession, length: int):
        self.spark, self.length, self.scratch = spark, length, Scratch(spark, "suffix-levels")
        self.levels: dict[int, tuple[DataFrame, str]] = {}

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-scan a batch with all levels, then add it; (kh, x, w) of matching windows on both sides."""
        rows = batch.withColumn("new", F.lit(1))
        for level, _ in self.levels.values():
            rows = rows.unionByName(level.withColumn("new", F.lit(0)))
        found = rows.repartition("kh").sortWithinPartitions("kh", "o", "body").mapInArrow(_scan(self.length), "kh long, x long, w long")
        found = self.scratch.table(found)
        rank, rows = 0, batch
        while rank in self.levels:
            old, path = self.levels.pop(rank)
            rows, rank = rows.unionByName(old), rank + 1
        self.levels[rank] = self.scratch.put(rows.repartition("kh").sortWithinPartitions("kh", "o", "body"))
        return found


def repeated_windows(docs: DataFrame, length: int, batches: int, scratch: Scratch) -> DataFrame:
    """(doc, th, start, end): byte ranges whose every window of ``length`` bytes also starts elsewhere.

    ``docs`` has doc, body and th, a hash of the body that tells apart the texts of one id.
    """
    spark = docs.sparkSession
    # written, as are the ranges below: Spark splits a hot key of a join only if both sides are plain shuffles
    common = scratch.table(docs.mapInArrow(_grams(length), "kh long").groupBy("kh").count().where("count > 1").select("kh"))
    shape = "kh long, x long, doc long, th int, p long, o long, m long"
    seen = scratch.table(docs.mapInArrow(_anchors(length), shape).join(common, "kh", "left_semi"))
    classes = seen.groupBy("kh", "x").agg(F.count("*").alias("n"), F.min(F.struct("doc", "p")).alias("at"))
    classes = scratch.table(classes)
    per = classes.groupBy("kh").agg(F.count("*").alias("classes")).where("classes > 1")
    contested = scratch.table(classes.join(per, "kh").select("kh", "x", "at.doc", "at.p", "classes"))
    # the text of one member of each contested class: few places go to the tasks, many are joined with the documents
    if contested.count() <= AT_ONCE:
        places = contested.select("doc", "p").toArrow()
        order = np.argsort(places["doc"].to_numpy(), kind="stable")
        given = spark.sparkContext.broadcast((places["doc"].to_numpy()[order], places["p"].to_numpy()[order]))
        bodies = docs.mapInArrow(_picked(length, given), LEVEL)
    else:
        of_doc = contested.groupBy(F.col("doc").alias("d")).agg(F.collect_list("p").alias("places"))
        bodies = docs.join(of_doc, F.col("doc") == F.col("d")).select("doc", "body", "places").mapInArrow(_picked(length), LEVEL)
    bodies = scratch.table(bodies.dropDuplicates(["kh", "x"]))
    # very many classes of one k-gram: windows are grouped by hash, with partial counts before the shuffle
    hot = per.where(F.col("classes") > MOST_CLASSES).select("kh")
    window = scratch.table(bodies.join(hot, "kh", "left_semi").mapInArrow(_windows(length), "kh long, x long, w long, h1 long, h2 long"))
    twice = window.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    found = window.join(twice, ["h1", "h2"], "left_semi").select("kh", "x", "w")
    index = SuffixLevels(spark, length)
    cool = scratch.table(bodies.join(hot, "kh", "left_anti"))
    for b in range(batches):
        found = found.unionByName(index.add(cool.where(F.pmod(F.xxhash64("x"), F.lit(batches)) == b)))
    # windows of single classes, as ranges of consecutive ones
    flat = found.groupBy("kh", "x").agg(F.array_sort(F.collect_set("w")).alias("w"))
    breaks = F.filter("w", lambda v, i: (i == 0) | (F.get("w", i - 1) != v - 1))
    ends = F.filter("w", lambda v, i: (i == F.size("w") - 1) | (F.get("w", i + 1) != v + 1))
    parts_of = flat.select("kh", "x", F.arrays_zip(breaks.alias("a"), ends.alias("b")).alias("ranges"))
    whole = classes.where("n > 1").select("kh", "x", F.lit(True).alias("whole"))
    told = whole.join(parts_of, ["kh", "x"], "full_outer")
    ranges = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("m").alias("b")))).otherwise(F.col("ranges"))
    hits = seen.join(scratch.table(told), ["kh", "x"]).select("doc", "th", "p", F.explode(ranges).alias("r"))
    return hits.select("doc", "th", (F.col("p") + F.col("r.a")).alias("start"), (F.col("p") + F.col("r.b") + length).alias("end"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without overlap and contact."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[cut], ends[np.append(np.flatnonzero(cut)[1:] - 1, len(ends) - 1)]


def drop_repeated_bytes(docs: DataFrame, length: int = 200, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Gives id, n_bytes, n_removed, starts and ends (the removed byte ranges) and kept
    (the bytes left).  Texts are UTF-8 bytes; null texts are empty.  Strings are judged
    on the input, overlaps count, and matches never cross documents.  Rows with a null id
    take no part and stay whole.  Rows that repeat an id are rows of their own: equal
    ones are copies of each other, others are told apart by a 32-bit hash of their text.  An empty table gives an empty result.  Ids
    that are no whole numbers raise a TypeError.
    """
    import pyarrow as pa

    if length < 2 * GRAM or length > 60_000:
        raise ValueError("length must lie between 64 and 60000 bytes")
    scratch = Scratch(docs.sparkSession, "suffix")
    slim = whole_ids(docs, id_col).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")).withColumn("th", F.hash("body"))
    found = repeated_windows(slim.where(F.octet_length("body") >= length).where("doc IS NOT NULL").withColumn("doc", F.col("doc").cast("long")), length, batches, scratch)
    spans = found.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("start", "end")).alias("r"))
    spans = spans.select("d", "t", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))
    both = slim.join(spans, (F.col("doc").cast("long") == F.col("d")) & (F.col("th") == F.col("t")), "left").select("doc", "body", "starts", "ends")

    def cut(batches_):
        for batch in batches_:
            kept, removed, all_starts, all_ends = [], [], [], []
            for body, a, b in zip(*(batch.column(c) for c in (1, 2, 3))):
                body, a, b = body.as_py(), a.values, b.values
                if a is None or not len(a):
                    a = b = np.zeros(0, np.int64)
                else:
                    a, b = merged(a.to_numpy(), b.to_numpy())
                edges = [0, *(e for pair in zip(a.tolist(), b.tolist()) for e in pair), len(body)]
                kept.append(b"".join(body[s:e] for s, e in zip(edges[::2], edges[1::2])))
                removed.append(int((b - a).sum()))
                all_starts.append(a)
                all_ends.append(b)
            sizes = [len(k) + r for k, r in zip(kept, removed)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_starts, kind), pa.array(all_ends, kind), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "starts", "ends", "kept"])

    return both.mapInArrow(cut, f"`{id_col}` {dict(slim.dtypes)['doc']}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
