"""MinHash near-dedup with fast similarity sketching.

A document's sketch has ``COORDS`` coordinates.  In round i every shingle is hashed to
one coordinate and a value, and a coordinate keeps the smallest (round, value).  After
COORDS such rounds, round COORDS + j puts every shingle on coordinate j, so every
coordinate fills; most documents are full after a few rounds (Dahlgaard, Knudsen and
Thorup, 2017: the estimate concentrates as that of as many independent MinHashes).

Documents with equal sets form classes.  Bands over the sketch find candidates between
classes.  Two summaries drop dissimilar ones: a parity sketch of the set, whose differing
bits never outnumber the differing shingles, so that it drops no link, and one bit of
each coordinate, which matters for sets larger than the parity sketch.  The rest are
confirmed on the full shingle sets.  Every member of a bucket first meets the bucket's
pivots, and its best one is confirmed.  Buckets whose members are then not known to be
connected are searched further: members outside the bucket's main part against the
members of all other parts, a large bucket in pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import components
from .common import Scratch, blobs, blocks, mix64, whole_ids, words

COORDS = 256
#: The chance that a pair at the threshold shares no band is at most this.
MISS = 1e-8
#: Standard deviations below the threshold at which the one-bit estimate drops a pair.
SIGMAS = 5.5
BLOCK = 1 << 19
#: Members of a bucket that are compared at a time.
BUCKET = 512
#: Bitmaps of 32,768 bits that tell the ids of candidates.
MAPS = 1024
#: Bits of the parity sketch of a set.
ODD = 512
#: Sets of more shingles have a parity sketch of their own width.
LONG = 512
#: The columns of the two summaries.
BITS = [*(f"b{i}" for i in range(COORDS // 64)), *(f"o{i}" for i in range(ODD // 64))]
_TURN = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5], np.uint64)


def banding(percent: int) -> tuple[int, int]:
    """(rows of a band, bands): the most rows whose bands miss a pair at the threshold with odds of MISS at most."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if bands <= 40 and rows * bands <= COORDS:
            return rows, bands
    raise ValueError("threshold too low for the sketch")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows, one after another; number of each row)."""
    flat, counts = [], []
    for i, j in blocks(offsets, BLOCK):
        raw = data[offsets[i] : offsets[j]]
        # a space between rows, so that no word crosses
        cut = offsets[i : j + 1] - offsets[i]
        spaced = np.full(len(raw) + (j - i), 32, np.uint8)
        spaced[np.arange(len(raw)) + np.repeat(np.arange(j - i), np.diff(cut))] = raw
        start, word = words(spaced)
        first = np.searchsorted(start, cut + np.arange(j - i + 1))
        if len(word) >= k:
            run = sum((word[m : len(word) - k + 1 + m] * _TURN[m % 5] + np.uint64(m // 5) for m in range(k)), np.uint64(0))
            run = mix64(run)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                found = np.unique(run[a : b - k + 1])
            elif b > a:
                found = mix64(np.array([sum(int(w) * int(_TURN[m % 5]) for m, w in enumerate(word[a:b])) + int(b - a) & 0xFFFFFFFFFFFFFFFF], np.uint64))
            else:
                found = np.zeros(0, np.uint64)
            flat.append(found)
            counts.append(len(found))
    return (np.concatenate(flat) if flat else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def sketches(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(rows, COORDS) uint64; rows without shingles are all ones."""
    n = len(counts)
    out = np.full(n * COORDS, np.iinfo(np.uint64).max, np.uint64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    left = np.flatnonzero(counts)
    for i in range(2 * COORDS):
        if not len(left):
            break
        at = np.repeat(starts[left] - np.concatenate(([0], np.cumsum(counts[left])[:-1])), counts[left]) + np.arange(counts[left].sum())
        row = np.repeat(left, counts[left])
        h = mix64(flat[at] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bin_ = (h >> np.uint64(56)).astype(np.int64) if i < COORDS else np.full(len(h), i - COORDS)
        value = (np.uint64(i) << np.uint64(48)) | (h & np.uint64(0xFFFFFFFFFFFF))
        np.minimum.at(out, row * COORDS + bin_, value)
        left = left[(out.reshape(n, COORDS)[left] == np.iinfo(np.uint64).max).any(1)]
    return out.reshape(n, COORDS)


def wide_parity(shingles: np.ndarray) -> bytes:
    """A parity sketch of one to two bits for a shingle; the halves of a sketch, XORed, are the sketch of half its width."""
    width = 2 << (len(shingles).bit_length() - 1)
    odd = np.bincount((mix64(shingles + np.uint64(0x3C6EF372)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Rows of a parity sketch brought to ``size`` bytes."""
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0 to len(x) values, modulo 2^64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def _signatures(k: int, rows: int, bands: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = blobs(batch.column(1))
            for i, j in blocks(offsets, BLOCK):
                flat, counts = shingle_sets(data, offsets[i : j + 1], k)
                sketch = sketches(flat, counts)
                mixed = mix64(sketch)
                band = np.zeros((j - i, bands), np.uint64)
                for m in range(rows):
                    band = band * np.uint64(0x9E3779B97F4A7C15) + mixed[:, m * bands : (m + 1) * bands]
                band = mix64(band + np.arange(bands, dtype=np.uint64))
                bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
                starts = np.concatenate(([0], np.cumsum(counts)))
                odd = np.repeat(np.arange(j - i), counts) * ODD + (mix64(flat + np.uint64(0x51ED270B)) % np.uint64(ODD)).astype(np.int64)
                odd = np.packbits((np.bincount(odd, minlength=(j - i) * ODD) & 1).astype(np.uint8).reshape(j - i, ODD), axis=1).view(np.int64)
                bits = np.concatenate((bits, odd), 1)
                f1, f2 = _running(mix64(flat)), _running(mix64(flat * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)))
                f1, f2 = f1[starts[1:]] - f1[starts[:-1]], f2[starts[1:]] - f2[starts[:-1]]
                wide = [wide_parity(flat[e - c : e]) if c > LONG else None for e, c in zip(starts[1:], counts)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, pa.array(wide, pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, c])) for c in range(len(BITS))]], ["doc", "n", "f1", "f2", "bands", "wide", *BITS])

    return run


def _sets(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = blobs(batch.column(1))
            for i, j in blocks(offsets, BLOCK, 512):
                flat, counts = shingle_sets(data, offsets[i : j + 1], k)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([flat[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary())], ["doc", "shingles"])

    return run


def _linked(percent: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _side(side: str) -> list[Column]:
    """The summaries of one side of a pair, renamed."""
    return [F.col("n").alias(f"n{side}"), *[F.col(c).alias(side + c) for c in BITS]]


def _apart(kind: str) -> Column:
    """The differing bits of the two sides' summaries of one kind."""
    return sum((F.bit_count(F.col("x" + c).bitwiseXOR(F.col("y" + c))) for c in BITS if c[0] == kind), F.lit(0))


def _most_apart(percent: int) -> int:
    """The differing one-bit coordinates at which a pair is dropped."""
    p = (1 - percent / 100) / 2
    return math.floor(COORDS * p + SIGMAS * math.sqrt(COORDS * p * (1 - p)))


def _near(percent: int) -> Column:
    """Sizes within the threshold, and neither summary against it."""
    # intersection / union >= t means that at most (1 - t) / (1 + t) of the two sizes differ
    differ = (100 - percent) * (F.col("nx") + F.col("ny"))
    return (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * _apart("o") <= differ) & (_apart("b") <= _most_apart(percent))


def _far_apart(x: dict, y: dict, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs have no fewer than so many differing shingles by their wide sketches: some of the bits first."""
    ends = [(np.array([len(w) if w is not None else 0 for w in t["wide"]]), t["wide"]) for t in (x, y)]
    size = np.minimum(ends[0][0][p], ends[1][0][q])
    out = np.zeros(len(p), bool)
    for width in np.unique(size[size > 0]):
        for part in dict.fromkeys((max(width // 4, min(width, 128)), width)):
            at = np.flatnonzero((size == width) & ~out)
            sides = []
            for (long, wide), rows in zip(ends, (p, q)):
                used = np.unique(rows[at])
                folded = np.zeros((len(long), part), np.uint8)
                for w in np.unique(long[used]):
                    own = used[long[used] == w]
                    folded[own] = _fold(np.frombuffer(b"".join(wide[i] for i in own), np.uint8).reshape(len(own), w), part)
                sides.append(folded.view(np.uint64) if part % 8 == 0 else folded)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                out[some] = np.bitwise_count(sides[0][p[some]] ^ sides[1][q[some]]).sum(1, dtype=np.int64) > most[some]
    return out


def _near_pairs(x: dict, y: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``_near`` over two blocks of one bucket: the pairs (src, dst) of different labels."""
    most, src, dst = _most_apart(percent), [], []
    bits = lambda u, v, cols: sum((np.bitwise_count(u(c) ^ v(c)).astype(np.int16) for c in cols), np.int16(0))
    odd, coords = [c for c in BITS if c[0] == "o"], [c for c in BITS if c[0] == "b"]
    for a in range(0, len(x["doc"]), 256):
        part = {c: v[a : a + 256] for c, v in x.items()}
        both = part["n"][:, None] + y["n"]
        least = np.minimum(part["n"][:, None], y["n"])
        ok = (part["label"][:, None] != y["label"]) & ((y["label"] == y["main"]) | (part["doc"][:, None] < y["doc"]))
        ok &= 100 * least >= percent * (both - least)
        if not ok.any():
            continue
        # half of the parity bits for all pairs, the rest for those that are left
        ok &= (100 + percent) * bits(lambda c: part[c][:, None], lambda c: y[c], odd[: len(odd) // 2]).astype(np.int32) <= (100 - percent) * both  # noqa: B023
        p, q = np.nonzero(ok)
        for cols, bound in ((odd, lambda: (100 - percent) * both[p, q] // (100 + percent)), (coords, lambda: most)):  # noqa: B023
            keep = bits(lambda c: part[c][p], lambda c: y[c][q], cols) <= bound()  # noqa: B023
            p, q = p[keep], q[keep]
        keep = ~_far_apart(part, y, p, q, (100 - percent) * both[p, q] // (100 + percent))
        p, q = p[keep], q[keep]
        src.append(np.minimum(part["doc"][p], y["doc"][q]))
        dst.append(np.maximum(part["doc"][p], y["doc"][q]))
    none = np.zeros(0, np.int64)
    return np.concatenate(src or [none]), np.concatenate(dst or [none])


def _columns(t) -> dict:
    return {c: np.array(t.column(c).to_pylist(), object) if c == "wide" else t.column(c).to_numpy() for c in t.column_names}


def _near_blocks(percent: int):
    """``_near_pairs`` of two blocks."""

    def run(left, right):
        import pyarrow as pa

        return pa.table(dict(zip(("src", "dst"), _near_pairs(_columns(left), _columns(right), percent))))

    return run


def _near_buckets(percent: int):
    """``_near_pairs`` of every bucket of a group of small ones."""

    def run(table):
        import pyarrow as pa

        every = _columns(table.sort_by("band"))
        edge = np.append(np.flatnonzero(np.diff(every["band"], prepend=every["band"][0] - 1)), len(every["band"])) if table.num_rows else [0]
        found = []
        for i, j in zip(edge[:-1], edge[1:]):
            y = {c: v[i:j] for c, v in every.items()}
            out = y["label"] != y["main"]
            found.append(_near_pairs({c: v[out] for c, v in y.items()}, y, percent))
        # a pair that shares many buckets is given once by this group
        pairs = np.unique(np.concatenate([np.column_stack(x) for x in found] or [np.zeros((0, 2), np.int64)]), axis=0)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    return run


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that may have one of the ids: most others go before their texts are shuffled.

    A table of MAPS bitmaps of 4 kB, whatever the number of ids, is sent to the tasks.
    """
    place = F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(MAPS << 15))
    maps = ids.groupBy(F.bitmap_bucket_number(place).alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (F.bitmap_bit_position(place) % 8).cast("int") + 1)) != 0
    return docs.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("__map")).where(there).drop("__map", "__bits")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (src, dst), a written table, of which some texts' full sets meet the threshold."""
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("doc")).distinct()
    # ids are distinct, so this join only filters; the optimiser would move a semi-join below the bitmaps
    # an id's rows lie together after the join: each of its texts counts once
    texts = _perhaps(docs, ids).join(ids, "doc").groupBy("doc", F.xxhash64("text").alias("th")).agg(F.min("text").alias("text")).select("doc", "text")
    sets, sets_at = scratch.put(texts.mapInArrow(_sets(k), "doc long, shingles binary"))
    left = pairs.join(sets.select(F.col("doc").alias("src"), F.col("shingles").alias("s")), "src")
    both = left.join(sets.select(F.col("doc").alias("dst"), F.col("shingles").alias("t")), "dst").select("src", "dst", "s", "t")
    links = scratch.table(both.mapInArrow(_linked(percent), "src long, dst long"))
    scratch.drop(sets_at)  # the links are written; the sets are the largest table here
    return links


def _pivots(reps: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(src, dst): each class with two pivots of its buckets, if any are near: the smallest and the most similar.

    A bucket has three pivots: its smallest id, its largest, and the smallest once some
    bits are turned.  Also the classes (doc) in buckets of three members or more.
    """
    member = reps.select("doc", F.explode("bands").alias("band"))
    turned = lambda c: c.bitwiseXOR(F.lit(0x5DEECE66D2B7A3C9))
    buckets = member.groupBy("band").agg(F.array(F.min("doc"), F.max("doc"), turned(F.min(turned(F.col("doc"))))).alias("pivots"), F.count("*").alias("size")).where("pivots[0] < pivots[1]")
    # three pivots for each of the bands at most
    asked = member.join(buckets, "band").groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"), F.max("size").alias("most"))
    asked = scratch.table(asked)
    x = asked.drop("most").join(reps.select("doc", *_side("x")), "doc").withColumn("pivot", F.explode("pivots")).drop("pivots").where("doc <> pivot")
    near = x.join(reps.select(F.col("doc").alias("pivot"), *_side("y")), "pivot").where(_near(percent))
    best = near.groupBy("doc").agg(F.min("pivot").alias("least"), F.min(F.struct((_apart("b") + _apart("o")).alias("apart"), "pivot"))["pivot"].alias("like"))
    best = best.select("doc", F.explode(F.array_distinct(F.array("least", "like"))).alias("pivot"))
    return best.select(F.least("doc", "pivot").alias("src"), F.greatest("doc", "pivot").alias("dst")).distinct(), asked.where("most > 2").select("doc")


def _open_pairs(reps: DataFrame, label: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(src, dst): near pairs of different labels in a bucket, which no label spans yet.

    The members outside a bucket's main label meet the members of other labels.  A bucket
    of up to BUCKET members is one key of a join, or with long sets part of a group of
    several; a larger one is cut into blocks of about BUCKET members, and each pair of
    blocks is a group of its own.
    """
    known = reps.select("doc", "bands", F.col("n") > LONG).toDF("doc", "bands", "long").join(label, "doc", "left").select("doc", "long", F.coalesce("label", "doc").alias("label"), F.explode("bands").alias("band"))
    per = known.groupBy("band", "label").agg(F.count("*").alias("c"), F.max("long").alias("long"))
    open_ = per.groupBy("band").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("size"), F.count("*").alias("parts"), F.max("long").alias("long")).where("parts > 1 AND size > 2")
    # the summaries come to the members of open buckets only
    inside = known.drop("long").join(open_.select("band", F.col("m.label").alias("main"), "size", (F.col("size") - F.col("m.c")).alias("rest"), "long"), "band")
    inside = scratch.table(inside.join(reps.select("doc", "n", "wide", *BITS), "doc"))
    near_buckets = _near_buckets(percent)
    few = inside.where((F.col("size") <= BUCKET) & ~F.col("long"))
    a = few.where("label <> main").select("band", F.col("doc").alias("p"), F.col("label").alias("lp"), *_side("x"))
    b = few.select(F.col("band").alias("band2"), F.col("doc").alias("q"), F.col("label").alias("lq"), "main", *_side("y"))
    pairs = a.join(b, (F.col("band") == F.col("band2")) & (F.col("lp") != F.col("lq")) & ((F.col("lq") == F.col("main")) | (F.col("p") < F.col("q"))) & _near(percent))
    pairs = pairs.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"))
    kept = ["band", "doc", "n", "wide", "label", "main", *BITS]
    # buckets with long sets are compared with the sketches of these sets' own width: many small ones to a group
    long = inside.where((F.col("size") <= BUCKET) & F.col("long"))
    rows = long.count()
    if rows:
        dealt = long.select(*kept, F.pmod(F.xxhash64("band"), F.lit(-(-rows // BUCKET))).alias("deal"))
        pairs = pairs.unionByName(dealt.groupBy("deal").applyInArrow(lambda t: near_buckets(t.drop_columns("deal")), "src long, dst long"))
    many = inside.where(F.col("size") > BUCKET)
    if many.take(1):
        blocks_of = lambda c: F.ceil(F.col(c) / BUCKET).cast("int")
        own = lambda c: F.pmod(F.xxhash64("doc"), blocks_of(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), blocks_of(c) - 1))
        left = many.where("label <> main").select(*kept, own("rest").alias("i"), every("size").alias("j"))
        right = many.select(*kept, every("rest").alias("i"), own("size").alias("j"))
        key = ["band", "i", "j"]
        pairs = pairs.unionByName(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_near_blocks(percent), "src long, dst long"))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component): each document's set size and the smallest id it is linked to.

    Documents are linked if 100 * intersection >= percent * union of their sets of
    distinct k-word shingles; a text with fewer words is one shingle as a whole.  Null
    and empty texts have no shingles and no links.  Rows with a null id are left out.  A
    repeated id is one document: it has the links of all its texts, and each of its rows
    comes out with its own set's size.  An empty table gives an empty result.  Ids that are
    no whole numbers raise a TypeError.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows, bands = banding(percent)
    slim = whole_ids(docs, id_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sig = slim.mapInArrow(_signatures(k, rows, bands), "doc long, n long, f1 long, f2 long, bands array<long>, wide binary, " + ", ".join(f"{c} long" for c in BITS))
    sig = scratch.table(sig)
    scratch.expect(sig.count())
    full = sig.select("doc", "n", "f1", "f2")
    # equal sets form a class; its smallest id stands for it
    reps = scratch.table(sig.where("n > 0").groupBy("f1", "f2").agg(F.min("doc").alias("doc"), F.first(F.struct("n", "bands", "wide", *BITS)).alias("s")).select("f1", "f2", "doc", "s.*"))
    classes = reps.select("f1", "f2", F.col("doc").alias("rep"))
    star, crowd = _pivots(reps, percent, scratch)
    star = scratch.table(star)
    links = _confirm(star, slim, k, percent, scratch)
    label = components(links).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    pairs = scratch.table(_open_pairs(reps.join(crowd, "doc", "left_semi"), label, percent, scratch).join(star, ["src", "dst"], "left_anti"))
    if pairs.take(1):
        links = links.unionByName(_confirm(pairs, slim, k, percent, scratch))
    # an id with several sets ties their classes together
    torn = full.where("n > 0").groupBy("doc").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a <> b").select("doc")
    if torn.take(1):
        links = links.unionByName(full.join(torn, "doc", "left_semi").join(classes, ["f1", "f2"]).select(F.col("doc").alias("src"), F.col("rep").alias("dst")))
    final = components(links).select(F.col("node").alias("rep"), "component")
    of_class = classes.join(final, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    linked = full.where("n > 0").join(of_class, ["f1", "f2"]).select("doc", F.col("n").alias("n_shingles"), "component")
    return linked.unionByName(full.where("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with the input columns.

    Rows without an id, and null and empty texts, stay.  Rows that repeat an id stay or go together.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = found.where("doc <> component").select(F.col("doc").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, k=3, percent=85)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
