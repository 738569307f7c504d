"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node splits at the hyperplane between the centres
of a short two-means run over random points.  Every vector of the table is then put in
one leaf of each tree.  A query walks all trees through one shared priority queue,
ordered by the squared distance that the splits passed on the wrong side prove at least,
and takes leaves until they hold the asked share of the table.  The leaf's vectors are
ranked by exact distance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, about, whole_ids

#: Vectors that the trees are grown on at most; rows that a leaf should hold; rows of a block of leaves, and of a piece of a larger leaf.
SAMPLE, LEAF_ROWS, BLOCK_ROWS = 20_000, 128, 4_096
#: Queries of one group of a block, and of one slice of its distances.
QUERIES, SLICE = 20_000, 256


@dataclass
class Tree:
    normals: np.ndarray  # (nodes, dims)
    cuts: np.ndarray
    left: np.ndarray  # child on the positive side; -1 at a leaf
    right: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            side = np.einsum("ij,ij->i", x[inner], self.normals[node]) > self.cuts[node]
            at[inner] = np.where(side, self.left[node], self.right[node])


def grow(sample: np.ndarray, leaf: int, draw: np.random.Generator) -> Tree:
    """A tree whose leaves hold at most ``leaf`` sample rows, unless no split separates them."""
    normals, cuts, left, right = [], [], [], []

    def node() -> int:
        normals.append(np.zeros(sample.shape[1]))
        cuts.append(0.0)
        left.append(-1)
        right.append(-1)
        return len(left) - 1

    todo = [(node(), np.arange(len(sample)))]
    while todo:
        k, rows = todo.pop()
        if len(rows) <= leaf:
            continue
        for _ in range(6):
            some = sample[draw.choice(rows, min(len(rows), 200), replace=False)]
            a, b = some[0], some[-1]
            for _ in range(4):
                near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = some[near].mean(0), some[~near].mean(0)
            length = np.linalg.norm(a - b)
            if not length > 0:
                continue
            normal = (a - b) / length
            cut = float(normal @ (a + b) / 2)
            side = sample[rows] @ normal > cut
            if side.any() and not side.all():
                normals[k], cuts[k], left[k], right[k] = normal, cut, node(), node()
                todo += [(left[k], rows[side]), (right[k], rows[~side])]
                break
    return Tree(np.array(normals), np.array(cuts), np.array(left), np.array(right))


def visits(forest: list[Tree], sizes: list[dict[int, int]], query: np.ndarray, budget: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the shared queue's order until the leaves hold ``budget`` rows, repeats counted."""
    queue = [(0.0, 0, t, 0) for t in range(len(forest))]
    found, rows, n = [], 0, 0
    while queue and rows < budget:
        bound, _, t, k = heapq.heappop(queue)
        tree = forest[t]
        if tree.left[k] < 0:
            if sizes[t].get(k, 0):
                found.append((t, k))
                rows += sizes[t][k]
            continue
        d = float(query @ tree.normals[k] - tree.cuts[k])
        n += 1  # ties: first pushed first
        heapq.heappush(queue, (bound + min(d, 0.0) ** 2, 2 * n, t, int(tree.left[k])))
        heapq.heappush(queue, (bound + max(d, 0.0) ** 2, 2 * n + 1, t, int(tree.right[k])))
    return found


def leaf_blocks(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Leaf to (block, pieces): neighbouring leaves share a block of about BLOCK_ROWS rows, larger leaves are cut into pieces."""
    out, block, rows = {}, 0, 0
    for leaf in sorted(sizes):
        if rows and rows + sizes[leaf] > BLOCK_ROWS:
            block, rows = block + 1, 0
        out[leaf] = (block, max(1, -(-sizes[leaf] // BLOCK_ROWS)))
        rows += sizes[leaf]
    return out


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows with an id whose vector is not null or zero and holds finite numbers only."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return whole_ids(vectors, id_col).where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.9, trees: int = 4, seed: int = 11, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, by Euclidean distance.

    ``queries`` has the columns of ``vectors``; a row is no candidate for the query with
    its id.  ``share`` is the part of the table that the leaves taken hold together,
    repeats over trees counted; recall grows with it.  All vectors must have one length
    (the most frequent; others take no part).  Vectors that are null, zero or hold null
    or non-finite numbers take no part, nor do rows with a null id.  Equal vectors are
    one candidate in the trees; of them only the k+1 smallest ids can be among k nearest,
    so they stand for all.  Ties go to the smaller id; repeated rows count once, and of
    an id's several vectors the least in order of its numbers.  Without
    usable rows the result is empty.  Ids that are no whole numbers raise a TypeError.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    base = usable(vectors, id_col, vector_col)
    kind = dict(base.dtypes)["v"]
    common = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    base = base.where(F.size("v") == common["d"]).groupBy("id").agg(F.min("v").alias("v"))
    asked = usable(queries, id_col, vector_col).where(F.size("v") == common["d"]).groupBy("id").agg(F.min("v").alias("v"))
    shares = -(-asked.count() // QUERIES)
    # equal vectors: a class has one place in each tree and carries its k+1 smallest ids
    first = Window.partitionBy("f1", "f2").orderBy("id")
    key = [F.xxhash64(F.col("v").cast("array<double>")).alias("f1"), F.xxhash64(F.lit(1), F.col("v").cast("array<double>")).alias("f2")]
    ranked = base.select("*", *key).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    classes = scratch.table(ranked.groupBy("f1", "f2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("ids", "v"))
    n = classes.count()
    grown = classes.where(about(sample, n, F.col("ids")[0])).orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).select("v").limit(sample).toArrow()
    points = _matrix(grown["v"])
    draw = np.random.default_rng(seed)
    forest = [grow(points, max(2, min(LEAF_ROWS, n // 64) * len(points) // n), draw) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            for t, tree in enumerate(shared.value):
                leaf = tree.leaves(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf.astype(np.int32)), batch.column(0), batch.column(1)], ["tree", "leaf", "ids", "v"])

    placed = classes.mapInArrow(place, f"tree int, leaf int, ids array<long>, v {kind}")
    counts = classes.mapInArrow(place, f"tree int, leaf int, ids array<long>, v {kind}").groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()  # a row a leaf, bounded by the sample
    sizes = [{r["leaf"]: r["n"] for r in counts if r["tree"] == t} for t in range(trees)]
    layout = [leaf_blocks(x) for x in sizes]
    shared_sizes = spark.sparkContext.broadcast((sizes, layout))

    def route(batches):
        sizes, layout = shared_sizes.value
        for batch in batches:
            x = _matrix(batch.column(1))
            for i in range(len(x)):
                at: dict[tuple[int, int, int], list[int]] = {}
                for t, leaf in visits(shared.value, sizes, x[i], share * n):
                    block, pieces = layout[t][leaf]
                    for p in range(pieces):
                        at.setdefault((t, block, p), []).append(leaf)
                cols = np.array(list(at), np.int32).reshape(-1, 3)
                one = batch.slice(i, 1).take(pa.array(np.zeros(len(cols), np.int64)))
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[:, c]) for c in range(3)), one.column(0), one.column(1), pa.array(list(at.values()), pa.list_(pa.int32()))], ["tree", "block", "piece", "id", "v", "leaves"])

    # a block's vectors meet all queries that visit one of its leaves
    where_leaf = spark.createDataFrame([(t, leaf, *at) for t, x in enumerate(layout) for leaf, at in x.items()], "tree int, leaf int, block int, pieces int")
    pieced = placed.join(F.broadcast(where_leaf), ["tree", "leaf"]).withColumn("piece", F.pmod(F.xxhash64("ids"), F.col("pieces")).cast("int"))
    routed = asked.mapInArrow(route, f"tree int, block int, piece int, id long, v {kind}, leaves array<int>")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left["v"]), _matrix(right["v"])
            ids = right["ids"].combine_chunks()
            starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            centre = x.mean(0)  # distances stay, and numbers far from zero lose no digits
            y = x - centre
            far = (y * y).sum(1)
            known, place_of = np.unique(right["leaf"].to_numpy(), return_inverse=True)
            asked_leaves = left["leaves"].combine_chunks()
            visited = np.zeros((len(q), len(known) + 1), bool)
            spot = np.searchsorted(known, asked_leaves.values.to_numpy())
            spot[known[np.minimum(spot, len(known) - 1)] != asked_leaves.values.to_numpy()] = len(known)
            visited[np.repeat(np.arange(len(q)), np.diff(asked_leaves.offsets.to_numpy())), spot] = True
            for i, qid in enumerate(left["id"].to_numpy()):
                if i % SLICE == 0:  # distances of some queries at a time
                    part = q[i : i + SLICE] - centre
                    size = (part * part).sum(1)
                    slice_ = size[:, None] - 2 * part @ y.T + far
                    slice_[~visited[i : i + SLICE][:, place_of]] = np.inf
                near = slice_[i % SLICE]
                # the k+1 classes nearest by the fast formula, with room for its rounding, then exact distances
                m = min(k + 1, int(np.isfinite(near).sum()))
                if not m:
                    continue
                limit = np.partition(near, m - 1)[m - 1]
                pick = np.flatnonzero(near <= limit + 1e-14 * q.shape[1] * (size[i % SLICE] + far.max()))
                d = np.sqrt(((x[pick] - q[i]) ** 2).sum(1))
                c, s = [], []
                for j, e in zip(pick, d):
                    own = flat[starts[j] : starts[j + 1]]
                    c.append(own[own != qid][:k])
                    s.append(np.full(len(c[-1]), e))
                c, s = np.concatenate(c), np.concatenate(s)
                best = np.lexsort((c, s))[:k]
                out["query_id"].append(np.full(len(best), qid))
                out["vec_id"].append(c[best])
                out["score"].append(s[best])
        return pa.table({name: pa.array(np.concatenate(v) if v else np.zeros(0), kind) for (name, v), kind in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()))})

    # queries are dealt into groups of about QUERIES; each meets its own copy of a block
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, shares))).cast("int")
    routed = routed.withColumn("part", part)
    pieced = pieced.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(1, shares) - 1))))
    where = ["tree", "block", "piece", "part"]
    found = routed.groupBy(*where).cogroup(pieced.select(*where, "leaf", "ids", "v").groupBy(*where)).applyInArrow(rank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
