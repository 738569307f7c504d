"""Exact top-k search by inner product, as a Voronoi join of queries and data.

The largest inner products are the smallest distances once every vector has one more
component that brings it to the length of the longest, and every query is stretched to
that length.  There queries and data are grouped by their nearest pivot.  Summaries of
the data cells (their vectors nearest to the pivot) prove for each query a distance
within which its k nearest lie; the largest of a query cell tells which ring of which
data cell the cell can need, and only those rows are sent to its group.  There each
query's own rings are searched, with exact integer scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, about

#: Pivots, drawn from a sample of the rows; any choice gives the same result.
PIVOTS = 256
#: Queries of one group, data rows of one piece of a group, and queries scored at once.
QUERIES, PIECE, SLICE = 16_384, 4_096, 128
#: Proven distances are widened by this share, for the rounding of doubles.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component, of rows with an id whose components are all finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def matrix(column, dims: int) -> np.ndarray:
    """The int64 rows of an Arrow list column, filled up with zeros to ``dims``."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    out = np.zeros((len(column), dims), np.int64)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of rows: in doubles where these are exact, else in Python integers, held at the ends of a long."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return np.clip(x.astype(object) @ y.astype(object).T, -LONGEST - 1, LONGEST).astype(np.int64)


def lift(x: np.ndarray, length2: float) -> np.ndarray:
    """Rows with the further component that brings their squared length to ``length2``."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(length2 - (x * x).sum(1), 0.0))
    return np.column_stack([x, rest])


def stretch(q: np.ndarray, length2: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries stretched to that length, the factor of each); a zero query stays."""
    q = q.astype(np.float64)
    size = np.sqrt((q * q).sum(1))
    by = np.where(size > 0, np.sqrt(length2) / np.where(size > 0, size, 1.0), 1.0)
    return np.column_stack([q * by[:, None], np.zeros(len(q))]), by


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)
    return np.sqrt(np.maximum(d, 0.0))


def within(far: np.ndarray, near: list[tuple[int, float, int]], k: int) -> np.ndarray:
    """For each query, a distance within which at least ``k`` data rows lie; infinite if the summaries hold fewer.

    ``far`` has its distances to all pivots, ``near`` the (cell, distance to the pivot,
    rows) of the data nearest to each pivot.
    """
    if sum(x[2] for x in near) < k:
        return np.full(len(far), np.inf)
    cell, d, rows = (np.array(x) for x in zip(*near))
    out = np.empty(len(far))
    for i in range(0, len(far), SLICE):
        reach = far[i : i + SLICE][:, cell] + d
        order = np.argsort(reach, axis=1)
        at = (np.cumsum(rows[order], axis=1) >= k).argmax(1)
        some = np.arange(len(reach))
        out[i : i + SLICE] = reach[some, order[some, at]]
    return out


def group_cells(asked: dict[int, int], between: np.ndarray) -> list[list[int]]:
    """Query cells in groups of at most QUERIES rows (or one larger cell), each next to the last one taken."""
    left, groups, rows, last = set(asked), [], 0, None
    while left:
        c = min(left) if last is None else min(left, key=lambda x: (between[last, x], x))
        left.remove(c)
        if not groups or rows + asked[c] > QUERIES:
            groups.append([])
            rows = 0
        groups[-1].append(c)
        rows, last = rows + asked[c], c
    return groups


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner product with each query, all if there are fewer.

    Components are floor(scale * x).  ``queries`` has the columns of ``vectors``; a row is
    no candidate for the query with its id.  Ties go to the smaller id.  Rows whose vector
    is null or holds null or non-finite numbers take no part, nor do rows with a null id;
    zero and empty vectors do.  Of vectors of several lengths the shorter one counts as
    filled up with zeros.  Repeated rows count once; of an id's several vectors the least
    in order of its numbers.  Ids may have any type that can be ordered.  Components and
    scores beyond a long are held at its ends.  Equal vectors share a place in their cell
    and carry their k+1 smallest ids, of which alone k can be asked for.  Without usable
    rows the result is empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = vectors.sparkSession
    scratch = Scratch(spark, "voronoi")
    once = lambda df: whole_vectors(df, scale, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    base, asked = once(vectors), once(queries)
    id_type = dict(base.dtypes)["id"]
    schema = f"query_id {id_type}, rank int, vec_id {id_type}, score long"
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    told = whole_vectors(vectors, scale, id_col, vector_col).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(norm2).alias("most")).first()
    longest = whole_vectors(queries, scale, id_col, vector_col).agg(F.max(F.size("v")).alias("dims")).first()["dims"]
    if not told["n"] or longest is None:
        return spark.createDataFrame([], schema)
    dims, length2 = max(told["dims"], longest, 1), max(told["most"], 1.0) * (1 + 1e-12)
    wanted = max(1, min(pivots, told["n"] // 32))
    drawn = base.where(about(wanted, told["n"], F.col("id"))).orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).toArrow()
    shared = spark.sparkContext.broadcast(np.unique(lift(matrix(drawn["v"], dims), length2), axis=0))  # bounded by PIVOTS
    between = apart(shared.value, shared.value)
    apart_by = between.tolist()

    def place(batches):
        for batch in batches:
            x = lift(matrix(batch.column(1), dims), length2)
            far = apart(x, shared.value)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), batch.column(0), batch.column(1)], ["cell", "far", "ids", "v"])

    key = [F.xxhash64("v").alias("f1"), F.xxhash64(F.lit(1), "v").alias("f2")]
    first = Window.partitionBy("f1", "f2").orderBy("id")
    ranked = base.select("*", *key).withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    classes = ranked.groupBy("f1", "f2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select("ids", "v")
    placed = scratch.table(classes.mapInArrow(place, f"cell int, far double, ids array<{id_type}>, v array<long>"))
    cells = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS rows
    nearest = Window.partitionBy("cell").orderBy("far")
    summary = placed.select("cell", "far", F.size("ids").alias("rows")).withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    near = spark.sparkContext.broadcast([(r["cell"], r["far"], r["rows"]) for r in summary.collect()])  # at most PIVOTS * (k + 1) rows

    def ask(batches):
        for batch in batches:
            q, _ = stretch(matrix(batch.column(1), dims), length2)
            far = apart(q, shared.value)
            cell = far.argmin(1)
            limit = within(far, near.value, k + 1) * (1 + SLACK)  # one of them may be the query's own row
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(q)), cell]), pa.array(limit), batch.column(0), batch.column(1)], ["cell", "far", "limit", "id", "v"])

    asked = scratch.table(asked.mapInArrow(ask, f"cell int, far double, limit double, id {id_type}, v array<long>"))
    reach = {r["cell"]: r for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.col("far") + F.col("limit")).alias("reach")).collect()}  # at most PIVOTS rows
    homes, routes = [], []
    for g, members in enumerate(group_cells({c: r["n"] for c, r in reach.items()}, between)):
        ring = {}  # data cell to the ring of it that a member can need
        for c in members:
            for j in cells:
                # the next bound is no looser than the pivots' distance less the reach of any query of the cell
                low, high = apart_by[c][j] - reach[c]["reach"], apart_by[c][j] + reach[c]["reach"]
                ring[j] = (min(low, ring[j][0]), max(high, ring[j][1])) if j in ring else (low, high)
        parts = -(-sum(reach[c]["n"] for c in members) // QUERIES)
        pieces = -(-sum(cells[j] for j in ring) // PIECE)
        homes += [(c, g, parts, pieces) for c in members]
        routes += [(j, g, parts, pieces, low * (1 - SLACK) - SLACK * length2**0.5, high * (1 + SLACK)) for j, (low, high) in ring.items()]
    home = spark.createDataFrame(homes, "cell int, grp int, parts int, pieces int")
    route = spark.createDataFrame(routes, "cell int, grp int, parts int, pieces int, low double, high double")  # at most PIVOTS^2 rows
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = asked.join(F.broadcast(home), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("piece", deal("pieces"))
    needed = placed.join(F.broadcast(route), "cell").where(F.col("far").between(F.col("low"), F.col("high")))
    needed = needed.withColumn("piece", F.pmod(F.xxhash64("ids"), F.col("pieces")).cast("int")).withColumn("part", deal("parts"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.schema([("query_id", left.schema.field("id").type), ("vec_id", left.schema.field("id").type), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return empty.empty_table()
        left = left.sort_by("cell")
        right = right.sort_by([("cell", "ascending"), ("far", "ascending")])
        q, x = matrix(left["v"], dims), matrix(right["v"], dims)
        ids = right["ids"].combine_chunks()
        first, flat = ids.offsets.to_numpy(), ids.values
        cell, far, limit = (t.to_numpy() for t in (right["cell"], right["far"], left["limit"]))
        sphere, by = stretch(q, length2)
        to_pivots = apart(sphere, shared.value)
        own = left["cell"].to_numpy()
        who, what, score = [], [], []
        for i in range(0, len(q), SLICE):
            d, r, home = to_pivots[i : i + SLICE], limit[i : i + SLICE, None], own[i : i + SLICE]
            # a cell whose border with the query's own lies beyond the limit holds none of its nearest
            gap = between[home]
            border = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / np.where(gap > 0, 2 * gap, np.inf)
            open_ = border <= r * (1 + SLACK) + SLACK * length2**0.5
            low = np.where(open_, d - r, np.inf).min(0) - SLACK * length2**0.5
            high = np.where(open_, d + r, -np.inf).max(0) + SLACK * length2**0.5
            rows = np.flatnonzero((far >= low[cell]) & (far <= high[cell]))
            if not len(rows):
                continue
            made = products(q[i : i + SLICE], x[rows])
            with np.errstate(invalid="ignore"):
                least = (2 * length2 - r[:, 0] ** 2) / (2 * by[i : i + SLICE])  # the score at the limit
            least -= SLACK * (np.abs(least) + length2 / by[i : i + SLICE])
            zero = ~q[i : i + SLICE].any(1)
            for s in range(len(made)):
                line = made[s]
                m = min(k + 1, len(line))
                bound = np.partition(line, len(line) - m)[len(line) - m]
                if np.isfinite(least[s]) and not zero[s]:
                    bound = max(bound, least[s])
                pick = np.flatnonzero(line >= bound)
                size = first[rows[pick] + 1] - first[rows[pick]]
                at = np.repeat(first[rows[pick]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                who.append(np.full(len(at), i + s))
                what.append(at)
                score.append(np.repeat(line[pick], size))
        if not who:
            return empty.empty_table()
        who, what, score = np.concatenate(who), np.concatenate(what), np.concatenate(score)
        found = pa.table({"query_id": left["id"].combine_chunks().take(pa.array(who)), "vec_id": flat.take(pa.array(what)), "score": score, "q": who})
        found = found.filter(pc.not_equal(found["query_id"], found["vec_id"])).sort_by([("q", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        line = found["q"].to_numpy()
        start = np.flatnonzero(np.diff(line, prepend=-1))
        rank = np.arange(len(line)) - np.repeat(start, np.diff(np.append(start, len(line))))
        return found.filter(pa.array(rank < k)).select(["query_id", "vec_id", "score"])

    where = ["grp", "part", "piece"]
    found = sent.select(*where, "cell", "limit", "id", "v").groupBy(*where).cogroup(needed.select(*where, "cell", "far", "ids", "v").groupBy(*where))
    found = found.applyInArrow(solve, f"query_id {id_type}, vec_id {id_type}, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_products(vectors, vectors.where(F.col("vec_id") % 20 == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
