"""Clustering around centroids with bounds that geometric drift tightening keeps sharp.

Each vector carries a lower bound of its distance to every centroid but its own.  When the
centroids move, the bound must be loosened by as much as another centroid may have come
nearer.  The full drift is such an amount; but the vectors of a cluster lie in a sphere
around its old centroid, and in the plane through that point and the move of another
centroid one sees how much of the move can be towards the sphere: often a small part of
it, or nothing.  Vectors whose distance to their own centroid stays below the bound keep
it; the ambiguous ones are compared with all centroids in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .voronoi import LONGEST, matrix

#: Lower bounds give up this share, for the rounding of doubles.
SLACK = 1e-9
#: Doubles hold all sums of squares exactly below this size of a component (for up to 64 components).
EXACT = 1 << 22


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """At [i, j]: at most so much nearer has centroid j come to any point within ``radius[i]`` of the old centroid i.

    Points that are nearer to the new end of the move than to the old one by s lie inside a
    branch of a hyperbola, and that in a cone around the move, seen from its middle, with
    the half angle arccos(s / move).  A sphere outside that cone holds no such point.
    """
    move = new - old
    drift = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    seen = old[:, None, :] - middle[None]
    far = np.sqrt((seen * seen).sum(2))
    safe = np.where((far > 0) & (drift > 0), far * drift, 1.0)
    angle = np.arccos(np.clip(np.einsum("ijk,jk->ij", seen, move) / safe, -1, 1))
    width = np.arcsin(np.minimum(1.0, radius[:, None] / np.where(far > 0, far, 1.0)))
    nearest = np.where(far > radius[:, None], np.clip(angle - width, 0, np.pi / 2), 0.0)
    return drift * np.cos(nearest) * (1 + SLACK)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact; Python integers where doubles are not exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 64:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).astype(np.int64)
    x, c = x.astype(object), c.astype(object)
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centroid beside it."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT and x.shape[1] <= 64:
        return ((x - c) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)) ** 2).sum(1)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding", scanned: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of ``dims`` components, none null or non-finite; a component x becomes
    floor(scale * x).  The k kept vectors whose ``salt:id`` has the smallest SHA-256 are the
    first centroids (fewer, if fewer are kept; a null id has no hash and comes last; of
    equal hashes the vector least in order of its numbers is first).  Each round assigns
    every vector to the nearest centroid, ties to the smaller number, and puts every
    non-empty centroid at its vectors' floor(sum / count); then all are assigned once more.
    Every row is a vector of its own, so repeated rows count as often as they occur, and
    equal centroids leave the larger number empty.  Components are held at the ends of a
    long, and so are distances and inertias.  Without kept vectors the result is empty.

    ``scanned``, if given, gets the number of vectors that each assignment compared with all centroids.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    id_type = dict(kept.dtypes)["id"]
    schema = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "v").select("v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], dtype=object)
    many = len(centroids)
    told = kept.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    number = "long" if told["most"] * told["n"] < 1 << 62 else "decimal(38,0)"

    def assign(state: DataFrame, centroids: np.ndarray, loose: np.ndarray | None) -> DataFrame:
        """The state of each vector after ``centroids`` have moved there, its bound loosened by ``loose`` of its cluster."""
        c = centroids.astype(np.int64)
        apart = np.sqrt(squared(c, c).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        clear = apart.min(1) / 2 * (1 - SLACK)  # nearer than this to a centroid, no other is as near
        shared = spark.sparkContext.broadcast((c, clear, loose))  # k rows

        def step(batches):
            c, clear, loose = shared.value
            for batch in batches:
                x = matrix(batch.column(1), dims)
                n = len(x)
                if loose is None:
                    was, at, lower = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
                    open_ = np.ones(n, bool)
                    d2 = np.zeros(n, object)
                else:
                    was, lower = batch.column(2).to_numpy(), batch.column(4).to_numpy() * (1 - SLACK)
                    at, lower = was.copy(), np.maximum(lower - loose[was], 0.0)
                    d2 = own_squared(x, c[at])
                    d = np.sqrt(d2.astype(np.float64)) * (1 + SLACK)
                    open_ = (d >= lower) & (d >= clear[at])
                    d2 = d2.astype(object)
                rows = np.flatnonzero(open_)
                for i in range(0, len(rows), 4096):
                    some = rows[i : i + 4096]
                    all_ = squared(x[some], c)
                    best = all_.argmin(1)
                    line = np.arange(len(some))
                    at[some], d2[some] = best, all_[line, best]
                    rest = all_.astype(np.float64)
                    rest[line, best] = np.inf
                    lower[some] = np.sqrt(rest.min(1))  # infinite with one centroid
                held = np.minimum(d2, LONGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(lower), pa.array(held), pa.array(open_)], ["id", "v", "cluster", "was", "lower", "distance", "scanned"])

        return state.mapInArrow(step, f"id {id_type}, v array<long>, cluster int, was int, lower double, distance long, scanned boolean")

    state, path, loose = kept, None, None
    totals, counts = np.zeros((many, dims), object), np.zeros(many, object)
    for t in range(rounds + 1):
        old_path = path
        state, path = scratch.put(assign(state, centroids, loose))
        if old_path:
            scratch.drop(old_path)
        if scanned is not None:
            scanned.append(state.where("scanned").count())
        if t == rounds:
            break
        # sums change by the vectors that moved; one row a cluster comes back
        moved = state.where(F.col("cluster") != F.col("was"))
        ends = F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("at"), F.lit(-1).alias("sign")))
        moved = moved.select("v", F.explode(ends).alias("end")).where(F.col("end.at") >= 0)
        for r in moved.groupBy("end.at").agg(F.sum("end.sign").alias("n"), F.array(*[F.sum(F.col("v")[i].cast(number) * F.col("end.sign")) for i in range(dims)]).alias("sums")).collect():
            counts[r["at"]] += r["n"]
            totals[r["at"]] += np.array([int(x) for x in r["sums"]], dtype=object)
        radius = np.zeros(many)
        for r in state.groupBy("cluster").agg(F.max("distance").alias("d")).collect():
            radius[r["cluster"]] = r["d"] ** 0.5 * (1 + SLACK) if r["d"] < LONGEST else np.inf
        old, centroids = centroids, centroids.copy()
        for j in np.flatnonzero(counts > 0):
            centroids[j] = totals[j] // counts[j]
        nearer = loosening(old.astype(np.float64), centroids.astype(np.float64), radius)
        np.fill_diagonal(nearer, 0.0)  # the bound is about the other centroids
        loose = nearer.max(1)
    sums = {r["cluster"]: int(r["sum"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}  # k rows
    name_of = lambda c: hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()
    each = spark.createDataFrame(
        [(j, min(s, LONGEST), min(sum(sums.values()), LONGEST), name_of(centroids[j])) for j, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return state.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op12_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """The rounds one after the other, each over all vectors and all centroids."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
          WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS c, v FROM kept QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, v, min(d2 * {k} + c) AS best FROM (
          SELECT vec_id, kept.v AS v, c, list_sum([(kept.v[i] - c{t}.v[i]) * (kept.v[i] - c{t}.v[i]) FOR i IN range(1, {dims} + 1)])::BIGINT AS d2 FROM kept, c{t}) GROUP BY vec_id, v)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.c, coalesce(m.v, c{t}.v) AS v FROM c{t} LEFT JOIN (
              SELECT c, list(x ORDER BY i) AS v FROM (SELECT best % {k} AS c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x
                FROM a{t}, range(1, {dims} + 1) r(i) GROUP BY ALL) GROUP BY c) m USING (c))""")
    return f"""WITH {', '.join(parts)}
      SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance,
        CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
      FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best % {k}"""


OP12_SQL = op12_sql()
