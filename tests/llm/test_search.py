"""Exact top-k, centroid clustering and ranked lexical search: edge cases, bounds and pruning against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promolens.llm import drift_clusters, lexical, voronoi

VECTORS = "vec_id long, embedding array<double>, score double, rank int, cell int, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0.5, 7, 1, "x") for i, v in vectors], VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(vectors, queries, k, scale=64):
    rows = {}
    for i, v in vectors:
        if i is not None and usable(v):
            whole = [math.floor(scale * x) for x in v]
            rows[i] = min(rows.get(i, whole), whole)
    out = set()
    for q in queries:
        if q in rows:
            found = sorted((-sum(a * b for a, b in zip(rows[q], x)), i) for i, x in rows.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


def top(df, **more):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi.top_products(df, df.where(F.col("vec_id") % 5 == 0), **more).collect()}


ODD = [(1, None), (5, [0.0, 0.0]), (10, [1.0, float("nan")]), (15, [1.0, None]), (20, [float("inf"), 0.0]), (25, [0.5, -0.5]), (25, [0.5, -0.5]), (30, [0.5, -0.5]), (31, [0.5, -0.5]), (35, [-2.0, 3.0]), (35, [-3.0, 3.0]), (None, [9.0, 9.0]), (40, []), (45, [2.0]), (50, [1.0, 2.0, 4.0]), (51, [1e9, -1e9])]


def test_top_k_edges(spark):
    df = table(spark, ODD)
    want = brute_top(ODD, [i for i, _ in ODD if i is not None and i % 5 == 0], 3)
    assert top(df, k=3) == want
    assert top(df, k=50) == brute_top(ODD, [i for i, _ in ODD if i is not None and i % 5 == 0], 50)
    assert top(df.limit(0)) == set()
    huge = [(0, [1e17, 1.0]), (5, [1e17, 2.0]), (6, [-1e17, 1.0]), (7, [3.0, 1.0])]
    assert {(r[2], r[1]) for r in top(table(spark, huge), k=2) if r[0] == 0} == {(5, 1), (7, 2)}
    text = df.where("vec_id is not null").withColumn("vec_id", F.concat(F.lit("n"), "vec_id"))
    assert voronoi.top_products(text, text.where("vec_id = 'n25'"), k=2).count() == 2


def test_top_k_of_clusters_sends_less_than_everything(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(20, 8)) * 10
    vectors = [(i, [float(x) for x in centres[i % 20] + 0.05 * draw.normal(size=8)]) for i in range(3000)]
    df = table(spark, vectors)
    assert top(df, k=4, pivots=40) == brute_top(vectors, [i for i, _ in vectors if i % 5 == 0], 4)


def test_proven_distance_and_groups():
    draw = np.random.default_rng(1)
    x, p = draw.normal(size=(400, 6)), draw.normal(size=(12, 6))
    far = voronoi.apart(x, p)
    near = [(int(c), float(far[i, c]), 1) for i, c in enumerate(far.argmin(1))]
    q = voronoi.apart(draw.normal(size=(50, 6)), p)
    limit = voronoi.within(q, near, 5)
    assert (limit > 0).all() and np.isinf(voronoi.within(q, near[:3], 5)).all()
    points = draw.normal(size=(50, 6))
    limit, real = voronoi.within(voronoi.apart(points, p), near, 5), np.sort(voronoi.apart(points, x), axis=1)[:, 4]
    assert (real <= limit).all()
    groups = voronoi.group_cells({c: 9_000 for c in range(12)}, voronoi.apart(p, p))
    assert sorted(sum(groups, [])) == list(range(12)) and all(len(g) == 1 for g in groups)


def brute_clusters(vectors, k=40, rounds=5, dims=64):
    kept = [(i, np.array([math.floor(256 * x) for x in v], dtype=object)) for i, v in vectors if usable(v) and len(v) == dims]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), list(r[1])))[:k]
    c = [v for _, v in start]
    for t in range(rounds + 1):
        at = [min((int(((v - x) ** 2).sum()), j) for j, x in enumerate(c)) for _, v in kept]
        if t < rounds:
            c = [sum((v for (_, v), (_, j) in zip(kept, at) if j == n), 0 * x) // (m or 1) if (m := sum(j == n for _, j in at)) else x for n, x in enumerate(c)]
    sums = Counter()
    for d, j in at:
        sums[j] += d
    name = [hashlib.sha256(",".join(str(int(x)) for x in v).encode()).hexdigest() for v in c]
    return sorted((i is None, i or 0, j, d, sums[j], sum(sums.values()), name[j]) for (i, _), (d, j) in zip(kept, at))


def clusters(df, **more):
    return sorted((r.vec_id is None, r.vec_id or 0, r["cluster"], r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in drift_clusters.cluster(df, **more).collect())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_cluster_edges(spark, k):
    draw = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in draw.normal(size=3) + 4 * (i % 4)]) for i in range(60)] + [(60, [1.0] * 3)] * 5 + [(61, [1.0] * 3), (None, [2.0] * 3), (62, None), (63, [1.0, None, 2.0]), (64, [1.0, float("nan"), 2.0]), (65, [1.0]), (66, []), (67, [0.0] * 3)]
    assert clusters(table(spark, vectors), k=k, dims=3) == brute_clusters(vectors, k, dims=3)
    assert clusters(table(spark, vectors).limit(0), k=k, dims=3) == []


def test_cluster_with_huge_components(spark):
    vectors = [(i, [(-1.0) ** i * 1e6 * (i % 7), 1e5 * i]) for i in range(40)]
    assert clusters(table(spark, vectors), k=4, dims=2) == brute_clusters(vectors, 4, dims=2)


def test_loosening_holds_and_is_less_than_the_drift():
    draw = np.random.default_rng(2)
    for dims in (2, 5):
        old = draw.normal(size=(6, dims)) * 5
        new = old + draw.normal(size=(6, dims))
        radius = np.abs(draw.normal(size=6))
        loose = drift_clusters.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loose <= drift * 1.001).all() and (loose < 0.9 * drift).any()
        for i in range(6):
            x = draw.normal(size=(4000, dims))
            x = old[i] + radius[i] * x / np.linalg.norm(x, axis=1)[:, None] * draw.random((4000, 1)) ** (1 / dims)
            nearer = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (nearer.max(0) <= loose[i] + 1e-9).all()


def test_bounds_spare_full_comparisons(spark):
    draw = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in draw.normal(size=4) + 30 * np.eye(4)[i % 4]]) for i in range(400)]
    scanned = []
    drift_clusters.cluster(table(spark, vectors), k=4, dims=4, scanned=scanned)
    assert scanned[0] == 400 and scanned[-1] < 40


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(FOLD))
    bags = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in sorted({(i, t) for i, t in items if i is not None and t}):
        scored = []
        for i, b in bags:
            if b:
                m, tf = 75 + 25 * len(b) * n // total, Counter(b)
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in split(text) if tf[t])
                if s > 0:
                    scored.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, k):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(docs, items, k).collect()), key=str)


def test_lexical_edges(spark):
    docs = [(3, "Alpha beta gamma"), (1, "alpha-beta\x00GAMMA"), (2, None), (4, ""), (5, "  ..  "), (6, "Ünïcode ünïcode alpha x9"), (7, "alpha " * 5000), (8, "beta"), (8, "beta"), (None, "beta gamma"), (9, "zeta"), (10, "　alpha"), (11, "delta Σ")]
    items = [(0, "alpha alpha beta"), (1, "nothing here"), (2, None), (3, ""), (4, "Ünïcode ÜNÏCODE"), (5, "beta gamma beta"), (5, "beta gamma beta"), (None, "alpha"), (6, "...")]
    d = spark.createDataFrame([(*r, 1, 2.0, "t") for r in docs], "doc_id long, text string, n int, score double, terms string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for k in (1, 2, 50):
        assert ranked(d, i, k) == brute_rank(docs, items, k)
    assert ranked(d.limit(0), i, 3) == [] and ranked(d, i.limit(0), 3) == []
    assert ranked(d.where("text is null"), i, 3) == []


def test_lexical_blocks_and_batches(spark, monkeypatch):
    draw = np.random.default_rng(7)
    word = [f"w{int(x)}" for x in draw.zipf(1.3, 60_000) % 900]
    docs = [(n, " ".join(word[n * 37 % 50_000 : n * 37 % 50_000 + int(draw.integers(0, 60))])) for n in range(1500)]
    items = [(n, " ".join(word[n * 91 : n * 91 + 12])) for n in range(60)]
    monkeypatch.setattr(lexical, "ITEMS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5) == brute_rank(docs, items, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dual_tree_scores_few_pairs(monkeypatch):
    monkeypatch.setattr(lexical, "DOC_LEAF", 16)
    draw = np.random.default_rng(8)
    docs = [sorted(set((draw.integers(0, 40, 12) + 50 * (n % 30)).tolist())) for n in range(3000)]
    asked = [docs[n][:8] for n in range(40)]
    sparse = lambda rows, v: lexical.Sparse(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64), np.array(sum(rows, [])), np.full(sum(map(len, rows)), v, np.int64))
    data, items = sparse(docs, 1000), sparse(asked, 7)
    best = lexical.Best(40, 5, np.zeros(40, np.int64))
    tree = lexical.hierarchy(items, np.arange(40), 2, np.ones(1600))
    scored = lexical.search(data, items, tree, 1600, best)
    for i, own in enumerate(asked):
        score = np.array([7000 * len(set(own) & set(d)) for d in docs])
        want = np.lexsort((np.arange(3000), -score))[:5]
        assert best.place[i].tolist() == want.tolist() and best.score[i].tolist() == score[want].tolist()
    assert scored < 40 * 3000 / 4
