"""Large groups of near copies: whole results, and no time that grows with all pairs in Python or JVM rows."""

import random
import time

import numpy as np
import pytest

from promolens.graph import components
from promolens.llm import near_dedup
from promolens.llm.near_dedup import near_duplicates


def near_copies(n, words, changed, seed):
    """``n`` texts of ``words`` words; each replaces ``changed`` words that lie at least three apart by words of its own."""
    rnd = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(words)]
    for i in range(n):
        text = list(base)
        for at in rnd.sample(range(words // 3), changed):
            text[3 * at + 1] = f"own{seed}y{i}y{at}"
        yield " ".join(text)


def test_three_thousand_below_and_above(spark):
    # 1 of 44 words: 42 shingles, 3 differ on each side at most: 36 of 48 at least 75 %, below 85; 1 of 110: 102 of 114, above
    below, above = list(near_copies(3000, 44, 1, 1)), list(near_copies(3000, 110, 1, 2))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(below + above)], "doc_id long, text string").repartition(8)
    began = time.time()
    got = {r.doc: r.component for r in near_duplicates(docs, k=3, percent=85).collect()}
    took = time.time() - began

    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    # same place changed: 39 of 45 shingles agree, which links; other places: 36 of 48, which does not
    place = {i: next(j for j, w in enumerate(t.split()) if w.startswith("own")) for i, t in enumerate(below)}
    least = {}
    for i in sorted(place):
        least.setdefault(place[i], i)
    a, b = (sets(below[i]) for i in (0, least[next(p for p in least if p != place[0])]))
    assert 100 * len(a & b) < 85 * len(a | b)
    assert all(got[i] == least[p] for i, p in place.items())
    assert all(got[i] == 3000 for i in range(3000, 6000))
    assert took < 90


def test_repeated_ids_have_the_links_of_all_their_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    docs = spark.createDataFrame([(5, one), (5, two), (5, two), (7, one), (9, two), (3, two), (8, three), (6, ""), (4, None), (None, one)], "doc_id long, text string")
    got = sorted((r.doc, r.n_shingles, r.component) for r in near_duplicates(docs, k=3, percent=85).collect())
    assert got == [(3, 38, 3), (4, 0, 4), (5, 38, 3), (5, 38, 3), (5, 38, 3), (6, 0, 6), (7, 38, 3), (8, 38, 8), (9, 38, 3)]


def test_components_of_paths_loops_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (50, 51), (51, 51), (51, 50), (None, 3)] + [(1000, j) for j in range(2000, 2300)] + [(2299, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {7: 7, 50: 50, 51: 50} | {j: 900 for j in (900, 1000, *range(2000, 2300))}
    assert got == want


@pytest.mark.parametrize("n", [60, 240])
def test_long_texts_below_the_threshold_are_seldom_confirmed(spark, monkeypatch, n):
    # 150 of 3,000 words of each text are its own: sets of 2,998 with a mutual similarity of about 0.73
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(n, 3000, 150, 5))], "doc_id long, text string").repartition(8)
    asked, confirm = [], near_dedup._confirm

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_confirm", counted)
    got = {r.doc: r.component for r in near_duplicates(docs, k=3, percent=85).collect()}
    assert got == {i: i for i in range(n)}
    assert sum(asked) <= 2 * n


def test_wide_sketches_never_hide_a_link():
    draw = np.random.default_rng(3)
    common = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    for own in (0, 50, 200, 400):
        x, y = (np.unique(np.concatenate((common, draw.integers(0, 1 << 63, m).astype(np.uint64)))) for m in (own, 2 * own))
        differ = len(np.setxor1d(x, y))
        sides = [{"wide": [near_dedup.wide_parity(s)]} for s in (x, y)]
        one = np.zeros(1, np.int64)
        assert not near_dedup._far_apart(*sides, one, one, np.array([differ]))[0]
        assert differ == 0 or near_dedup._far_apart(*sides, one, one, np.array([differ // 2]))[0]
