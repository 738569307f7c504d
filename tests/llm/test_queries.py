"""The registered corpus queries on the smallest tables, against SQL or brute force."""

import collections
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from promolens.llm import mixing
from promolens.llm import queries as llm
from promolens.llm.near_dedup import banding, shingle_sets, sketches
from tests.conftest import SF, same_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(sql):
    return duckdb.sql(sql).fetchall()


@pytest.fixture(scope="module")
def texts():
    return rows(f"SELECT doc_id, text FROM '{SF}/documents.parquet'")


def groups(texts, k, percent):
    def shingles(t):
        w = WORD.findall((t or "").translate(FOLD))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets, parent = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            u, v = find(a), find(b)
            parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_rows(llm.queries()[name](spark, SF), duck.sql(llm.oracle_sql()[name]))


def test_op1_finds_copies(spark, texts):
    items = [(i, WORD.findall(t.lower())) for i, t in rows(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'")]
    want = {(d, i) for d, t in texts for i, w in items if " " + " ".join(w) + " " in " " + " ".join(WORD.findall((t or "").lower())) + " "}
    got = {(r.doc_id, r.item_id) for r in llm.queries()["op1_decontaminate"](spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_op5_equals_brute_force(spark, texts):
    seen = collections.Counter()
    for _, t in texts:
        b = (t or "").encode()
        seen.update(b[p : p + 200] for p in range(len(b) - 199))
    want = set()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want.add((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert {tuple(r) for r in llm.queries()["op5_suffix_dedup"](spark, SF).collect()} == want


def test_op7_equals_brute_force(spark, texts):
    want = {(i, n, c, i == c) for i, (n, c) in groups(texts, 3, 85).items()}
    assert {tuple(r) for r in llm.queries()["op7_minhash_near_dedup"](spark, SF).collect()} == want


def test_sketch_fills_and_estimates():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 900).astype(np.uint64))
    few = a[:3]
    s = sketches(np.concatenate((a, a[:800], few)), np.array([len(a), 800, 3]))
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 800 / len(a)) < 0.1


def test_bands_miss_one_pair_in_a_hundred_million():
    for percent in (80, 85, 90):
        r, b = banding(percent)
        assert (1 - (percent / 100) ** r) ** b <= 1e-8


def test_shingles_of_short_texts():
    data = b"one twoa b c d"
    flat, counts = shingle_sets(np.frombuffer(data, np.uint8), np.array([0, 7, 14, 14]), 3)
    assert counts.tolist() == [1, 2, 0] and len(set(flat.tolist())) == 3


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.75), ("op8_toxicity", "toxic", 0.75)])
def test_classifier_queries(spark, name, label, least):
    # right on all labelled rows, and on those that the fit did not see
    out = llm.queries()[name](spark, SF).collect()
    want = dict(rows(f"SELECT doc_id, {label} FROM '{SF}/labels.parquet'"))
    assert len(out) == len({r.doc_id for r in out}) and all(0 <= r.score <= 1 for r in out)
    told = [r for r in out if r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in told) >= least * len(told)
    held = [r for r in told if r.held_out]
    assert held and sum(r.predicted == want[r.doc_id] for r in held) >= least * len(held)


def test_op4_recall(spark):
    vectors = dict(rows(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'"))
    ids, x = np.array(list(vectors)), np.array(list(vectors.values()), float)
    got = collections.defaultdict(dict)
    for r in llm.queries()["op4_nearest_neighbours"](spark, SF).collect():
        got[r.query_id][r.vec_id] = r.score
    hit = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((x - np.array(vectors[q], float)) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit += len(set(best.tolist()) & set(got[q]))
        assert all(abs(d[ids == i][0] - s) < 1e-12 for i, s in got[q].items())
    assert hit >= 9 * len(got)


def test_op3_rows_are_in_training_order(spark):
    got = llm.queries()["op3_mix_sources"](spark, SF).collect()
    mixed = mixing.mix_documents(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id").collect()
    taken = [r.doc_id for r in got if r.taken]
    assert taken == list(dict.fromkeys(r.doc_id for r in mixed)) and all(r.taken == 0 for r in got[len(taken) :])


def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "mixing"]
    line = dict((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, docs, SF).collect())
    assert len(line) == len(texts)
    near = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {i for i, (_, c) in groups(texts, 5, 80).items() if i == c}
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < docs.count() - clean.count() < 0.2 * docs.count()
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    toxic = {d for d, t in rows(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'") if t}
    assert kept.columns == docs.columns and not toxic & {r.doc_id for r in kept.collect()}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert got and [r.position for r in got] == sorted(r.position for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        x = by[r.source]
        x[0] += r.taken
        x[1], x[2] = r.target, max(x[2], r.size)
    assert all(abs(t - g) <= most for t, g, most in by.values())


def test_op8_finds_held_out_toxic_texts(spark):
    """Toxic labels of texts without any insult contradict the texts; of the others all held-out ones are found."""
    larger = SF.replace("sf0.001", "sf0.01")
    insult = re.compile(r"\b(trash|scum|worthless|idiot|clown|loser|disgusting|pathetic|moron|stupid)\b", re.I)
    told = {i: (toxic, bool(insult.search(t or ""))) for i, t, toxic in rows(f"SELECT doc_id, text, toxic FROM '{larger}/documents.parquet' JOIN '{larger}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL")}
    held = [(r.predicted, *told[r.doc_id]) for r in llm.queries()["op8_toxicity"](spark, larger).collect() if r.held_out and r.doc_id in told]
    toxic, clean = [p for p, y, plain in held if y and plain], [p for p, y, _ in held if not y]
    assert len(toxic) >= 5 and all(toxic)
    assert sum(clean) <= 0.02 * len(clean) + 1
