"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promolens.llm import decontaminate, html_extract, line_dedup, mixing, near_dedup, neighbours, quality, sentence_dedup, suffix_dedup, toxicity

LINE = "this is a line that is long enough to count as a shared one"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "one", "b"), (5, "one two", "b"), (None, LINE, "b"), (None, None, None),
    (6, LINE, "c"), (7, f"{LINE}\nx", "c"), (8, f"  {LINE.upper()}  ", "c"), (9, f"y\n{LINE}\n{LINE}", "c"), (10, LINE, "c"), (10, LINE, "c"),
    (11, LONG, "d"), (12, LONG + " tail", "d"), (13, "é" * 300, None),
]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, source string, doc string, n long")
    # names that operators use themselves
    return df.withColumns({c: F.lit("clash") for c in ("h1", "pos", "start", "score", "n_lines", "taken", "band", "words", "kh", "component")})


def empty(spark):
    return docs(spark).limit(0)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")


def test_line_dedup(spark):
    out = line_dedup.dedup_lines(docs(spark))
    assert out.count() == len(ROWS) and "clash" in {r.doc for r in out.collect()}
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_dropped, r.kept_text))
    # five documents (6 to 10) hold the line; only the largest id keeps it, in both of its rows
    assert by[6] == [(1, 1, "")] and by[7] == [(2, 1, "x")] and by[8] == [(1, 1, "")] and by[9] == [(3, 2, "y")]
    assert by[10] == [(1, 0, LINE)] * 2
    assert by[1] == [(1, 0, "")] and by[2] == [(1, 0, "")] and (1, 0, LINE) in by[None]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_compact_and_anti_join(spark):
    index = line_dedup.LineRuns(spark, fan_out=2)
    batch = lambda *ks: spark.createDataFrame([(k, k, d) for k, d in ks], "h1 long, h2 long, doc long")
    index.add(batch((1, 1), (2, 1), (2, 1)))
    assert [r.h1 for r in index.unseen(batch((2, 5), (3, 5))).collect()] == [3]
    index.add(batch((2, 5), (3, 5)))
    index.add(batch((3, 9)))
    assert len(index.runs()) == 2
    assert {r.h1: (r.n_docs, r.last_doc) for r in index.keys().collect()} == {1: (1, 1), 2: (2, 5), 3: (2, 9)}


def test_mixing(spark):
    plan = mixing.plan_mix(docs(spark)).collect()
    assert len(plan) == len(ROWS)
    for r in plan:
        assert r.size * len(r.epochs) <= 3 * r.size
    out = mixing.mix_documents(docs(spark))
    got = out.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and all(0 <= r.position <= 1 for r in got)
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_mix_keeps_rows_with_null_and_repeated_ids(spark):
    rows = [(None, "null id one", "a"), (None, "null id number two", "a"), (1, "same id", "a"), (1, "same id but longer", "a"), (1, "same id", "a"), (2, "plain words here", "b"), (None, "null id three", None), (3, None, "b")]
    df = docs(spark, rows)
    want = [(str(r.source), r.doc, r.size, e) for r in mixing.plan_mix(df).collect() for e in r.epochs]
    got = mixing.mix_documents(df).collect()
    assert sorted(((str(r.source), r.doc_id, r.size, r.epoch) for r in got), key=str) == sorted(want, key=str)
    assert {r.text for r in got if r.doc_id is None} == {t for i, t, _ in rows if i is None}
    assert all(r.taken == r.size == len(r.text.split()) for r in got)


@pytest.mark.parametrize("sizes", [[100, 1, 1], [1, 100, 1], [5, 5, 5, 5, 5], [0, 0, 7], [1000, 3, 900, 2, 40, 60, 1], [0, 0]])
def test_targets_by_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    left, target, total = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while left:
        w = sum(weights[i] for i in left)
        over = {i for i in left if total * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in left:
                target[i] = total * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        total -= sum(target[i] for i in over)
        left -= over
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(target)


def test_near_dedup(spark):
    rows = near_dedup.near_duplicates(docs(spark), k=3, percent=85).collect()
    by = {r.doc: (r.n_shingles, r.component) for r in rows}
    assert None not in by and by[1] == (0, 1) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 5)
    assert by[8][1] == 6 and by[10][1] == 6 and by[12][1] == 11 and by[11][0] == 29_998
    kept = near_dedup.drop_near_duplicates(docs(spark), k=3, percent=85)
    assert set(kept.columns) == set(docs(spark).columns) and kept.where("doc_id = 12").count() == 0 and kept.where("doc_id IS NULL").count() == 2
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_sentence_dedup(spark):
    text = "A first sentence that is quite long here. A second sentence that is long as well. A third sentence closes it."
    rows = [(1, "Intro. " + text, "a"), (2, text + " Own end.", "a"), (3, None, "b"), (4, "", "b"), (None, text, "c"), (5, LONG, "c")]
    out = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in sentence_dedup.drop_repeated_sentences(docs(spark, rows)).collect()}
    assert out[1][1:] == (0, "Intro. " + text) and out[2] == (4, 3, "Own end.") and out[3] == (0, 0, "") and out[4] == (0, 0, "")
    assert out[None][2] == text and out[5][1] == 0
    assert sentence_dedup.drop_repeated_sentences(empty(spark)).count() == 0


def test_suffix_dedup(spark):
    a, b = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(120)), "".join(chr(98 + i * 11 % 25) + str(i * 3) for i in range(120))
    rows = [(1, a + b, "x"), (2, "head " + a, "x"), (3, b[10:] + " tail" + "é" * 40, "x"), (4, None, "y"), (5, "q" * 1000, "y"), (6, a, "z"), (6, a, "z"), (None, a, "z"), (7, b[:199], "z")]
    got = {(r.doc_id, r.n_removed) for r in suffix_dedup.drop_repeated_bytes(docs(spark, rows)).collect()}
    texts = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - 199):
                seen[t[p : p + 200]] = seen.get(t[p : p + 200], 0) + 1
    want = set()
    for i, t in texts:
        gone = set()
        if i is not None:
            for p in range(len(t) - 199):
                if seen[t[p : p + 200]] > 1:
                    gone.update(range(p, p + 200))
        want.add((i, len(gone)))
    assert got == want
    assert suffix_dedup.drop_repeated_bytes(empty(spark)).count() == 0


def test_suffix_levels_grow_geometrically(spark):
    index = suffix_dedup.SuffixLevels(spark, 200)
    body = bytes(range(200)) * 2
    batch = lambda i: spark.createDataFrame([(1, i, 0, 5, bytearray(body[: 205] if i else body[:205]))], suffix_dedup.LEVEL)
    sizes = []
    for i in range(4):
        found = index.add(batch(i))
        sizes.append(sorted(index.levels))
        assert (found.count() > 0) == (i > 0)
    assert sizes == [[0], [1], [0, 1], [2]]


def test_hot_kgrams_take_the_hashed_path(spark, monkeypatch):
    a, tails = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(150)), ["xx", "yy", "zzz"]
    rows = [(i, a[:330] + t * 80, "x") for i, t in enumerate(tails)]
    plain = {(r.doc_id, r.n_removed) for r in suffix_dedup.drop_repeated_bytes(docs(spark, rows)).collect()}
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 0)
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.drop_repeated_bytes(docs(spark, rows)).collect()} == plain
    monkeypatch.setattr(suffix_dedup, "MOST_CLASSES", 1)
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.drop_repeated_bytes(docs(spark, rows)).collect()} == plain
    assert all(n > 0 for _, n in plain)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, module):
    name = "quality" if module is quality else "toxic"
    rows = [(i, (f"nasty idiot text number {i} " if i % 2 else f"calm and friendly text {i} ") * (1 + i % 4), "s") for i in range(80)] + [(100, None, "s"), (101, "", "s"), (102, LONG, "s"), (None, "x", None)]
    df = docs(spark, rows)
    model = module.train(df, labels(spark, 80), name)
    out = module.score_documents(df, model)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == set(df.columns) | {"predicted"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 80)
    assert right >= 76
    assert module.score_documents(empty(spark), model).count() == 0
    assert max(r.score for r in module.score_documents(df, module.train(df, labels(spark, 0), name)).collect()) < 1e-6


def test_decontaminate(spark):
    item = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew potent jasmine tea in copper kettles near the frozen harbour"
    other = "several merchants argue loudly about silver coins and broken lanterns before the gates of an ancient walled city open at dawn"
    changed = item.replace("quick", "swift").replace("quietly", "slowly").replace("copper", "iron")
    filler = " ".join(f"filler{i % 97} common words in here" for i in range(400))
    rows = [(1, f"{filler} {item} {filler}", "s"), (2, f"{filler} {changed}", "s"), (3, filler, "s"), (4, None, "s"), (5, "", "s"), (None, item, "s"), (6, LONG + " " + other, "s"), (7, item, "s"), (7, item, "s")]
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (None, "x"), (4, "")], "item_id long, text string")
    got = {(r.doc, r.item) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (6, 2), (7, 1)}
    kept = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, None} and kept.columns == docs(spark, rows).columns
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_lcs():
    masks = lambda t: {w: sum(1 << i for i, x in enumerate(t) if x == w) for w in set(t)}
    assert decontaminate.lcs(masks("abcde"), 5, "xaycz") == 2
    assert decontaminate.lcs(masks("a" * 70), 70, "a" * 65) == 65
    assert decontaminate.lcs(masks("abc"), 3, "") == 0


def test_neighbours(spark):
    nan = float("nan")
    vectors = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [nan, 1.0, 1.0]), (63, [1.0, None, 1.0]), (64, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 3.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 10 = 0"), share=9.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    good = {i: v for i, v in vectors if i is not None and i < 60}
    assert set(got) == set(range(0, 60, 10))
    for q, found in got.items():
        want = sorted((sum((a - b) ** 2 for a, b in zip(good[q], good[i])) ** 0.5, i) for i in good if i != q)[:10]
        assert [(s, i) for _, s, i in sorted(found)] == want and [r for r, _, _ in sorted(found)] == list(range(1, 11))
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_html(spark):
    page = """<html><head><title>t</title><script>x="<p>no</p>"</script></head><body><nav><a href="/">Home</a></nav><article><h1>Head &amp; line</h1><p>First   <b>bold</b>
    text here.<p>Second&nbsp;one <br> goes on.<aside>Buy</aside></article><div class="comments"><p>I say something in a comment.</p></div><form><label>Mail</label></form><footer>&copy; us</footer>"""
    rows = [(1, "u", page, "c"), (2, None, None, "c"), (3, "u", "", "c"), (None, "u", "<p>no closing", "c"), (4, "u", "<!-- never ends", "c"), (4, "u", "<div " + 'a="' * 2000, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_main_text(df, html_extract.train(df)).collect()}
    assert out[1, "u"] == ("Head & line\nFirst bold text here.\nSecond one goes on.", len("Head & line\nFirst bold text here.\nSecond one goes on."))
    assert out[2, None] == ("", 0) and out[3, "u"] == ("", 0)
    assert html_extract.extract_main_text(df.limit(0), html_extract.train()).count() == 0


def test_html_held_out_accuracy():
    model = html_extract.fit(html_extract.labelled_pages(300))
    pages = html_extract.labelled_pages(100, seed=77)
    wrong = sum(a != b for page, y in pages for a, b in zip(model.labels(page), y))
    assert wrong <= 0.01 * sum(len(y) for _, y in pages)



@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables: the edge rows, no labels, one item."""
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, LINE), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages_on_edge_rows(spark, tables):
    df = docs(spark)
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, df, tables) for name, stage in corpus_pipeline.STAGES}
    assert all(out[name].columns == df.columns for name in list(stages)[:-1])
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert key(out["toxicity"].collect()) == key(df.collect())
    lines = {(r.doc_id, r.text) for r in out["line dedup"].collect()}
    assert out["line dedup"].count() == len(ROWS) and {(1, None), (2, ""), (6, ""), (10, LINE), (None, LINE), (None, None)} <= lines
    near = [r.doc_id for r in out["near-dedup"].collect()]
    assert near.count(None) == 2 and {1, 2, 3, 4, 5, 6, 11, 13} <= set(near) and not {8, 10, 12} & set(near)
    clean = [r.doc_id for r in out["decontamination"].collect()]
    assert clean.count(None) == 2 and {1, 2, 3, 4, 5, 11, 12, 13} <= set(clean) and not {6, 7, 8, 9, 10} & set(clean)
    mixed = out["mixing"].collect()
    assert all(r.taken == r.size == len(r.text.split()) > 0 for r in mixed)
    for name, stage in stages.items():
        assert stage(spark, df.limit(0), tables).count() == 0, name


def test_held_out_is_never_null(spark, tables):
    for query in (quality.op2_quality, toxicity.op8_toxicity):
        got = query(spark, tables).collect()
        assert len(got) == len(ROWS) and {r.held_out for r in got if r.doc_id is None} == {False}


def test_ids_must_be_whole_numbers(spark):
    df = spark.createDataFrame([("a", "one two three", [1.0])], "doc_id string, text string, embedding array<double>")
    item = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    for run in (lambda: decontaminate.find_leaks(df, item), lambda: near_dedup.near_duplicates(df), lambda: suffix_dedup.drop_repeated_bytes(df), lambda: neighbours.nearest(df, df, id_col="doc_id")):
        with pytest.raises(TypeError, match="doc_id must hold whole numbers"):
            run()


@pytest.mark.parametrize("row_col", [None, "row"])
def test_hot_ids_of_the_mix_are_many_buckets(spark, monkeypatch, row_col):
    monkeypatch.setattr(mixing, "HOT", 50)
    rows = [(None if i % 2 else i, " ".join(["w"] * (i % 37)), "s" if i % 3 else None, i) for i in range(1200)] + [(5, "a b c", "s", 2000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    got = mixing.plan_mix(df, row_col=row_col).collect()
    assert len(got) == len(rows)
    for source in ("s", None):
        own = sorted((r.start, r.size) for r in got if r.source == source)
        at = 0
        for start, size in own:  # the documents of a source lie one behind the other
            assert start == at
            at += size
        assert at == sum(len(t.split()) for _, t, s, _ in rows if s == source) == next(r.source_size for r in got if r.source == source)
