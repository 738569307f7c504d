"""Work on copies: plans that do not grow with pairs of equal rows, and the same results as the plain forms."""

import pytest

from promolens import plans
from promolens.operators import matching
from tests.conftest import SF


def tree(df) -> list[tuple[int, str]]:
    """(depth, node) of the physical plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    found = [(next((i for i, ch in enumerate(line) if ch.isalpha()), 0), line) for line in lines]
    return found[: next((i for i, (_, line) in enumerate(found) if "Initial Plan" in line), None)]


def below(nodes, name: str) -> list[str]:
    """The nodes below those of a name."""
    found, within = [], None
    for depth, line in nodes:
        if within is not None and depth <= within:
            within = None
        if within is not None:
            found.append(line)
        elif name in line:
            within = depth
    return found


def test_classify_broadcasts_rules_and_no_texts(spark):
    df = plans.queries()["e14_keyword_classifier"](spark, SF)
    assert not [line for line in below(tree(df), "BroadcastExchange") if "Generate" in line]


PRODUCTS = [(i, ["cold bolt", "cold bolts", "hot ring", "cold ring"][i % 4], "B" if i % 3 else "b", "tools") for i in range(40)]
# products of one chain, of several, of none that is known, and without SKUs
SKUS = [(i, c) for i in range(36) for c in ([1], [2], [1, 2], [None])[i % 5 % 4]]


@pytest.mark.parametrize("size", [7, 30])
def test_candidate_batches_number_all_pairs(spark, size):
    p = spark.createDataFrame(PRODUCTS, "id long, name string, brand string, category string")
    sk = spark.createDataFrame(SKUS, "product_id long, chain_id int")
    pairs = matching.candidate_pairs(p, sk)
    plain = matching.batch_pairs(pairs, size).select("l_id", "r_id", "batch", "place")
    assert sorted(plain.collect()) == sorted(matching.candidate_batches(p, sk, size).collect())
    chains = {i: {c for j, c in SKUS if j == i and c is not None} for i in range(36)}
    alike = lambda a, b: len({a % 4, b % 4} - {0, 1}) == 0 or a % 4 == b % 4 or {a % 4, b % 4} <= {0, 3} or {a % 4, b % 4} <= {2, 3} or {a % 4, b % 4} <= {1, 3}
    want = {(a, b) for a in range(36) for b in range(a + 1, 36) if alike(a, b) and len(chains[a] | chains[b]) > 1}
    assert {(r.l_id, r.r_id) for r in pairs.collect()} == want


def test_candidate_pairs_are_not_shuffled(spark):
    nodes = [line for _, line in tree(plans.queries()["j8_candidate_pairs"](spark, SF))]
    pairs = next(i for i, line in enumerate(nodes) if "l_id" in line and "r_id" in line and "Join" in line)
    assert not [line for line in nodes[:pairs] if "Exchange" in line or "Sort " in line]
    batches = [line for _, line in tree(plans.queries()["m6_batch_pairs"](spark, SF))]
    pairs = next(i for i, line in enumerate(batches) if "l_id" in line and "r_id" in line and "Join" in line)
    assert not [line for line in batches[:pairs] if "Exchange" in line or "Sort " in line or "Window" in line]


def test_fuzzy_link_ranks_names(spark):
    sk = spark.createDataFrame([(i, None, "Cold  BOLT" if i % 2 else "hot ring", "X") for i in range(30)], "id long, product_id long, raw_name string, brand string")
    p = spark.createDataFrame([(100 - i, "cold bolt" if i % 2 else "cold ring", "x") for i in range(30)], "id long, name string, brand string")
    df = matching.fuzzy_link(sk, p)
    assert {(r.sku_id, r.product_id, r.confidence) for r in df.collect()} == {(i, 71, 1.0) for i in range(1, 30, 2)}
    # ranked by name, never by SKU
    assert not [line for _, line in tree(df) if "Window" in line and "l_id" in line]


def test_images_are_looked_up_by_distinct_names(spark):
    from promolens.operators import images

    # 300 copies of two SKUs and of two registry rows
    sk = spark.createDataFrame([(i, None if i % 3 else f"{i}", "cold bolts" if i % 2 else "hot ring", "X", None) for i in range(600)], "id long, ean string, raw_name string, brand string, raw_quantity string")
    registry = spark.createDataFrame([("6" if i == 0 else None, "cold bolt" if i % 2 else "hot ring", "X", None, f"u{i:03}", i // 100) for i in range(600)], "ean string, name string, brand string, quantity string, image_url string, times_seen long")
    df = images.lookup_image(sk, registry)
    assert {(r.id, r.image_url, r.step) for r in df.collect()} == {(i, "u000", 1) if i == 6 else (i, "u501", 4) if i % 2 else (i, "u500", 2) for i in range(600)}
    nulls = images.lookup_image(sk, registry.withColumn("times_seen", matching.F.expr("IF(image_url = 'u500', NULL, times_seen)")))
    assert {r.image_url for r in nulls.where("id % 2 = 0 AND id <> 6").collect()} == {"u502"}
    # SKUs meet one row a triple or EAN
    assert most_rows(df) <= 1300


def test_images_are_attached_by_distinct_names(spark):
    from promolens.operators import images

    rows = spark.createDataFrame([(i, "te / Cold bolt" if i % 2 else "cold bolt") for i in range(400)], "id long, name string").withColumn("image_url", matching.F.lit(None).cast("string"))
    img = spark.createDataFrame([("cold bolt" if i % 2 else "bolt", f"u{i}", i) for i in range(400)], "name string, image_url string, pos long")
    df = images.attach_images(rows, img, "name")
    assert {r.image_url for r in df.collect()} == {"u1"}
    assert most_rows(df) <= 900


def most_rows(df) -> int:
    """The largest number of rows that a node of the plan puts out; the result must have been read."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_watches_that_ask_for_the_same_are_matched_once(spark):
    from promolens.operators import alerts
    from promolens.streaming.streams import AlertSink
    import tempfile

    w = spark.createDataFrame([(i, i % 2, "keyword" if i % 3 else "product", [" Bolt", "bolt"][i % 2], 50 if i % 5 == 0 else None) for i in range(120)], "id long, user_id long, watch_type string, query string, max_price_cents long")
    live = spark.createDataFrame([(f"o{i:02}", i, 10 * i, i % 7, "c", "cold bolt" if i % 4 else "bolts", None) for i in range(20)], "id string, sku_id long, price_cents long, discount_pct int, chain_slug string, raw_name string, valid_to date")
    tags = spark.createDataFrame([], "id long, tags array<string>")
    hits = alerts.match_watches(w, live, tags)
    users = spark.createDataFrame([(0, "o06"), (0, "o13"), (7, "o20")], "user_id long, offer_id string")
    known = hits.join(w.select(matching.F.col("id").alias("watch_id"), "user_id"), "watch_id").join(users, ["user_id", "offer_id"], "left_anti")
    for sent, rows in ((None, hits), (users, known)):
        want = rows.groupBy("watch_id").agg(matching.F.count("*").alias("n"), matching.F.min("price_cents").alias("low"))
        assert sorted(want.collect()) == sorted(alerts.watch_totals(w, live, tags, sent).collect())
    plain = {(r.watch_id, r.offer_id) for r in alerts.new_alerts(hits, known.limit(0), "watch_id", 4).collect()}
    found, members = alerts.best_of_classes(w, live, tags, 4)
    assert (found.count(), members.count()) == (16, 120)
    assert {(r.watch_id, r.offer_id) for r in members.join(found, "id").collect()} == plain
    # a watch that was told of one of the offers is a class of its own, one that was told of others is not
    one = spark.createDataFrame([(4, "o13"), (8, "gone")], "watch_id long, offer_id string")
    found, members = alerts.best_of_classes(w, live, tags, 4, one)
    assert found.count() == 20
    got = {(r.watch_id, r.offer_id) for r in members.join(found, "id").collect()}
    assert (4, "o13") in plain and (4, "o13") not in got and {x for x in got if x[0] != 4} == {x for x in plain if x[0] != 4}
    # the sink stores classes, beside single alerts
    sink = AlertSink(spark, tempfile.mkdtemp(prefix="spark-") + "/sent")
    sink.write(sink.of_classes(found, members), 0)
    sink.write(spark.createDataFrame([(500, "x")], sink.kinds), 1)
    assert {(r.watch_id, r.offer_id) for r in sink.read().collect()} == got | {(500, "x")}
    assert {(r.watch_id, r.offer_id) for r in sink.read(1, spark.createDataFrame([("o13",)], "offer_id string")).collect()} == {x for x in got if x[1] == "o13"}
    assert spark.read.parquet(sink.path + "/gen=0").count() == 140


def test_geo_join_compares_positions_and_deals_the_stores(spark):
    from promolens.functions.similarity import geo_join

    at = spark.createDataFrame([(i, 45.1 + (i % 3) / 100 if i else None, 10.5) for i in range(241)], "id long, lat double, lng double")
    df = geo_join(at, at, 1.5)
    got = {(r.point_id, r.store_id) for r in df.collect()}
    assert got == {(a, b) for a in range(1, 241) for b in range(1, 241) if abs(a % 3 - b % 3) <= 1}
    sizes = [r["count"] for r in df.groupBy(matching.F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(got) / 4


def test_a_frequent_key_is_written_by_several_tasks(spark, tmp_path):
    from promolens.operators.text_index import TextIndex

    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        index = TextIndex(spark, str(tmp_path / "words"), 4)
        index.refresh(spark.range(300).withColumn("name", matching.F.lit("latte")))
        assert index.rows(["latt"]).select(matching.F.input_file_name()).distinct().count() > 1
        assert index.match("latte").count() == 300
    finally:
        spark.conf.unset(merge)


@pytest.mark.parametrize("query, table, name, kinds", [("t3_compare_prices", "skus", "raw_name", 1), ("t6_search_products", "products", "name", 1), ("t4_search", "products", "name", 2), ("e17_index_match", "skus", "raw_name", 1)])
def test_search_indexes_hold_each_name_once(spark, monkeypatch, query, table, name, kinds):
    from promolens.operators.text_index import PostingIndex
    from promolens.sources.views import Retail

    made, refresh = [], PostingIndex.refresh
    monkeypatch.setattr(PostingIndex, "refresh", lambda self, *args: made.append(self) or refresh(self, *args))
    plans.queries()[query](spark, SF)
    rows = getattr(Retail(spark, SF), table)
    names = {r[0].removeprefix("con ") for r in rows.select(name).distinct().collect()}
    assert len(made) == kinds
    for index in made:
        held = [(r.key, r.id) for r in index.rows().collect()]
        assert len(held) == len(set(held)) and {i.removeprefix("con ") for _, i in held} == names and len(names) < rows.count()


def test_postings_are_not_grouped(spark, tmp_path):
    from promolens.operators.text_index import TextIndex, TrigramIndex

    docs = spark.createDataFrame([(1, "latte latte bio"), (1, "latte latte bio"), (2, "pane"), (3, None), (4, "")], "id long, text string")
    for kind in (TextIndex, TrigramIndex):
        index = kind(spark, str(tmp_path / kind.__name__), 4)
        assert not [line for _, line in tree(index._postings(docs)) if "Aggregate" in line or "Exchange" in line]
        index.refresh(docs, "id", "text")
    assert sorted(map(tuple, TextIndex(spark, str(tmp_path / "TextIndex"), 4).match("latte").collect())) == [(1, 0.5, 4)]
    assert sorted(map(tuple, TrigramIndex(spark, str(tmp_path / "TrigramIndex"), 4).similar("pane", 0.9).collect())) == [(2, 1.0)]


@pytest.mark.parametrize("q", ["Cold Bolt", "c"])
def test_indexes_by_name_find_what_indexes_by_id_find(spark, tmp_path, q):
    import datetime

    from promolens.operators import search
    from promolens.operators.text_index import TextIndex, TrigramIndex

    names = ["cold bolt", "Cold BOLTS", None, "hot bolt", "con cold bolt", "", "old bolt x", "cold bolt"]
    p = spark.createDataFrame([(i, names[i % 8]) for i in range(48)], "id long, name string")
    each = p.select("name").distinct()
    made = {}
    for kind in (TextIndex, TrigramIndex):
        made[kind, "id"], made[kind, "name"] = kind(spark, str(tmp_path / f"i{kind.__name__}"), 4), kind(spark, str(tmp_path / f"n{kind.__name__}"), 4)
        made[kind, "id"].refresh(p)
        made[kind, "name"].refresh(each, "name", "name")
    rows = lambda df: [tuple(r) for r in df.collect()]
    plain = rows(search.search_products(p, q, 100))
    assert plain == rows(search.search_products(p, q, 100, index=made[TrigramIndex, "name"], key="name"))
    d = datetime.date(2026, 1, 10)
    sk = spark.createDataFrame([(100 * c + i, c, i, names[i % 8]) for i in range(48) for c in (1, 2)], "id long, chain_id int, product_id long, raw_name string")
    o = sk.selectExpr("id AS sku_id", "explode(array(0, 1, 2)) AS k").selectExpr("concat(sku_id, '-', k) AS id", "sku_id", "5L AS store_id", "sku_id % 7 + k AS price_cents", "DATE '2026-01-01' AS valid_from", "date_add(DATE '2026-01-09', k) AS valid_to")
    c = spark.createDataFrame([(1, "one"), (2, "two")], "id int, slug string")
    found = [[(r.id, r.product_id, r.product_name, r.chain_slug, r.word, r.rank, r.similarity) for r in search.search(o, sk, p, c, q, d, made[TextIndex, k], made[TrigramIndex, k], k=200, key=k).collect()] for k in ("id", "name")]
    assert found[0] == found[1]
    live = o.join(sk.selectExpr("id AS sku_id", "raw_name"), "sku_id")
    assert rows(search.compare_prices(live, q, 500).select("id", "similarity")) == rows(search.compare_prices(live, q, 500, index=made[TrigramIndex, "name"], key="raw_name").select("id", "similarity"))


def test_analytics_and_skus_are_dealt_over_tasks(spark):
    from promolens.operators import offers
    from promolens.sources.views import Retail

    dealt = [line for _, line in tree(plans.queries()["g7_promotion_analytics"](spark, SF)) if "REPARTITION_BY_NUM" in line]
    assert [k for k in ("sku_id", "l_partkey") if any(k in line for line in dealt)] == ["sku_id", "l_partkey"]
    skus = Retail(spark, SF).skus.select("raw_name", "id")
    # part is joined behind the distinct keys, never carried through it
    assert not [line for line in below(tree(skus), "REPARTITION_BY_NUM") if "p_name" in line]
    sk = spark.createDataFrame([(1, 7, ["a", "b"]), (1, 7, ["a"]), (2, 7, []), (3, 8, None)], "id long, chain_id int, tags array<string>")
    o = spark.createDataFrame([(i % 3 + 1, 100 - i, "m", False) for i in range(6)] + [(None, 1, "m", True)], "sku_id long, price_cents long, mechanic string, requires_card boolean").selectExpr("*", "DATE '2026-01-07' AS valid_from")
    got = {(r.chain_id, str(r.week), r.tag, r.offers, r.skus, r.min_cents) for r in offers.promotion_analytics(o, sk).collect()}
    assert got == {(7, "2026-01-05", "a", 4, 1, 97), (7, "2026-01-05", "b", 2, 1, 97), (7, "2026-01-05", "uncategorized", 2, 1, 96), (8, "2026-01-05", "uncategorized", 2, 1, 95)}


def test_alerts_of_a_class_are_dealt_in_parts(spark, monkeypatch, tmp_path):
    from promolens.streaming import streams

    monkeypatch.setattr(streams, "PART", 8)
    sink = streams.AlertSink(spark, str(tmp_path / "sent"))
    # a class with nearly all, one with a watch without id and one twice, and the same class numbers in another batch
    first = {1: ([f"o{i}" for i in range(120)], list(range(50))), 2: (["o1", "x"], [None, 70, 70])}
    second = {1: (["y"], [80, 81]), 3: (["z"], [82])}
    want = [(90, "single")]
    for batch, classes in enumerate((first, second)):
        found = [(None, c, o) for c, (offers, _) in classes.items() for o in offers]
        members = [(w, c, None) for c, (_, watches) in classes.items() for w in watches]
        sink.write(spark.createDataFrame(found + members + [(90, None, "single")] * (batch == 0), "watch_id long, cls long, offer_id string"), batch)
        want += [(w, o) for offers, watches in classes.values() for o in offers for w in watches]
    key = lambda r: (r[0] or -1, r[1])
    df = sink.read()
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    sizes = [r["count"] for r in df.groupBy(matching.F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(want) / 3
    asked = spark.createDataFrame([("y",), ("gone",)], "offer_id string")
    assert sorted(map(tuple, sink.read(2, asked).collect())) == [(80, "y"), (81, "y")]
    assert [sink.knows(n, asked) for n in (0, 1, 2)] == [False, False, True]


def test_lists_are_read_at_once_where_all_offers_are_asked_for(spark, monkeypatch):
    from promolens.operators import alerts

    w = spark.createDataFrame([(i, "keyword", "bolt", 150 if i else None) for i in range(4)], "id long, watch_type string, query string, max_price_cents long")
    live = spark.createDataFrame([(f"o{i:03}", i, i, i % 7, "c", "cold bolt", None) for i in range(200)], "id string, sku_id long, price_cents long, discount_pct int, chain_slug string, raw_name string, valid_to date")
    tags, rounds, within = spark.createDataFrame([], "id long, tags array<string>"), [], alerts._within
    monkeypatch.setattr(alerts, "_within", lambda *args: rounds.append(1) or within(*args))
    for k, n in ((1 << 30, 200), (200, 200), (160, 160)):
        rounds.clear()
        got = alerts.best_for_watches(w, live, tags, k, block=3)
        assert [(r["count"], r["last"]) for r in got.groupBy("watch_id").agg(matching.F.count("*").alias("count"), matching.F.max("place").alias("last")).orderBy("watch_id").collect()] == [(n, n)] + [(151, 151)] * 3
        assert len(rounds) == (1 if k >= 200 else 2)
    found, _ = alerts.best_of_classes(w, live, tags, 1 << 30, block=3)
    assert not [line for _, line in tree(found.select("id", "offer_id")) if "Window" in line]


def test_micro_batches_do_not_read_the_source_tables_again(spark, monkeypatch):
    from types import SimpleNamespace

    from promolens.plans.registry import live, tagged
    from promolens.sources.views import Retail
    from promolens.streaming import streams

    seen = {}
    monkeypatch.setattr(streams, "stream_alerts", lambda offers, watches, tags, sink, checkpoint, k, sent_to_users: seen.update(tags=tags, told=sent_to_users) or SimpleNamespace(awaitTermination=lambda: None))
    plans.queries()["st2_stream_batches"](spark, SF)
    r = Retail(spark, SF)
    for name in ("tags", "told"):
        assert not [f for f in seen[name].inputFiles() if "lineitem" in f or "part.parquet" in f]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(seen["told"]) == rows(r.told) != []
    assert rows(seen["tags"].select("id", "tags")) == rows(tagged(r).join(live(r).select("sku_id").distinct(), matching.F.col("id") == matching.F.col("sku_id")).select("id", "tags")) != []


def test_offers_that_come_again_are_sent_once(spark, tmp_path):
    from promolens.streaming import streams

    path = str(tmp_path)
    w = spark.createDataFrame([(i, "keyword", "bolt", 5 if i == 2 else None) for i in range(3)], "id long, watch_type string, query string, max_price_cents long")
    tags = spark.createDataFrame([], "id long, tags array<string>")
    sent = spark.createDataFrame([(0, "o7")], "watch_id long, offer_id string")
    for part, ids in enumerate((range(0, 6), range(3, 9), range(0, 9))):
        spark.createDataFrame([(f"o{i}", i, i, 1, "c", "cold bolt", None) for i in ids], "id string, sku_id long, price_cents long, discount_pct int, chain_slug string, raw_name string, valid_to date").coalesce(1).write.parquet(f"{path}/in/p{part}")
    source = spark.readStream.schema(spark.read.parquet(path + "/in/p0").schema).option("maxFilesPerTrigger", 1).parquet(path + "/in/*")
    sink = streams.AlertSink(spark, path + "/sent")
    streams.stream_alerts(source, w, tags, sink, path + "/cp", 100, sent).awaitTermination()
    want = sorted({(i, f"o{j}") for i in range(3) for j in range(9) if i != 2 or j <= 5} - {(0, "o7")})
    assert len(sink.batches.complete()) == 3 and sorted(map(tuple, sink.read().collect())) == want


def test_stream_batches_are_as_many_as_asked_for(spark, monkeypatch):
    from promolens.streaming import streams

    written, write = [], streams.AlertSink.write
    monkeypatch.setattr(streams.AlertSink, "write", lambda self, found, batch_id: written.append(batch_id) or write(self, found, batch_id))
    frame = type(spark.range(0))
    deal = frame.repartition
    # a session may deal rows over more tasks than are asked for
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: deal(self, 7 if n == 3 else n, *keys))
    plans.queries()["st2_stream_batches"](spark, SF)
    assert written == [0, 1, 2]
