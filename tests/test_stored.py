"""Stored indexes, swapped scopes, streams that restart, and operators on literal rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from promolens.functions import similarity as sm
from promolens.functions import sql
from promolens.operators import alerts, images, offers, search, tables, writes
from promolens.operators.text_index import TextIndex, TrigramIndex
from promolens.streaming import streams

WORDS = "latte intero parzialmente scremato bio pane integrale pasta di semola riso te tè limone crema doccia caffè moka olio extra vergine uva nera bianca".split()


def products(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 5)))) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, ""), (n + 2, "Lattería  LATTE!"), (None, "latte")], "id long, name string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    words, grams = TextIndex(spark, path + "/words", 8), TrigramIndex(spark, path + "/grams", 8)
    for x in (words, grams):
        x.refresh(products(spark))
    return words, grams


@pytest.mark.parametrize("q", ["latte", "te", "tè limone", "crema docc", "latte intero bio", "zzz", "a", "", "uva ner", "!"])
def test_trigram_index_equals_the_full_scan(spark, index, q):
    p = products(spark).where("id IS NOT NULL")
    for t in (0.25, 0.6):
        want = {(r.id, round(r.s, 9)) for r in p.select("id", sm.similarity(F.col("name"), F.lit(q)).alias("s")).where(F.col("s") > t).collect()}
        assert {(r.id, round(r.similarity, 9)) for r in index[1].similar(q, t).collect()} == want
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(search.search_products(p, q, 500, index=index[1])) == rows(search.search_products(p, q, 500))


def test_lookup_reads_its_own_keys_only(index):
    plan = index[1].similar("latte", 0.4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan or "bucket" in plan.split("PartitionFilters: [", 1)[1][:80]
    assert "In(key" in plan or "key IN" in plan


def test_word_index_equals_text_match(spark, index):
    for q in ("latte", "il latte intero", "di", "pane zzz", "x"):
        p = products(spark).where("id IS NOT NULL")
        want = set() if q in ("di", "x") else {(r.id, round(r.r, 9)) for r in p.where(sm.text_match(F.col("name"), q)).select("id", sm.text_rank(F.col("name"), q).alias("r")).collect()}
        assert {(r.id, round(r["rank"], 9)) for r in index[0].match(q).collect()} == want


def test_refresh_touches_only_what_changed(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), 4)
    docs = lambda *rows: spark.createDataFrame(list(rows), "id long, name string")
    ids = lambda q: sorted(r.id for r in index.match(q).collect())
    with pytest.raises(FileNotFoundError):
        index.rows()
    index.refresh(docs((1, "latte"), (2, "pane"), (3, "latte pane")))
    index.refresh(docs((1, "riso"), (4, "latte"), (3, None)))
    assert ids("latte") == [4] and ids("pane") == [2] and ids("riso") == [1]
    # a refresh that dies before its ids are written is not seen, and the next one takes its place
    broken = index._postings(docs((2, "riso")).withColumnRenamed("name", "text"))
    broken.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{index.path}/v0/postings/gen=2")
    assert ids("pane") == [2] and ids("riso") == [1]
    index.refresh(docs((2, "olio")))
    assert ids("pane") == [] and ids("olio") == [2] and ids("riso") == [1]
    index.compact()
    assert (ids("latte"), ids("riso"), ids("olio")) == ([4], [1], [2]) and index._version() == 1


def test_search_ranks_heads_and_drops_fragments(spark, tmp_path):
    d = datetime.date(2026, 1, 10)
    p = spark.createDataFrame([(1, "Latte intero"), (2, "Centrale Latte fresco"), (3, "Crema al latte"), (4, "E latte"), (5, "Lattuga"), (6, "Con latte"), (7, "Lat"), (8, "Pane")], "id long, name string")
    words, grams = TextIndex(spark, str(tmp_path / "w"), 4), TrigramIndex(spark, str(tmp_path / "g"), 4)
    words.refresh(p)
    grams.refresh(p)
    sk = spark.createDataFrame([(10 * i + c, c, i) for i in range(1, 9) for c in (1, 2)], "id long, chain_id int, product_id long")
    o = spark.createDataFrame([(f"{s.id}-{k}", s.id, None if k else 5, 100 + s.id + k, d, d + datetime.timedelta(days=k - 1)) for s in sk.collect() for k in (0, 1, 2)], "id string, sku_id long, store_id long, price_cents long, valid_from date, valid_to date")
    c = spark.createDataFrame([(1, "one"), (2, "two")], "id int, slug string")
    got = [(r.product_id, r.chain_slug, r.word, r.id) for r in search.search(o, sk, p, c, "latte", d, words, grams).collect()]
    assert got == [(1, "one", 3, "11-1"), (1, "two", 3, "12-1"), (2, "one", 3, "21-1"), (2, "two", 3, "22-1"), (3, "one", 1, "31-1"), (3, "two", 1, "32-1")]
    assert {r.chain_slug for r in search.search(o, sk, p, c, "latte", d, words, grams, chains=["two"]).collect()} == {"two"}


REGISTRY = [(1, "80", "Lat", "Latte intero fresco", "1 l", "u1", 5), (2, None, "Lat", "Latte intero", "1 l", "u2", 3), (3, None, "Gran", "Pane integrale", None, "u3", 1), (4, None, None, "Pane integrale", None, "u4", 9), (5, "81", "Gran", "Pasta di semola", "500 g", "u5", 2), (6, None, "Moka", "Caffè macinato moka", "250 g", "u6", 2)]
WANTED = [(1, "80", "altro", "X", None), (2, None, "LATTE  intero", "lat", "1 l"), (3, None, "Pane integrale", "Zeta", None), (4, None, "Latte intero fresc", "Lat", None), (5, None, "Caffè macinato moka", "Altra", "250 g"), (6, None, "Caffè macinato", "Altra", "100 g"), (7, None, "Sapone", None, None), (8, None, "Pane integrale bio", "Gran", "1 kg"), (9, "99", "Pasta di semola", "Gran", "500 g"), (10, None, "pane", "Gran", None)]


def brute_image(row):
    """The image of the first step that finds one, over the whole registry."""
    def norm(t):
        return " ".join(t.lower().split()) or None if t is not None else None

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in t).split() for i in range(len(w) + 1)}

    def like(a, b):
        x, y = grams(a), grams(b)
        return len(x & y) / len(x | y) if x | y else 0.0

    _, ean, name, brand, quantity = (row[0], row[1], *map(norm, row[2:]))
    found = []
    for _, e, b, n, q, url, seen in REGISTRY:
        b, n, q = map(norm, (b, n, q))
        s = like(name, n)
        steps = [(1, 0, ean is not None and ean == e), (2, 0, (b, n, q) == (brand, name, quantity)), (3, 0, n == name)]
        steps += [(4, -s, len(name) >= 6 and (q is None or quantity is None or q == quantity) and b is not None and b == brand and s > 0.3), (5, -s, len(name) >= 6 and (q is None or quantity is None or q == quantity) and s > 0.45)]
        found += [(step, s, -seen, url) for step, s, ok in steps if ok]
    return (min(found)[3], min(found)[0]) if found else None


def test_image_lookup_equals_brute_force(spark, tmp_path):
    registry = spark.createDataFrame(REGISTRY, "id long, ean string, brand string, name string, quantity string, image_url string, times_seen long")
    sk = spark.createDataFrame(WANTED, "id long, ean string, raw_name string, brand string, raw_quantity string")
    want = {r[0]: brute_image(r) for r in WANTED}
    got = {r.id: (r.image_url, r.step) for r in images.lookup_image(sk, registry).collect()}
    assert got == {k: v for k, v in want.items() if v}
    filled = images.backfill_images(sk.withColumn("image_url", F.when(F.col("id") == 2, "own")), registry)
    assert {r.id: r.image_url for r in filled.collect()} == {k: "own" if k == 2 else v and v[0] for k, v in want.items()}
    index = TrigramIndex(spark, str(tmp_path / "g"), 4)
    index.refresh(registry.withColumn("name", F.lower("name")))
    for i, ean, name, brand, quantity in WANTED:
        one = [tuple(r) for r in images.lookup_one_image(registry, index, name, brand, quantity, ean).collect()]
        assert one == ([want[i]] if want[i] else [])
    registry.createOrReplaceTempView("images_of_test")
    sql.register(spark, "images_of_test")
    of = lambda e: [tuple(r) for r in spark.sql(f"SELECT * FROM lookup_product_image({e})").collect()]
    assert of("'Lat', ' LATTE intero', '1 l', NULL") == [("u2", 2)] and of("NULL, 'zzz', NULL, '81'") == [("u5", 1)] and of("NULL, 'pane integrale', 'x', NULL") == [("u4", 3)]
    assert spark.sql("SELECT norm_text('  A  B ') AS n, norm_text('  ') AS e, dietary_tags('Yogurt BIO senza lattosio') AS t").first() == ("a b", None, ["senza-lattosio", "bio"])


def test_images_by_containment_of_any_length(spark):
    df = spark.createDataFrame([(1, "te bio"), (2, "Uva"), (3, "x / Pane"), (4, "olio"), (5, ""), (6, None), (7, "x y")], "id long, raw_name string").withColumn("image_url", F.lit(None).cast("string"))
    img = spark.createDataFrame([("te", "u1", 1), ("uva nera", "u2", 2), ("pane", "u3", 9), ("pane e altro", "u4", 0), ("", "u5", 0), ("OLIO", "u6", 8), ("olio extra", "u7", 1)], "name string, image_url string, pos long")
    assert {r.id: r.image_url for r in images.attach_images(df, img).collect()} == {1: "u1", 2: "u2", 3: "u3", 4: "u6", 5: None, 6: None, 7: None}


def test_fan_out(spark):
    o = spark.createDataFrame([(1, 1, 7, "Solo Market", None), (2, 1, None, None, None), (3, 1, None, "Grandi marche", None), (4, 1, None, "Pet  Store", None), (5, 1, None, "x", [3, 4]), (6, 2, 9, "Market", None), (7, 2, None, None, None), (8, 1, None, "Supermercato", []), (9, 3, None, "Market", None)], "id int, chain_id int, store_id long, promo string, store_ids array<long>")
    s = spark.createDataFrame([(1, 1, "market", True), (2, 1, "supermarket", True), (3, 1, "market", False), (4, 2, "market", True)], "id long, chain_id int, format string, is_active boolean")
    got = sorted((r.id, r.target_store or 0) for r in writes.fan_out(o, s, by_format=[1, 3]).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (5, 3), (5, 4), (6, 9), (7, 0), (8, 1), (8, 2)]


def test_watches_keep_their_filters_and_wake_up(spark):
    kinds = "id long, user_id long, watch_type string, query string, max_price_cents long, chain_filter array<string>, store_filter array<long>, is_active boolean"
    w = spark.createDataFrame([(1, 1, "keyword", "Latte", 100, ["a"], None, False), (2, 1, "keyword", "latte", 200, ["b"], None, True), (3, 1, "keyword", "latte ", 300, None, [], False)], kinds)
    b = spark.createDataFrame([(10, 1, "keyword", " LATTE", 50, ["a"], [], True), (11, 1, "keyword", "latte", 60, None, None, True), (12, 1, "keyword", "latte", 70, ["a"], [5], True)], kinds)
    got = sorted((r.id, r.max_price_cents, r.is_active, r.created) for r in writes.upsert_watches(w, b).collect())
    assert got == [(1, 50, True, False), (2, 200, True, False), (3, 60, True, False), (12, 70, True, True)]


def test_chain_health_of_chains_without_campaigns(spark):
    d, at = datetime.date(2026, 1, 10), lambda n: datetime.date(2026, 1, n)
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, slug string")
    sk = spark.createDataFrame([(1, 1, "u"), (2, 1, None), (3, 3, None)], "id long, chain_id int, image_url string")
    o = spark.createDataFrame([(1, at(9)), (1, at(10)), (2, at(20)), (2, at(11)), (3, at(1))], "sku_id long, valid_to date")
    fc = spark.createDataFrame([(1, "loaded", at(20), at(9)), (1, "failed", at(2), at(8)), (1, "empty", at(2), at(1)), (3, "loaded", at(12), at(9)), (4, "failed", at(1), datetime.date(2025, 12, 1))], "chain_id int, scrape_status string, valid_to date, updated_at date")
    got = {r.slug: (r.active_offers, r.pct_image, r.loaded_active, r.failed_recent, r.empty_recent, r.stale) for r in offers.chain_health(c, o, sk, fc, d).collect()}
    assert got == {"a": (3, 33.3, 1, 1, 0, False), "b": (0, None, 0, 0, 0, False), "c": (0, None, 1, 0, 0, True), "d": (0, None, 0, 0, 0, True)}


def test_promotions_of_one_offer_are_merged(spark):
    rows = spark.createDataFrame([("Pane", 1, "Super", 1), ("PANE", 1, "Market", 2), ("pane", 1, "Super", 3), ("pane", 2, None, 4), ("riso", 1, None, 5), ("riso", 1, "Iper", 6), ("riso", 1, "Superstore", 7)], "name string, price int, promotion string, pos int")
    got = sorted((r["name"], r.price, r.promotion, r.pos) for r in offers.merge_promotions(rows, [F.upper("name"), F.col("price")], ["pos"]).collect())
    assert got == [("Pane", 1, "Super + Market", 1), ("pane", 2, None, 4), ("riso", 1, "Iper + Superstore", 5)]


def test_scopes_are_swapped_whole(spark, tmp_path):
    table = tables.ScopedTable(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, campaign_id long, store_id long")
    scope = lambda *r: spark.createDataFrame([(x,) for x in r], "campaign_id long")
    now = lambda: sorted(r.id for r in table.read().collect())
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(rows(("a", 1, 1), ("b", 1, None), ("c", 2, 1)), scope(1, 2))[0] == 3
    # killed between stage and commit: readers see the old rows, and the next run the new ones
    run, n = table.stage(rows(("x", 1, 1)))
    assert n == 1 and now() == ["a", "b", "c"]
    n, empty = table.replace(rows(("d", 1, 2)), scope(1, 3))
    assert n == 1 and [r.campaign_id for r in empty.collect()] == [3] and now() == ["c", "d"]
    # one store of a campaign; a batch without rows keeps everything
    table.replace(rows(("e", 1, 3)), spark.createDataFrame([(1, 3)], "campaign_id long, store_id long"))
    n, empty = table.replace(rows(("z", 1, 1)).limit(0), scope(1, 2))
    assert n == 0 and empty.count() == 2 and now() == ["c", "d", "e"]


def test_counts_come_with_the_write(spark, tmp_path):
    d = datetime.date(2026, 1, 20)
    o = spark.createDataFrame([(1, datetime.date(2026, 1, 6)), (2, datetime.date(2026, 1, 5)), (3, datetime.date(2026, 2, 1)), (4, None)], "id int, valid_to date")
    assert tables.purge_counted(o, d, str(tmp_path / "kept")) == {"kept": 2, "purged": 2}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3]
    counts = tables.rejects_counted(o, [("late", F.col("valid_to") > d), ("undated", F.col("valid_to").isNull())], str(tmp_path / "rows"))
    assert counts == {"good": 2, "late": 1, "undated": 1}
    assert {(r.id, r.kind, r.reason) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {(1, "good", None), (2, "good", None), (3, "reject", "late"), (4, "reject", "undated")}


def test_cascade_through_levels(spark):
    t = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    all_ = {"users": t([(1,)], "id int"), "lists": t([(1, 1), (2, 2), (3, None)], "id int, user_id int"), "items": t([(1, 1), (2, 2), (3, 3)], "id int, list_id int"), "told": t([(1,), (2,), (3,), (9,)], "item_id int")}
    keys = [("told", "item_id", "items", "id"), ("items", "list_id", "lists", "id"), ("lists", "user_id", "users", "id")]
    out = tables.cascade_all(all_, keys)
    assert sorted(r.item_id for r in out["told"].collect()) == [1, 3] and sorted(r.id for r in out["items"].collect()) == [1, 3]
    with pytest.raises(ValueError, match="cycle"):
        tables.cascade_all(all_, [*keys, ("users", "id", "told", "item_id")])


def test_sketches_merge(spark):
    ev = spark.range(40_000).selectExpr("date_add(DATE '2026-01-01', CAST(id % 40 AS INT)) AS day", "IF(id % 2 = 0, 'view', 'click') AS event_type", "CAST(id % 9000 AS STRING) AS session_id", "id % 700 AS telegram_user_id")
    d = datetime.date(2026, 2, 5)
    near = alerts.sketch_totals(alerts.daily_sketches(ev), d).first()
    exact = alerts.event_totals(ev, d).first()
    assert near.events == exact.events and abs(near.sessions - exact.sessions) <= 0.05 * exact.sessions and abs(near.users - exact.users) <= 0.05 * exact.users
    assert alerts.sketch_totals(alerts.daily_sketches(ev.limit(0)), d).first() == (0, 0, 0)


def offers_of(spark, path, part, ids, ts="2026-01-01 10:00:00"):
    rows = [(f"o{i}", i, "latte", 100 + i, 10, "one", datetime.date(2026, 1, 31), datetime.datetime.fromisoformat(ts)) for i in ids]
    spark.createDataFrame(rows, "id string, sku_id long, raw_name string, price_cents long, discount_pct int, chain_slug string, valid_to date, ts timestamp").coalesce(1).write.parquet(f"{path}/p{part}")


def test_alerts_are_sent_once_over_restarts(spark, tmp_path):
    path = str(tmp_path)
    w = spark.createDataFrame([(1, "keyword", "latte", None), (2, "keyword", "pane", None)], "id long, watch_type string, query string, max_price_cents long")
    tags = spark.createDataFrame([], "id long, tags array<string>")
    sink = streams.AlertSink(spark, path + "/sent")

    class Breaking(streams.AlertSink):
        """A sink after which the driver dies once, before the batch is marked as done."""

        def write(self, found, batch_id):
            super().write(found, batch_id)
            if batch_id == 1:
                raise RuntimeError("killed")

    def run(to):
        schema = spark.read.parquet(path + "/in/p0").schema
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path + "/in/*")
        streams.stream_alerts(source, w, tags, to, path + "/cp", 100).awaitTermination()

    offers_of(spark, path + "/in", 0, range(0, 5))
    offers_of(spark, path + "/in", 1, range(3, 8), "2026-01-01 11:00:00")
    with pytest.raises(Exception, match="killed"):
        run(Breaking(spark, path + "/sent"))
    run(sink)
    offers_of(spark, path + "/in", 2, range(6, 12), "2026-01-01 12:00:00")
    run(sink)
    got = [(r.watch_id, r.offer_id) for r in sink.read().collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, f"o{i}") for i in range(12)}


def test_late_events_are_dropped(spark, tmp_path):
    path, at = str(tmp_path), datetime.datetime(2026, 1, 10, 12)
    def put(k, *times):
        spark.createDataFrame([(t, "view", f"s{i}") for i, t in enumerate(times)], "ts timestamp, event_type string, session_id string").coalesce(1).write.parquet(f"{path}/in/p{k}")

    def run():
        source = spark.readStream.schema("ts timestamp, event_type string, session_id string").option("maxFilesPerTrigger", 1).parquet(path + "/in/*")
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        streams.daily_event_counts(source, "1 day").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", path + "/cp").trigger(availableNow=True).start().awaitTermination()

    day = datetime.timedelta(days=1)
    put(0, at, at, at - day)
    run()
    put(1, at + 4 * day)
    run()
    put(2, at - day, at + 4 * day)  # the first one comes after its day was closed
    run()
    last = spark.read.parquet(path + "/out").groupBy("day").agg(F.max_by(F.struct("events", "sessions"), "batch").alias("x"))
    assert {(r.day.day, r.x.events, r.x.sessions) for r in last.collect()} == {(9, 1, 1), (10, 2, 2), (14, 2, 2)}


def test_best_for_watches_equals_the_first_of_all_hits(spark):
    rnd = random.Random(4)
    rows = [(f"o{i}", i % 90, rnd.choice(["latte intero", "latte bio", "pane di segale", "riso"]), rnd.randint(50, 300), rnd.choice([None, 5, 10, 20]), rnd.choice("ab"), rnd.choice([None, 1, 2]), datetime.date(2026, 1, 31)) for i in range(400)]
    live = spark.createDataFrame(rows, "id string, sku_id long, raw_name string, price_cents long, discount_pct int, chain_slug string, store_id int, valid_to date")
    tags = spark.createDataFrame([(i, ["bio"] if i % 3 else ["bio", "raro"]) for i in range(90)], "id long, tags array<string>")
    w = spark.createDataFrame([(i, rnd.choice(["keyword", "product", "category"]), rnd.choice(["latte", "LATTE bio", "pane", "te", "bio", "raro", "zz", None]), rnd.choice([None, 60, 150]), rnd.choice([None, [], ["a"]]), rnd.choice([None, [2]])) for i in range(60)], "id long, watch_type string, query string, max_price_cents long, chain_filter array<string>, store_filter array<int>")
    sent = spark.createDataFrame([(i, f"o{j}") for i in range(60) for j in range(0, 400, 3)], "watch_id long, offer_id string")
    every = alerts.match_watches(w, live, tags)
    for told in (None, sent):
        left = every if told is None else every.join(told, ["watch_id", "offer_id"], "left_anti")
        want = offers.first_per(left, ["watch_id"], [F.desc_nulls_last("discount_pct"), F.col("price_cents"), F.col("offer_id")], 7, "place")
        got = alerts.best_for_watches(w, live, tags, 7, told, block=3)
        rows = lambda df: sorted((r.watch_id, r.place, r.offer_id) for r in df.collect())
        assert rows(got) == rows(want) != []
    assert alerts.best_for_watches(w.limit(0), live, tags).count() == 0
