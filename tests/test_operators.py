"""Invariants of the write and graph operators, and plan checks."""

import random

import pytest
from pyspark.sql import functions as F

from promolens.graph import components
from promolens.operators import matching, offers, writes
from promolens.plans.registry import live
from promolens.sources.views import AS_OF, Retail
from tests.conftest import SF


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_is_idempotent_and_null_safe(spark):
    t = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, k2 string, v string")
    b = spark.createDataFrame([(1, None, "n"), (3, None, "c")], "k int, k2 string, v string")
    once = writes.upsert(t, b, ["k", "k2"])
    assert rows(once) == [(1, None, "n"), (2, "x", "b"), (3, None, "c")]
    assert rows(writes.upsert(once, b, ["k", "k2"])) == rows(once)


def test_upsert_rules(spark):
    t = spark.createDataFrame([(1, "old", {"a": "1", "b": "1"})], "k int, u string, m map<string,string>")
    b = spark.createDataFrame([(1, None, {"b": "2"}, 1), (1, "u2", {"c": "3"}, 0)], "k int, u string, m map<string,string>, pos int")
    got = writes.upsert(t, b, ["k"], {"u": "coalesce_new", "m": "map_merge"}, order="pos").first()
    assert (got.u, got.m) == ("u2", {"a": "1", "b": "2"})


def test_replace_scope_leaves_other_scopes(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, None, "b"), (2, 1, "c")], "campaign_id int, store_id int, v string")
    assert rows(writes.replace_scope(t, t.limit(0), 1, [1])) == [(1, None, "b"), (2, 1, "c")]
    assert rows(writes.replace_scope(t, t.limit(0), 1)) == [(2, 1, "c")]


def test_history_merge_is_associative(spark):
    o = Retail(spark, SF).offers
    a, b, c = (writes.price_history_rollup(o.where(f"sku_id % 3 = {i} OR price_cents % 4 = {i}")) for i in range(3))
    m = writes.merge_history
    assert rows(m(m(a, b), c)) == rows(m(a, m(b, c)))


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(200, 200), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    draw.shuffle(edges)
    got = components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}


def test_no_cartesian_product_and_no_python(spark):
    r = Retail(spark, SF)
    for df in (matching.candidate_pairs(r.products, r.skus), matching.fuzzy_link(r.skus, r.products), offers.price_spread(live(r))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan


def test_preferences_empty_means_all(spark):
    r = Retail(spark, SF)
    none = spark.createDataFrame([], "user_id int, chain_id int")
    assert offers.in_preferred_chains(live(r), none, 1).count() == live(r).count()


def test_alerts_run_twice_emit_nothing(spark):
    from promolens.operators import alerts

    r = Retail(spark, SF)
    items = r.list_items
    none = spark.createDataFrame([], "list_id long, offer_id string")
    first = alerts.new_alerts(alerts.match_list_items(items, live(r)), none, "list_id", 1000)
    assert first.count() > 0
    assert alerts.new_alerts(alerts.match_list_items(items, live(r)), first.select("list_id", "offer_id"), "list_id", 1000).count() == 0


def watch_hits(spark, watches, with_lists=True):
    from promolens.operators import alerts

    offer = "id string, sku_id long, raw_name string, price_cents long, discount_pct long, chain_slug string, valid_to date, store_id long"
    o = spark.createDataFrame([("a", 1, "Tè verde", 100, 5, "one", AS_OF, 7), ("b", 2, "Latte", 100, 5, "two", AS_OF, 8), ("c", 3, "tè", 100, 5, "two", AS_OF, None), ("d", 4, None, 100, 5, "one", AS_OF, 7)], offer)
    tags = spark.createDataFrame([(1, ["bio"]), (2, ["bio"]), (3, ["bio"]), (4, [])], "id long, tags array<string>")
    w = spark.createDataFrame([(*r, None) for r in watches], "id long, watch_type string, query string, chain_filter array<string>, store_filter array<int>, max_price_cents long")
    return {(r.watch_id, r.offer_id) for r in alerts.match_watches(w if with_lists else w.drop("chain_filter", "store_filter"), o, tags).collect()}


def test_short_watches_match(spark):
    watches = [(1, "keyword", "Tè", None, None), (2, "keyword", "te", None, None), (3, "product", "t", None, None), (4, "keyword", "zz", None, None), (5, "keyword", "tte", None, None), (6, "keyword", None, None, None), (7, "keyword", " ", None, None)]
    want = {(1, "a"), (1, "c"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (5, "b"), (7, "a"), (7, "b"), (7, "c")}
    assert watch_hits(spark, watches, with_lists=False) == want


def test_watches_keep_to_their_chains_and_stores(spark):
    watches = [(1, "category", "bio", ["two"], []), (2, "category", "bio", [], [7]), (3, "category", "bio", None, None), (4, "keyword", "t", ["one"], [8]), (5, "keyword", "t", ["two"], [8]), (6, "product", "latte", ["one", "two"], [7])]
    want = {(1, "b"), (1, "c"), (2, "a"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (5, "b"), (5, "c")}
    assert watch_hits(spark, watches) == want


def test_active_day_is_inclusive(spark):
    o = spark.createDataFrame([(AS_OF, AS_OF)], "valid_from date, valid_to date")
    assert offers.active(o, AS_OF).count() == 1


def test_classify_takes_the_first_rule_of_whole_words(spark):
    rules = spark.createDataFrame([(2, "carne", "pollo"), (1, "animali", "cibo per cani"), (3, "altro-cibo", "cibo"), (9, "vuota", " ")], "rank int, slug string, keyword string")
    names = spark.createDataFrame([(1, "Pollo arrosto"), (2, "Cibo per cani al pollo"), (3, "Pollone"), (4, None), (5, "cibo, per gatti")], "id int, name string")
    assert {r.id: r.slug for r in matching.classify(names, rules).collect()} == {1: "carne", 2: "animali", 3: "altro", 4: "altro", 5: "altro-cibo"}
    assert {r.slug for r in matching.classify(names, rules.where("false")).collect()} == {"altro"}


def test_other_city_of_several_words(spark):
    files = spark.createDataFrame([("http://x/volantino-REGGIO%20EMILIA.pdf",), ("http://x/veronaest.pdf",), ("http://x/trento.pdf",), ("http://x/a",)], "url string")
    cities = spark.createDataFrame([("Reggio Emilia",), ("Verona",), ("Trento",)], "city string")
    assert sorted(r.url for r in offers.other_city(files, cities, "trento").collect()) == ["http://x/a", "http://x/trento.pdf"]


def test_products_stay_without_an_other_category(spark):
    p = spark.createDataFrame([(1, "pasta"), (2, "x"), (3, None)], "id int, category string")
    c = spark.createDataFrame([(7, "pasta")], "id int, slug string")
    assert {r.id: r.category_id for r in offers.link_taxonomy(p, c).collect()} == {1: 7, 2: None, 3: None}
