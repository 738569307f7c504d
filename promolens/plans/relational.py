"""Filters, joins, aggregations, windows and rankings over offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import offers as op
from ..sources.views import AS_OF, D
from .registry import Registry, live, tagged

reg = Registry()
A = ("active",)


def with_images(r):
    """SKUs with an image for three in four."""
    return r.skus.withColumn("image_url", F.expr("IF(id % 4 = 0, NULL, concat('https://img/', id))"))


def pictured(r):
    """Live offers with the images of their SKUs."""
    return op.active_offers(r.offers, with_images(r), r.products, r.chains, AS_OF)


OFFER = "id, sku_id, store_id, price_cents, discount_pct, valid_from, valid_to"
CARD = ["id", "sku_id", "store_id", "price_cents", "discount_pct", "valid_from", "valid_to"]
L = ["id", "sku_id", "chain_slug", "price_cents", "discount_pct"]
LS = "id, sku_id, chain_slug, price_cents, discount_pct"
TAGS = """[t FOR t IN [CASE WHEN lower(raw_name) LIKE '%cold%' THEN 'cold' END, CASE WHEN lower(raw_name) LIKE '%small%' THEN 'small' END, CASE WHEN lower(raw_name) LIKE '%large%' THEN 'large' END, CASE WHEN lower(raw_name) LIKE '%widget%' THEN 'widget' END, CASE WHEN lower(raw_name) LIKE '%red%' THEN 'red' END, CASE WHEN lower(raw_name) LIKE '%hot%' THEN 'hot' END] IF t IS NOT NULL]"""
TAGGED = f"tagged AS (SELECT *, {TAGS} AS tags FROM skus)"

reg.add("f1_active", lambda r: op.active(r.offers, AS_OF).select(*CARD), f"SELECT {OFFER} FROM offers WHERE {D} BETWEEN valid_from AND valid_to", "offers")
reg.add("f2_not_expired", lambda r: op.not_expired(r.offers, AS_OF).groupBy("campaign_id").agg(F.count("*").alias("n")), f"SELECT campaign_id, count(*) AS n FROM offers WHERE valid_to >= {D} GROUP BY campaign_id", "offers")
reg.add("f3_in_chains", lambda r: op.in_chains(live(r), ["nation_1", "nation_7"]).select(*L), f"SELECT {LS} FROM active WHERE chain_slug IN ('nation_1', 'nation_7')", *A)
reg.add("f3_preferred_chains", lambda r: op.in_preferred_chains(live(r), r.watches.selectExpr("user_id", "CAST(id % 25 AS INT) AS chain_id"), 3).select(*L),
        f"SELECT {LS} FROM active WHERE chain_id IN (SELECT id % 25 FROM watches WHERE user_id = 3)", "active", "watches")
reg.add("f4_in_stores", lambda r: op.in_stores(live(r), [1, 2, 3]).select("id", "store_id"), "SELECT id, store_id FROM active WHERE store_id IS NULL OR store_id IN (1, 2, 3)", *A)
reg.add("f5_in_stores_strict", lambda r: op.in_stores(live(r), [1, 2, 3], strict=True).select("id", "store_id"), "SELECT id, store_id FROM active WHERE store_id IN (1, 2, 3)", *A)
reg.add("f6_store_offers", lambda r: op.store_offers(live(r), r.stores, 3).select("id", "chain_id", "store_id"),
        "SELECT id, chain_id, store_id FROM active WHERE chain_id = (SELECT chain_id FROM stores WHERE id = 3) AND (store_id IS NULL OR store_id = 3)", "active", "stores")
reg.add("f7_contains_text", lambda r: live(r).where(op.contains_text("Bolt", "raw_name", "product_name", "sku_brand")).select(*L),
        f"SELECT {LS} FROM active WHERE lower(raw_name) LIKE '%bolt%' OR lower(coalesce(product_name, '')) LIKE '%bolt%' OR lower(sku_brand) LIKE '%bolt%'", *A)
reg.add("f8_word_match", lambda r: live(r).withColumn("score", op.word_score(F.col("raw_name"), "hot")).where("score > 0").select("id", "score"),
        r"""SELECT * FROM (SELECT id, CASE WHEN regexp_matches(lower(raw_name), '^\s*([a-z&.]+\s+)?hot\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(raw_name), '(^|\s)hot(\s|$)') THEN 1 ELSE 0 END AS score FROM active) WHERE score > 0""", *A)
reg.add("f8_not_fragment", lambda r: r.products.selectExpr("id", "element_at(array('', 'e ', 'CON ', 'dei', 'su  '), CAST(id % 5 AS INT) + 1) || IF(id % 7 = 0, 'ab', name) AS name").where(op.not_fragment(F.col("name"))).select("id"),
        "SELECT id FROM products WHERE (id % 5 = 0 AND id % 7 <> 0) OR id % 5 = 3", "products")
reg.add("f9_has_tag", lambda r: tagged(r).where(op.has_tag("cold")).select("id"), f"WITH {TAGGED} SELECT id FROM tagged WHERE list_contains(tags, 'cold')", "skus")
reg.add("f10_any_tag", lambda r: tagged(r).where(op.has_any_tag(["cold", "red", "bogus"], ["cold", "red", "hot"])).select("id"), f"WITH {TAGGED} SELECT id FROM tagged WHERE list_has_any(tags, ['cold', 'red'])", "skus")
reg.add("f11_expiring", lambda r: op.expiring(r.offers, AS_OF, 7).select(*CARD), f"SELECT {OFFER} FROM offers WHERE valid_to >= {D} AND valid_to <= {D} + 7", "offers")
reg.add("f12_deal_quality", lambda r: live(r).where(op.deal_quality(120000)).select(*L), f"SELECT {LS} FROM active WHERE discount_pct IS NOT NULL AND price_cents < 120000 AND length(raw_name) < 120", *A)
reg.add("f13_not_banner", lambda r: r.skus.withColumn("raw_name", F.expr("IF(id % 4 = 0, concat(raw_name, element_at(array(' Settimana dal 3', ' concorso', ' VINCE!', ' punti', ' tribù'), CAST(id div 4 % 5 AS INT) + 1)), raw_name)")).where(op.not_banner()).select("id"),
        "SELECT id FROM skus WHERE (id % 4 <> 0 OR id // 4 % 5 = 3) AND length(raw_name) + CASE WHEN id % 4 = 0 THEN 6 ELSE 0 END BETWEEN 6 AND 90", "skus")
reg.add("f14_allowed_url", lambda r: r.raw("pages").where(op.allowed_url(F.col("url"), ["example.com", "example.org"])).select("page_id", "url"),
        r"SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '^https?://([^/:@?#]*\.)?example\.(com|org)([:/?#]|$)')")
FLY = lambda r: r.campaigns
reg.add("f15_fresh_flyers", lambda r: op.fresh_flyers(r.campaigns, AS_OF)[0], f"SELECT * FROM campaigns WHERE {D} BETWEEN valid_from AND valid_to", "campaigns")
reg.add("f15_stale_flyers", lambda r: op.fresh_flyers(r.campaigns, AS_OF)[1].groupBy("chain_id").agg(F.count("*").alias("n")), f"SELECT chain_id, count(*) AS n FROM campaigns WHERE NOT ({D} BETWEEN valid_from AND valid_to) GROUP BY chain_id", "campaigns")
reg.add("f16_current_promotion", lambda r: op.current_promotion(r.campaigns, AS_OF, order=("valid_from", "id")),
        f"SELECT * FROM campaigns QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY {D} BETWEEN valid_from AND valid_to DESC, valid_from, id) = 1", "campaigns")
reg.add("f17_usable_promos", lambda r: op.usable_promos(r.products.selectExpr("id AS promo_id", "concat(element_at(array('', 'news-', 'big-news ', 'Sponsor ', 'RICETTA '), CAST(id % 5 AS INT) + 1), name) AS alias", "id % 3 = 0 AS hidden"), r.skus.selectExpr("product_id AS promo_id")).select("promo_id"),
        "SELECT id AS promo_id FROM products WHERE id % 5 IN (0, 2) AND id % 3 <> 0 AND id IN (SELECT product_id FROM skus)", "products", "skus")
reg.add("f19_null_safe_keys", lambda r: r.offers.alias("a").join(r.offers.where("requires_card").select("store_id", "sku_id").distinct().alias("b"), F.col("a.store_id").eqNullSafe(F.col("b.store_id")) & (F.col("a.sku_id") == F.col("b.sku_id"))).select("a.id"),
        "SELECT a.id FROM offers a JOIN (SELECT DISTINCT store_id, sku_id FROM offers WHERE requires_card) b ON coalesce(a.store_id, -1) = coalesce(b.store_id, -1) AND a.sku_id = b.sku_id", "offers")
reg.add("f20_display_labels", lambda r: op.with_display(live(r)).select("id", "display_name", "display_brand", "category"), "SELECT id, coalesce(product_name, raw_name) AS display_name, coalesce(product_brand, sku_brand) AS display_brand, category FROM active", *A)
reg.add("f21_in_bbox", lambda r: op.in_bbox(r.stores, 45.2, 45.5, 10.7, 11.2).select("id"), "SELECT id FROM stores WHERE lat BETWEEN 45.2 AND 45.5 AND lng BETWEEN 10.7 AND 11.2", "stores")
reg.add("f22_other_city", lambda r: op.other_city(r.products.selectExpr("concat('http://x/', upper(replace(name, ' ', '-')), '.pdf') AS url").distinct(), r.spark.createDataFrame([("COLD",), ("HOT",), ("RED",)], "city string"), "red"),
        "SELECT DISTINCT 'http://x/' || upper(replace(name, ' ', '-')) || '.pdf' AS url FROM products WHERE NOT regexp_matches(upper(name), '(^|[^A-Z])(COLD|HOT)([^A-Z]|$)')", "products")

# joins
reg.add("j1_star_join", lambda r: live(r, False).select("id", "product_name", "chain_slug", "category"), "SELECT id, product_name, chain_slug, category FROM active WHERE product_name IS NOT NULL", *A)
reg.add("j2_star_join_unmatched", lambda r: live(r).select("id", "product_name", "chain_slug", "category"), "SELECT id, product_name, chain_slug, category FROM active", *A)
reg.add("j3_count_per_dim", lambda r: op.count_per_dim(r.chains, live(r), "chain_id").select("slug", "n"), "SELECT c.slug, count(a.id) AS n FROM chains c LEFT JOIN active a ON a.chain_id = c.id GROUP BY c.slug", "active")
reg.add("j4_cross_chain_prices", lambda r: live(r, False).select("product_id", "product_name", "chain_slug", "price_cents", "id").orderBy("product_id", "price_cents", "id"), "SELECT product_id, product_name, chain_slug, price_cents, id FROM active WHERE product_id IS NOT NULL", *A)
reg.add("j5_national_chains", lambda r: op.national_chains(r.chains, live(r)), "SELECT * FROM chains WHERE id IN (SELECT chain_id FROM active WHERE store_id IS NULL)", *A)
reg.add("j7_abandoned_campaigns", lambda r: op.abandoned_campaigns(r.campaigns, r.offers.where("valid_from > DATE '1996-01-01'"), r.offers.where("price_cents % 5 = 0"), AS_OF).select("id"),
        f"SELECT id FROM campaigns WHERE valid_to < {D} - 14 AND id NOT IN (SELECT campaign_id FROM offers WHERE valid_from > DATE '1996-01-01') AND id NOT IN (SELECT campaign_id FROM offers WHERE price_cents % 5 = 0)", "campaigns")
reg.add("j10_best_offer_per_product", lambda r: r.products.select(F.col("id").alias("product_id"), "name").join(op.best_offer_per_product(pictured(r)), "product_id", "left"),
        """SELECT p.id AS product_id, p.name, b.* EXCLUDE (product_id) FROM products p LEFT JOIN (SELECT product_id, min(price_cents) AS best_cents, arg_min(chain_slug, (price_cents, id)) AS best_chain,
        first(discount_pct ORDER BY price_cents, id) AS best_discount, arg_min(original_cents, (price_cents, id)) AS best_original, count(DISTINCT chain_id) AS chains,
        arg_min('https://img/' || sku_id, (price_cents, id)) FILTER (WHERE sku_id % 4 <> 0) AS best_image FROM active GROUP BY product_id) b ON p.id = b.product_id""", *A)
reg.add("j19_loyalty_programs", lambda r: op.loyalty_programs(r.chains, live(r), r.spark.createDataFrame([("card",), ("app",)], "program string")).select("slug", "program", "card_offers", "card_skus"),
        "SELECT slug, program, coalesce(n, 0) AS card_offers, coalesce(s, 0) AS card_skus FROM chains CROSS JOIN (VALUES ('card'), ('app')) v(program) LEFT JOIN (SELECT chain_id, count(*) AS n, count(DISTINCT sku_id) AS s FROM active WHERE requires_card GROUP BY chain_id) a ON a.chain_id = chains.id", *A)
CATS = [(1, "economy"), (2, "promo"), (3, "large"), (4, "altro")]
CATSQL = "cats(id, slug) AS (VALUES (1, 'economy'), (2, 'promo'), (3, 'large'), (4, 'altro'))"
cats = lambda r: r.spark.createDataFrame(CATS, "id int, slug string")
reg.add("j20_link_taxonomy", lambda r: op.link_taxonomy(r.products, cats(r)).select("id", "category_id"), f"WITH {CATSQL} SELECT p.id, coalesce(c.id, 4) AS category_id FROM products p LEFT JOIN cats c ON p.category = c.slug", "products")
reg.add("j21_cluster_by_publication", lambda r: op.cluster_by_publication(r.stores, r.chains.selectExpr("concat('city-', id) AS city_slug", "concat('pub-', id % 4) AS publication"), F.expr("concat('city-', id % 25)")).selectExpr("publication", "array_join(transform(store_ids, x -> cast(x AS string)), ',') AS store_ids"),
        "SELECT 'pub-' || ((s.id % 25) % 4) AS publication, string_agg(s.id::VARCHAR, ',' ORDER BY s.id) AS store_ids FROM stores s WHERE s.id % 25 IN (SELECT id FROM chains) GROUP BY 1", "stores", "chains")
ITEMS = lambda r: r.list_items.selectExpr("list_id", "product_id", "IF(product_id % 5 = 0, 'fresco', NULL) AS category_override")
reg.add("j22_list_with_category", lambda r: op.list_with_category(ITEMS(r), r.products).select("list_id", "product_id", "category"), "SELECT list_id, product_id, CASE WHEN product_id % 5 = 0 THEN 'fresco' ELSE category END AS category FROM list_items JOIN products p ON p.id = product_id", "list_items", "products")

# aggregations
reg.add("g1_best_current_price", lambda r: op.best_current_price(live(r)), "SELECT coalesce('p' || product_id, 's' || sku_id) AS item, min(price_cents) AS min_cents, count(DISTINCT chain_id) AS chains, count(*) AS offers FROM active GROUP BY 1", *A)
SPREAD = """spread AS (SELECT product_id, count(DISTINCT chain_id) AS chains, count(*) AS offers, min(price_cents) AS min_cents, max(price_cents) AS max_cents, arg_min(chain_slug, (price_cents, chain_slug, id)) AS cheapest,
  string_agg(DISTINCT chain_slug, ',' ORDER BY chain_slug) AS chain_slugs, max(price_cents) - min(price_cents) AS spread_cents, (max(price_cents) - min(price_cents)) * 100 // max(price_cents) AS savings_pct
  FROM active WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(DISTINCT chain_id) >= 2)"""
reg.add("g2_price_spread", lambda r: op.price_spread(live(r)), f"WITH {SPREAD} SELECT * FROM spread", *A)
reg.add("g2_top_spreads", lambda r: op.top_spreads(op.price_spread(live(r))).select("product_id", "savings_pct", "spread_cents"), f"WITH {SPREAD} SELECT product_id, savings_pct, spread_cents FROM spread WHERE savings_pct BETWEEN 5 AND 89 ORDER BY savings_pct DESC, spread_cents DESC, product_id LIMIT 50", *A)
reg.add("g3_category_leaders", lambda r: op.category_leaders(live(r)), "SELECT category, chain_slug, count(*) AS leads, sum(price_cents)::BIGINT AS sum_cents, sum(price_cents)::DOUBLE / count(*) AS mean_cents FROM (SELECT *, min(price_cents) OVER (PARTITION BY product_id) AS low FROM active WHERE product_id IS NOT NULL) WHERE price_cents = low GROUP BY ALL", *A)
reg.add("g7_promotion_analytics", lambda r: op.promotion_analytics(r.offers, tagged(r)),
        f"WITH {TAGGED} SELECT chain_id, date_trunc('week', valid_from)::DATE AS week, tag, mechanic, requires_card, count(*) AS offers, count(DISTINCT sku_id) AS skus, min(price_cents) AS min_cents FROM (SELECT o.*, chain_id, unnest(CASE WHEN len(tags) = 0 THEN ['uncategorized'] ELSE tags END) AS tag FROM offers o JOIN tagged t ON o.sku_id = t.id) GROUP BY ALL", "offers", "skus")
reg.add("g8_current_promotions", lambda r: op.current_promotions(live(r)), "SELECT chain_slug, count(DISTINCT id) AS offers, count(DISTINCT sku_id) AS skus, count(*) FILTER (WHERE mechanic = 'loyalty_price') AS loyalty, count(*) FILTER (WHERE mechanic = 'percentage_off') AS percentage, count(*) FILTER (WHERE mechanic = 'price_cut') AS cuts, sum(discount_pct)::DOUBLE / count(discount_pct) AS mean_discount, max(valid_to) AS last_end FROM active GROUP BY chain_slug", *A)
reg.add("g13_status", lambda r: op.status(r.offers, r.skus, r.campaigns, AS_OF), f"SELECT * FROM (SELECT count(*) AS active_offers, count(DISTINCT sku_id) AS active_skus FROM active), (SELECT count(*) AS skus, count(product_id) AS matched_skus FROM skus), (SELECT count(*) AS campaigns, count(*) FILTER (WHERE {D} BETWEEN valid_from AND valid_to) AS open_campaigns FROM campaigns)", "active", "campaigns")
reg.add("g14_tag_counts", lambda r: op.tag_counts(tagged(r), live(r)), f"WITH {TAGGED} SELECT tag, count(DISTINCT id) AS skus FROM (SELECT id, unnest(tags) AS tag FROM tagged WHERE id IN (SELECT sku_id FROM active)) GROUP BY tag", *A)
reg.add("g15_offers_per_store", lambda r: op.offers_per_store(r.stores, live(r)), "SELECT s.id, s.chain_id, count(a.id) AS offers FROM stores s LEFT JOIN active a ON a.store_id = s.id GROUP BY ALL", "stores", "active")
reg.add("g16_offers_per_chain", lambda r: op.offers_per_chain(r.chains, live(r)), "SELECT c.id, c.slug, count(a.id) AS offers FROM chains c LEFT JOIN active a ON a.chain_id = c.id GROUP BY ALL", *A)
reg.add("g16_positive_chains", lambda r: op.offers_per_chain(r.chains, live(r), True), "SELECT c.id, c.slug, count(*) AS offers FROM chains c JOIN active a ON a.chain_id = c.id GROUP BY ALL", *A)
CARDS = "cards AS (SELECT sku_id, raw_name, chain_slug, min(price_cents) AS min_cents, max(price_cents) AS max_cents, max(discount_pct) AS best_discount, min(valid_from) AS valid_from, min(valid_to) AS first_end, max(valid_to) AS valid_to, count(DISTINCT store_id) AS stores, bool_or(store_id IS NULL) AS national FROM active GROUP BY ALL)"
reg.add("g17_deal_cards", lambda r: op.deal_cards(live(r)).drop("stores_json"), f"WITH {CARDS} SELECT * FROM cards", *A)
reg.add("g17_deal_card_stores", lambda r: op.deal_cards(live(r)).select("sku_id", "stores_json"),
        """SELECT sku_id, '[' || coalesce(string_agg('{"price_cents":' || price_cents || ',"store_id":' || store_id || '}', ',' ORDER BY price_cents, store_id) FILTER (WHERE store_id IS NOT NULL), '') || ']' AS stores_json FROM active GROUP BY sku_id, raw_name, chain_slug""", *A)
STATES = "CASE id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'loaded' END AS scrape_status"
reg.add("g18_chain_health", lambda r: op.chain_health(r.chains, r.offers.where("sku_id % 100 <> 5"), with_images(r), r.campaigns.where("chain_id % 9 <> 2").selectExpr("*", STATES, "date_sub(valid_from, CAST(id % 3 AS INT) + IF(chain_id % 2 = 0, 30, 0)) AS updated_at").where(f"updated_at <= {D}"), AS_OF),
        f"""WITH fc AS (SELECT *, {STATES}, valid_from - (id % 3)::INT - CASE WHEN chain_id % 2 = 0 THEN 30 ELSE 0 END AS updated_at FROM campaigns WHERE chain_id % 9 <> 2),
        f AS (SELECT chain_id, max(updated_at) AS last_update, count(*) FILTER (WHERE scrape_status = 'loaded' AND valid_to >= {D}) AS loaded_active, count(*) FILTER (WHERE scrape_status = 'failed' AND updated_at > {D} - 7) AS failed_recent,
          count(*) FILTER (WHERE scrape_status = 'empty' AND updated_at > {D} - 7) AS empty_recent FROM fc WHERE updated_at <= {D} GROUP BY chain_id),
        a AS (SELECT sku_id % 100 AS chain_id, count(*) AS n, round(count(*) FILTER (WHERE sku_id % 4 <> 0) * 100.0::DOUBLE / count(*), 1) AS pct FROM offers WHERE valid_to >= {D} AND sku_id % 100 <> 5 GROUP BY 1)
        SELECT c.id AS chain_id, slug, coalesce(n, 0) AS active_offers, pct AS pct_image, last_update, coalesce(loaded_active, 0) AS loaded_active, coalesce(failed_recent, 0) AS failed_recent, coalesce(empty_recent, 0) AS empty_recent,
          (coalesce(loaded_active, 0) > 0 AND coalesce(n, 0) = 0) OR coalesce({D} - last_update > 9, false) AS stale FROM chains c LEFT JOIN a ON a.chain_id = c.id LEFT JOIN f ON f.chain_id = c.id""", "offers", "campaigns", "chains")
reg.add("g19_match_coverage", lambda r: op.match_coverage(r.skus), "SELECT count(*) AS total, count(product_id) AS matched, count(DISTINCT product_id) AS products, count(*) FILTER (WHERE product_id IS NULL) AS unmatched FROM skus", "skus")
reg.add("g19_cross_chain_products", lambda r: op.cross_chain_products(r.skus), "SELECT product_id, count(DISTINCT chain_id) AS chains FROM skus WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT chain_id) >= 2", "skus")
reg.add("g21_modal_window", lambda r: op.modal_window(r.offers, ["campaign_id"], "id"), "SELECT campaign_id, valid_from, valid_to, n FROM (SELECT campaign_id, valid_from, valid_to, count(*) AS n, min(id) AS f FROM offers GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, f) = 1", "offers")
reg.add("g25_campaign_span", lambda r: op.campaign_span(r.offers.selectExpr("campaign_id % 10000 AS week", "mechanic", "id", "valid_from", "valid_to"), ["week"], "mechanic", "id"),
        "SELECT week, min(f) AS valid_from, max(t) AS valid_to, string_agg(mechanic, ' | ' ORDER BY i, mechanic) AS descriptions FROM (SELECT campaign_id % 10000 AS week, mechanic, min(id) AS i, min(valid_from) AS f, max(valid_to) AS t FROM offers GROUP BY ALL) GROUP BY week", "offers")
reg.add("g24_category_summary", lambda r: op.category_summary(r.products, cats(r)), f"WITH {CATSQL} SELECT coalesce(c.slug, n.slug) AS slug, coalesce(k, 0) AS products FROM cats c FULL JOIN (SELECT category AS slug, count(*) AS k FROM products GROUP BY 1) n ON c.slug = n.slug", "products")
reg.add("g27_list_groups", lambda r: op.list_groups(op.list_with_category(ITEMS(r), r.products)), "SELECT list_id, CASE WHEN product_id % 5 = 0 THEN 'fresco' ELSE category END AS category, count(*) AS items, string_agg(product_id::VARCHAR, ',' ORDER BY product_id) AS product_ids FROM list_items JOIN products p ON p.id = product_id GROUP BY 1, 2", "list_items", "products")

# windows, rankings, set operations
reg.add("w2_cheapest_per", lambda r: op.cheapest_per(live(r, False)).select("product_id", "chain_id", "id", "price_cents"), "SELECT product_id, chain_id, id, price_cents FROM active WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, chain_id ORDER BY price_cents, id) = 1", *A)
reg.add("w3_best_prices", lambda r: op.best_prices(live(r)).select("product_id", "id", "price_cents", "chains"), "SELECT a.product_id, id, price_cents, n AS chains FROM active a JOIN (SELECT product_id, count(DISTINCT chain_id) AS n FROM active GROUP BY 1) c ON a.product_id = c.product_id QUALIFY row_number() OVER (PARTITION BY a.product_id ORDER BY price_cents, id) = 1", *A)
reg.add("w4_top_discounts", lambda r: op.top_discounts(live(r)).select("raw_name", "id", "discount_pct"), "SELECT raw_name, id, discount_pct FROM (SELECT * FROM active WHERE discount_pct IS NOT NULL QUALIFY row_number() OVER (PARTITION BY raw_name ORDER BY discount_pct DESC, price_cents, id) = 1) ORDER BY discount_pct DESC, price_cents, id LIMIT 10", *A)
reg.add("t1_deals", lambda r: op.deals(live(r)).select(*L), f"SELECT {LS} FROM active ORDER BY discount_pct DESC NULLS LAST, price_cents, id LIMIT 100", *A)
reg.add("t2_expiring_first", lambda r: op.expiring_first(op.deal_cards(live(r))).select("sku_id", "first_end", "best_discount"), f"WITH {CARDS} SELECT sku_id, first_end, best_discount FROM cards ORDER BY first_end, best_discount DESC NULLS LAST, sku_id LIMIT 50", *A)
reg.add("t10_store_directory", lambda r: op.store_directory(r.stores, r.chains).select("slug", "id", "name", "place"), "SELECT slug, s.id, s.name, row_number() OVER (PARTITION BY chain_id ORDER BY s.name, s.id)::INT AS place FROM stores s JOIN chains c ON s.chain_id = c.id WHERE is_active QUALIFY place <= 5", "stores", "chains")
reg.add("t11_user_watches", lambda r: r.watches.where("user_id = 7").orderBy(F.desc("id")).select("id", "watch_type", "query"), "SELECT id, watch_type, query FROM watches WHERE user_id = 7 ORDER BY id DESC", "watches")
reg.add("u1_stores_and_networks", lambda r: op.stores_and_networks(r.stores, op.national_chains(r.chains, live(r))), "SELECT id, chain_id, name FROM stores WHERE is_active UNION ALL SELECT NULL, id, name || ' (national)' FROM chains WHERE id IN (SELECT chain_id FROM active WHERE store_id IS NULL)", "stores", "active")
reg.add("u2_union_all", lambda r: r.watches.where("id % 10 = 0").select("id").union(r.watches.where("id % 15 = 0").select("id")), "SELECT id FROM watches WHERE id % 10 = 0 UNION ALL SELECT id FROM watches WHERE id % 15 = 0", "watches")
reg.add("u3_unseen_union", lambda r: op.unseen_union(r.skus.where("id % 3 = 0").select("product_id", "id"), r.skus.where("id % 2 = 0").select("product_id", "id"), ["product_id"]),
        "SELECT product_id, id FROM skus WHERE id % 3 = 0 UNION ALL SELECT product_id, id FROM skus s WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM skus t WHERE t.id % 3 = 0 AND t.product_id = s.product_id)", "skus")
