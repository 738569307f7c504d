"""Scalar functions, sources, extraction and streaming over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import similarity as sm
from ..functions import sql
from ..operators import alerts as al
from ..operators import extract as ex
from ..operators import layouts as ly
from ..operators import matching as ma
from ..operators import tables as tb
from ..operators import writes as wr
from ..sources import documents as src
from ..sources.views import AS_OF, NOW
from ..storage import Scratch
from ..streaming import streams as st
from .registry import Registry, live, tagged

reg = Registry()
P = ("products",)
CENTS = "(1 + (id * 37) % 99999)"

reg.add("e1_parse_price", lambda r: r.products.select("id", F.round(fn.parse_price(F.expr(f"concat('€ ', IF(id % 2 = 0, 'da ', ''), {CENTS} div 100, ',', lpad({CENTS} % 100, 2, '0'))")) * 100).cast("long").alias("cents")), f"SELECT id, {CENTS}::BIGINT AS cents FROM products", *P)
reg.add("e2_parse_quantity", lambda r: r.products.select("id", fn.parse_quantity(F.expr("CASE id % 5 WHEN 0 THEN concat(id % 9 + 1, 'x125 g') WHEN 1 THEN concat('1,5 l x ', id % 4 + 1) WHEN 2 THEN concat(id % 90 + 1, ' cl') WHEN 3 THEN concat(id % 12 + 1, ' pz') ELSE concat('conf da ', id % 12 + 1) END")).alias("q")).selectExpr("id", "CAST(round(q.base_value * 10000) AS BIGINT) AS parts", "q.base_unit"),
        "SELECT id, (CASE id % 5 WHEN 0 THEN (id % 9 + 1) * 1250 WHEN 1 THEN (id % 4 + 1) * 15000 WHEN 2 THEN (id % 90 + 1) * 100 ELSE (id % 12 + 1) * 10000 END)::BIGINT AS parts, CASE id % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' WHEN 2 THEN 'L' ELSE 'unit' END AS base_unit FROM products", *P)
reg.add("e3_parse_mechanic", lambda r: r.products.select("id", fn.parse_mechanic(F.expr("CASE id % 6 WHEN 0 THEN 'Prendi 2 paghi 1' WHEN 1 THEN 'offerta 3x2' WHEN 2 THEN 'Secondo pezzo al 50%' WHEN 3 THEN 'Sottocosto' WHEN 4 THEN 'con Carta fedeltà' ELSE concat('-', id % 80 + 10, ' %') END"), F.expr("IF(id % 4 = 0, concat(id % 9 + 1, '%'), NULL)")).alias("m")).selectExpr("id", "m.mechanic", "m.discount"),
        "SELECT id, CASE id % 6 WHEN 0 THEN 'two_for_price_of_one' WHEN 1 THEN 'three_for_two' WHEN 2 THEN 'second_half_price' WHEN 3 THEN 'sottocosto' WHEN 4 THEN 'loyalty_price' ELSE 'percentage_off' END AS mechanic, (CASE id % 6 WHEN 0 THEN 50 WHEN 1 THEN 33.3 WHEN 2 THEN 25 WHEN 5 THEN id % 80 + 10 END)::DOUBLE AS discount FROM products", *P)
reg.add("e4_unit_price", lambda r: r.raw("part").select(F.col("p_partkey").alias("id"), fn.unit_price(F.lit(100.0), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 5 == 0, 1.5)).alias("u")).selectExpr("id", "CAST(round(u * 1000) AS BIGINT) AS milli"), "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 1500 ELSE round(round(100.0::DOUBLE / nullif(p_size, 0), 4) * 1000)::BIGINT END AS milli FROM part")
reg.add("e5_discount_cascade", lambda r: live(r).select("id", fn.discount(F.when(F.col("price_cents") % 3 == 0, 95), F.when(F.col("price_cents") % 5 != 0, F.col("discount_pct")), F.col("price_cents"), F.col("original_cents")).cast("int").alias("pct")),
        """SELECT id, CASE WHEN found > 0 AND found < 90 THEN found::INT END AS pct FROM (SELECT id, CASE WHEN price_cents % 3 = 0 THEN 95 WHEN price_cents % 5 <> 0 AND discount_pct IS NOT NULL THEN discount_pct
        WHEN price_cents < original_cents THEN round((1 - price_cents::DOUBLE / original_cents) * 100) END AS found FROM active)""", "active")
reg.add("e6_clean_ean", lambda r: r.products.select("id", fn.clean_ean(F.expr("IF(id % 2 = 0, concat('x', id), concat('80-', lpad(id, 8, '0')))"), F.expr("concat('EAN ', lpad(id, 13, '9'))")).alias("ean")), "SELECT id, CASE WHEN id % 2 = 0 THEN lpad(id::VARCHAR, 13, '9') ELSE '80' || lpad(id::VARCHAR, 8, '0') END AS ean FROM products", *P)
reg.add("e7_card_name", lambda r: live(r).select("id", fn.card_name(F.col("chain_name"), F.concat("chain_name", F.lit(" Gold")), F.col("mechanic")).alias("card")), "SELECT id, CASE WHEN mechanic = 'loyalty_price' THEN 'Gold' END AS card FROM active", "active")
reg.add("e8_raw_quantity", lambda r: r.skus.select("id", fn.raw_quantity(F.upper("raw_quantity")).alias("u"), fn.raw_quantity(F.concat(F.lit("  "), "raw_quantity")).alias("q")), "SELECT id, raw_quantity AS u, raw_quantity AS q FROM skus", "skus")
reg.add("e9_norm_text", lambda r: r.skus.select("id", fn.norm_text(F.concat(F.lit("  "), F.upper("raw_name"), F.lit("  x "))).alias("n")), "SELECT id, lower(raw_name) || ' x' AS n FROM skus", "skus")
reg.add("e10_match_key", lambda r: r.skus.select("id", fn.match_key(F.lit("Acme"), F.concat(F.lit("ACME "), "raw_name", F.lit(" di Città")), F.lit("1 kg")).alias("k")), "SELECT id, 'acme|' || lower(raw_name) || ' citta|1000 g' AS k FROM skus", "skus")
reg.add("e11_normalize_quantity", lambda r: r.raw("part").withColumn("id", F.col("p_partkey")).select("id", fn.normalize_quantity(F.expr("CASE id % 3 WHEN 0 THEN concat(id % 7 + 1, ',5KG') WHEN 1 THEN concat(id % 7 + 1, ' x ', p_size, 'g') ELSE concat(p_size, 'cl') END")).alias("n")), "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN (p_partkey % 7 + 1) * 1000 + 500 || ' g' WHEN 1 THEN (p_partkey % 7 + 1) || 'x' || p_size || ' g' ELSE p_size * 10 || ' ml' END AS n FROM part", *P)
reg.add("e12_slugify", lambda r: r.products.select("id", fn.slugify(F.concat(F.lit("Caffè -- "), "name", F.lit("!"))).alias("s")), "SELECT id, 'caffe-' || replace(name, ' ', '-') AS s FROM products", *P)
# names with every part of the fixed tables in turn; the SQL applies the same tables
PARTS = [p.replace(r"\b", "") for _, parts in fn.CATEGORY_PARTS for p in parts] + ["lavagna"]
TAG_PARTS = [p for parts in fn.TAGS.values() for p in parts] + ["nulla"]
with_part = lambda parts: f"concat(name, ' ', element_at(array({', '.join(map(repr, parts))}), CAST(id % {len(parts)} AS INT) + 1))"
with_part_sql = lambda parts: f"(name || ' ' || list_extract([{', '.join(map(repr, parts))}], (id % {len(parts)} + 1)::BIGINT))"
reg.add("e13_infer_category", lambda r: r.products.select("id", fn.infer_category(F.expr(f"upper({with_part(PARTS)})")).alias("c")), "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(n, '{'|'.join(parts)}') THEN '{slug}'" for slug, parts in fn.CATEGORY_PARTS) + f" ELSE 'altro' END AS c FROM (SELECT id, lower({with_part_sql(PARTS)}) AS n FROM products)", *P)
# rules over name, brand and category: words, runs of words, and words that must be followed by another one
RULES = [(1, "fredo", "cold ring"), (2, "viti", "bolt "), (3, "marca", "brand 13"), (4, "ottone", "polished brass"), (5, "caldo", "hot"), (6, "piccolo", "small"), (7, "acciaio", "steel"), (8, "anelli", "ring "), (9, "rame", "copper")]
TEXT = "lower(p.name || ' ' || replace(p.brand, '#', ' ') || ' ' || p.category) || ' '"
reg.add("e14_keyword_classifier", lambda r: ma.classify(r.products.select("id", F.upper("name").alias("name"), "brand", F.col("category").alias("description")), r.spark.createDataFrame(RULES, "rank int, slug string, keyword string")).select("id", "slug"),
        "SELECT id, CASE " + " ".join(f"WHEN contains(' ' || t, ' {k.strip()} ') THEN '{slug}'" for _, slug, k in RULES) + f" ELSE 'altro' END AS slug FROM (SELECT id, {TEXT} AS t FROM products p)", *P)
reg.add("e14_name_only", lambda r: ma.classify(r.products.select("id", "name"), r.spark.createDataFrame(RULES, "rank int, slug string, keyword string")).select("id", "slug"),
        "SELECT id, CASE " + " ".join(f"WHEN contains(' ' || name || '{'' if k.endswith(' ') else ' '}', ' {k.strip()} ') THEN '{slug}'" for _, slug, k in RULES) + " ELSE 'altro' END AS slug FROM products", *P)
reg.add("e15_tags", lambda r: r.products.select("id", F.array_join(fn.dietary_tags(F.expr(f"upper({with_part(TAG_PARTS)})")), ",").alias("t")), "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(n, {p!r})' for p in parts)} THEN '{tag}' END" for tag, parts in fn.TAGS.items()) + f") AS t FROM (SELECT id, lower({with_part_sql(TAG_PARTS)}) || ' ' AS n FROM products)", *P)
reg.add("e18_week", lambda r: r.offers.select("id", fn.week_start(F.col("valid_from")).alias("monday"), fn.current_week(F.col("valid_from"))["sunday"].alias("sunday")), "SELECT id, date_trunc('week', valid_from)::DATE AS monday, date_trunc('week', valid_from)::DATE + 6 AS sunday FROM offers", "offers")
reg.add("e19_italian_dates", lambda r: r.campaigns.select("id", fn.italian_range(F.expr("CASE id % 3 WHEN 0 THEN concat('dal ', day(valid_from), '/', month(valid_from), ' al ', day(valid_to), '/', month(valid_to)) WHEN 1 THEN concat('DAL ', day(valid_from), ' ', element_at(array('gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre'), month(valid_from)), ' AL ', day(valid_to), ' ', element_at(array('gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre'), month(valid_to))) ELSE concat('fino al ', day(valid_to), ' marzo 1999') END"), F.lit(1996)).alias("d")).select("id", "d.*"),
        "SELECT id, CASE WHEN id % 3 <> 2 THEN make_date(1996, month(valid_from), day(valid_from)) END AS valid_from, CASE WHEN id % 3 <> 2 THEN make_date(1996, month(valid_to), day(valid_to)) ELSE make_date(1999, 3, day(valid_to)) END AS valid_to FROM campaigns", "campaigns")
reg.add("e19_compact_dates", lambda r: r.offers.select("id", fn.compact_date(F.concat(F.date_format("valid_from", "yyyyMMdd"), F.expr("IF(price_cents % 2 = 0, '235959', '')"))).alias("day")), "SELECT id, valid_from AS day FROM offers", "offers")
reg.add("e20_split_brand", lambda r: r.skus.select("id", fn.split_brand(F.concat(F.expr("IF(id % 2 = 0, 'Mulino Verde ', 'ACME CO ')"), F.lower("raw_name")), ["Mulino", "Mulino Verde"]).alias("b")).select("id", "b.*"), "SELECT id, CASE WHEN id % 2 = 0 THEN 'Mulino Verde' ELSE 'ACME CO' END AS brand, lower(raw_name) AS rest FROM skus", "skus")
reg.add("e21_split_size", lambda r: r.skus.select("id", fn.split_size(F.concat_ws(" ", "raw_name", "raw_quantity")).alias("s")).select("id", "s.*"), "SELECT id, raw_name AS name, raw_quantity AS size FROM skus", "skus")
# each store's distance to the first store of its chain
HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2))))"
reg.add("e22_distance", lambda r: r.stores.join(r.stores.groupBy("chain_id").agg(F.min_by(F.struct("lat", "lng"), "id").alias("f")), "chain_id").select("id", F.round(sm.distance_km(F.col("lat"), F.col("lng"), F.col("f.lat"), F.col("f.lng")) * 10).cast("long").alias("hm")),
        f"SELECT a.id, round(10 * {HAVERSINE})::BIGINT AS hm FROM stores a JOIN (SELECT chain_id, arg_min(lat, id) AS lat, arg_min(lng, id) AS lng FROM stores GROUP BY 1) b USING (chain_id)", "stores")
reg.add("e22_great_circle", lambda r: r.stores.select("id", F.round(sm.distance_km(F.col("lat"), F.col("lng"), F.lit(45.3), F.lit(11.0)) * 10).cast("long").alias("hm")),
        "SELECT id, round(10 * 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(45.3::DOUBLE) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(45.3::DOUBLE)) * pow(sin((radians(11.0::DOUBLE) - radians(lng)) / 2), 2)))))::BIGINT AS hm FROM stores", "stores")
reg.add("e23_json", lambda r: r.api_events.select("id", F.get_json_object("metadata", "$.k").cast("long").alias("k"), F.get_json_object("metadata", "$.none").isNotNull().alias("has"), F.to_json(F.struct(F.col("event_type").alias("t"))).alias("j")), """SELECT id, json_extract_string(metadata, '$.k')::BIGINT AS k, json_exists(metadata, '$.none') AS has, '{"t":"' || event_type || '"}' AS j FROM api_events""", "api_events")
reg.add("e24_arrays", lambda r: r.list_items.groupBy("list_id").agg(F.array_sort(F.collect_list("product_id")).alias("a")).select("list_id", F.size(F.array_append("a", F.lit(1))).alias("n"), F.arrays_overlap("a", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("o")), "SELECT list_id, (count(*) + 1)::INT AS n, bool_or(product_id IN (1, 2)) AS o FROM list_items GROUP BY 1", "list_items")
reg.add("e25_ip_hash", lambda r: r.stores.select("id", fn.ip_hash(F.col("name"), "pepper").alias("h")), "SELECT id, substr(sha256(name || 'pepper'), 1, 16) AS h FROM stores", "stores")
reg.add("e26_encryption", lambda r: r.raw("customer").select(F.col("c_custkey").alias("id"), fn.decrypt(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(fn.encrypt(F.col("c_name"), F.lit("0123456789abcdef"))), F.lit("0123456789abcdef")).alias("name")), "SELECT c_custkey AS id, c_name AS name FROM customer")
reg.add("e27_links", lambda r: r.stores.select("id", fn.maps_link((F.col("id") % 90).cast("int"), (F.col("id") % 80).cast("int")).alias("m"), fn.image_search_link(F.lit("cold"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("i")), "SELECT id, 'https://www.google.com/maps?q=' || id % 90 || ',' || id % 80 AS m, 'https://www.google.com/search?tbm=isch&q=cold+n' || id AS i FROM stores", "stores")
reg.add("e28_numeric", lambda r: r.offers.selectExpr("id", "greatest(price_cents, original_cents) AS g", "least(price_cents, original_cents) AS l", "nullif(discount_pct, 10) AS n", "CAST(unix_timestamp(CAST(valid_from AS TIMESTAMP)) AS BIGINT) AS e"), "SELECT id, greatest(price_cents, original_cents) AS g, least(price_cents, original_cents) AS l, nullif(discount_pct, 10) AS n, epoch(valid_from)::BIGINT AS e FROM offers", "offers")

# sources: job results made from the offers of each campaign
JOBS = lambda r: r.offers.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("id", "price_cents", "sku_id"))).alias("o")).selectExpr(
    "CAST(campaign_id AS STRING) AS job_id", "'x' AS chain",
    "array(named_struct('page', 1, 'raw_text', 't', 'extracted', IF(campaign_id % 2 = 0, to_json(transform(o, x -> map('prodotto', x.id, 'prezzo', cast(x.price_cents AS string)))), to_json(map_from_arrays(transform(o, (x, i) -> cast(i AS string)), transform(o, x -> map('product_name', x.id, 'price', cast(x.price_cents AS string)))))), 'valid_from', '1998-01-01', 'valid_to', '1998-01-07'), named_struct('page', 2, 'raw_text', 't', 'extracted', to_json(map('nome_prodotto', o[0].id, 'prezzo', '7', 'valid_from', '1997-12-31')), 'valid_from', '1998-01-01', 'valid_to', '1998-01-07')) AS results")
flat = lambda r: src.unify_fields(src.flatten_extracted(src.explode_results(JOBS(r)).drop("valid_from", "valid_to")))


def _json_round_trip(r):
    scratch = Scratch(r.spark, "jobs")
    JOBS(r).write.json(scratch.path + "/jobs")
    return src.read_job_results(r.spark, scratch.path + "/jobs", one_per_file=False).groupBy("job_id", "page").agg(F.count("*").alias("n"), F.max("valid_to").alias("t"))


CASES = "SELECT campaign_id::VARCHAR AS job_id, id AS name, price_cents::VARCHAR AS price FROM offers UNION ALL SELECT campaign_id::VARCHAR, min(struct_pack(id, price_cents, sku_id)).id, '7' FROM offers GROUP BY campaign_id"
reg.add("s1_read_job_results", _json_round_trip, "SELECT DISTINCT campaign_id::VARCHAR AS job_id, unnest([1, 2])::INT AS page, 1::BIGINT AS n, '1998-01-07' AS t FROM (SELECT DISTINCT campaign_id FROM offers)", "offers")
reg.add("s2_flatten_extracted", lambda r: src.flatten_extracted(src.explode_results(JOBS(r))).groupBy("job_id").agg(F.count("*").alias("n")), f"SELECT job_id, count(*) AS n FROM ({CASES}) GROUP BY 1", "offers")
# results with numbers and nested lists: an array on even campaigns, an object of places on odd ones
NESTED = lambda r: r.offers.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("id", "price_cents", "sku_id"))).alias("o")).selectExpr(
    "campaign_id AS job_id", "CASE WHEN campaign_id % 2 = 0 THEN to_json(transform(o, x -> named_struct('prodotto', x.id, 'prezzo', x.price_cents / 100, 'formati', array(x.sku_id % 7, x.sku_id % 3)))) ELSE to_json(map_from_arrays(transform(o, (x, i) -> cast(i AS string)), transform(o, x -> named_struct('product_name', x.id, 'price', x.price_cents / 100, 'formati', array(x.sku_id % 7, x.sku_id % 3))))) END AS extracted")
reg.add("s2_flatten_variant", lambda r: src.unify_variant(src.flatten_variant(NESTED(r)), kinds={"price": "double"}).select("job_id", "name", F.round(F.col("price") * 100).cast("long").alias("cents"), (F.try_variant_get("item", "$.formati[0]", "int") + F.try_variant_get("item", "$.formati[1]", "int")).alias("formats")),
        "SELECT campaign_id AS job_id, id AS name, price_cents AS cents, (sku_id % 7 + sku_id % 3)::INT AS formats FROM offers", "offers")
reg.add("s3_unify_fields", lambda r: flat(r).select("job_id", "name", "price"), CASES, "offers")
reg.add("s4_propagate_validity", lambda r: src.propagate_validity(flat(r), src.explode_results(JOBS(r))).groupBy("job_id", "valid_from", "valid_to").agg(F.count("*").alias("n")), "SELECT campaign_id::VARCHAR AS job_id, '1998-01-01' AS valid_from, '1998-01-07' AS valid_to, count(*) AS n FROM offers GROUP BY 1 UNION ALL SELECT campaign_id::VARCHAR, '1997-12-31', '1998-01-07', 1 FROM offers GROUP BY campaign_id", "offers")
reg.add("s5_union_pages", lambda r: src.union_pages([r.skus.where("id % 3 = 0").select("id", "brand"), r.skus.where("id % 3 = 1").select("id"), r.skus.where("id % 3 = 2").select("brand", "id")]), "SELECT id, CASE WHEN id % 3 <> 1 THEN brand END AS brand FROM skus", "skus")


def _csv_round_trip(r):
    scratch = Scratch(r.spark, "csv")
    src.write_worklist(r.skus.selectExpr("id", "concat('https://img/', id, IF(id % 2 = 0, '', ' bad'))  AS image_url"), scratch.path + "/csv")
    return src.apply_image_csv(r.skus.withColumn("image_url", F.lit(None).cast("string")), src.read_image_csv(r.spark, scratch.path + "/csv")).select("id", "image_url")


reg.add("s14_apply_image_csv", _csv_round_trip, "SELECT id, CASE WHEN id % 2 = 0 THEN 'https://img/' || id END AS image_url FROM skus", "skus")
SLUGS = [slug for slug, _, _ in src.CATEGORIES]
reg.add("s17_taxonomy_use", lambda r: r.products.select(F.element_at(F.array(*map(F.lit, SLUGS)), (F.col("id") % 18 + 1).cast("int")).alias("slug")).join(src.taxonomy(r.spark), "slug").groupBy("slug", "name", "sort_order").agg(F.count("*").alias("n")),
        "SELECT c.slug, c.name, c.sort_order::INT AS sort_order, count(*) AS n FROM products p JOIN (VALUES " + ", ".join(f"({i}, '{s}', '{n}', {o})" for i, (s, n, o) in enumerate(src.CATEGORIES)) + ") c(i, slug, name, sort_order) ON c.i = p.id % 18 GROUP BY ALL", *P)
reg.add("s18_pivot_properties", lambda r: src.pivot_properties(live(r).selectExpr("id", "array(named_struct('code', 'name', 'values', array(raw_name)), named_struct('code', 'price', 'values', array(cast((price_cents - 100000) / 100.0 AS string))), named_struct('code', 'hidden', 'values', IF(price_cents % 3 = 0, array('true'), array()))) AS props"), ["name", "price", "hidden"]).select("id", "name", F.round(F.col("price") * 100).cast("long").alias("cents")), "SELECT id, raw_name AS name, price_cents - 100000 AS cents FROM active WHERE price_cents > 100000 AND price_cents % 3 <> 0", "active")

# extraction
reg.add("x1_cards", lambda r: ex.extract_cards(r.raw("pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), r'<a href="[^"]*">[^<]*</a>', {"href": r'href="([^"]*)"', "label": r">([^<]*)<"}, key="href").select("doc_id", "href", "label"),
        """SELECT doc_id, regexp_extract(c, 'href="([^"]*)"', 1) AS href, nullif(regexp_extract(c, '>([^<]*)<', 1), '') AS label FROM (SELECT page_id AS doc_id, unnest(l) AS c, unnest(range(len(l))) AS p FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)) QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_extract(c, 'href="([^"]*)"', 1) ORDER BY p) = 1""")
# pages of the live offers of some neighbouring products: as many as there are products
FLY = lambda r: live(r).groupBy(F.expr("sku_id div 500").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("id", "raw_name", "price_cents"))).alias("o"))
FLYSQL = "fly AS (SELECT sku_id // 500 AS doc_id, id, raw_name, price_cents, row_number() OVER (PARTITION BY sku_id // 500 ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY sku_id // 500) AS n FROM active)"
EUR = "concat(x.price_cents div 100, ',', lpad(x.price_cents % 100, 2, '0'))"
reg.add("x2_anchors", lambda r: ex.extract_anchored(FLY(r).selectExpr("doc_id", f"array_join(transform(o, x -> concat(x.raw_name, ' scad. lotto ', {EUR}, ' €')), '\\n') AS text"), r"\d{1,4}[.,]\d{2} €", r"scad\. lotto").selectExpr("doc_id", "pos", "name", "CAST(round(price * 100) AS BIGINT) AS cents"), f"WITH {FLYSQL} SELECT doc_id, pos::INT AS pos, raw_name AS name, price_cents AS cents FROM fly WHERE price_cents < 1000000", "active")
reg.add("x3_sections", lambda r: ex.extract_sections(FLY(r).selectExpr("doc_id", "array_join(flatten(transform(o, (x, i) -> IF(i % 3 = 0, array(concat('## S', i), x.id), array(x.id)))), '\\n') AS text"), r"^## (.*)$").select("doc_id", F.col("line").alias("id"), "section"), f"WITH {FLYSQL} SELECT doc_id, id, 'S' || (pos - pos % 3) AS section FROM fly", "active")
reg.add("x4_blocks", lambda r: ex.extract_blocks(FLY(r).selectExpr("doc_id", f"array_join(flatten(transform(o, x -> array(concat('* ', x.id), x.raw_name, concat('al kg ', {EUR})))), '\\n') AS text"), r"^\* ").select("doc_id", F.col("block").cast("int").alias("block"), "carried"), f"WITH {FLYSQL} SELECT doc_id, (pos + 1)::INT AS block, lag((price_cents // 100) || ',' || lpad((price_cents % 100)::VARCHAR, 2, '0')) OVER (PARTITION BY doc_id ORDER BY pos) AS carried FROM fly", "active")
reg.add("x5_passes", lambda r: ex.extract_passes(FLY(r).selectExpr("doc_id", f"array_join(transform(o, x -> concat(x.id, '\\nconservare in frigo\\n', IF(x.price_cents % 2 = 0, 'solo ', ''), {EUR}, ' €')), '\\n') AS text"), [r"solo \d{1,4}[.,]\d{2} €", r"\d{1,4}[.,]\d{2} €"], stop="conservare|€|solo").select("doc_id", "name", "pass"), f"WITH {FLYSQL} SELECT doc_id, id AS name, CASE WHEN price_cents % 2 = 0 THEN 0 ELSE 1 END AS pass FROM fly", "active")
# two prices, a price and one for each, and a price carried over from the line before, in turn
MONEY = lambda c: f"concat({c} div 100, ',', lpad({c} % 100, 2, '0'))"
BLOCK_PAGE = f"""array_join(flatten(transform(o, (x, i) -> concat(IF(i % 3 = 2, array({MONEY('(x.price_cents + 100)')}), array({MONEY('x.price_cents')}, concat(IF(i % 3 = 1, 'cad. ', ''), {MONEY('(x.price_cents + 100)')}))), array('/', x.raw_name, '500 g'),
  array(concat('al kg Euro 1,00', IF(i % 3 = 1 AND i + 1 < size(o), concat(' ', {MONEY('o[i + 1].price_cents')}), '')))))), '\n') AS text"""
reg.add("x4_price_blocks", lambda r: ly.extract_price_blocks(FLY(r).selectExpr("doc_id", BLOCK_PAGE)).selectExpr("doc_id", "name", "CAST(round(offer * 100) AS BIGINT) AS offer", "CAST(round(original * 100) AS BIGINT) AS original", "unit", "quantity", "discount"),
        f"WITH {FLYSQL} SELECT doc_id, raw_name AS name, price_cents AS offer, price_cents + 100 AS original, 'kg' AS unit, '500 g' AS quantity, round((1 - (price_cents / 100.0::DOUBLE) / ((price_cents + 100) / 100.0::DOUBLE)) * 100)::INT AS discount FROM fly", "active")
PASS_PAGE = f"""concat('Offerta valida\n', array_join(transform(o, (x, i) -> concat(upper(x.raw_name), '\n', CASE i % 4 WHEN 0 THEN concat({EUR}, ' €\n-20% € ', {MONEY('(x.price_cents + 100)')}) WHEN 1 THEN concat({EUR}, ' €\n€/kg 1,00') WHEN 2 THEN concat({EUR}, '\n€\nal kg') ELSE '30%' END)), '\n'), '\nfine') AS text"""
reg.add("x5_price_passes", lambda r: ly.extract_by_passes(FLY(r).selectExpr("doc_id", PASS_PAGE)).selectExpr("doc_id", "name", "pass", "CAST(round(offer * 100) AS BIGINT) AS offer", "CAST(round(original * 100) AS BIGINT) AS original", "discount", "unit"),
        f"""WITH {FLYSQL}, p AS (SELECT doc_id, upper(raw_name) AS name, CASE pos % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 7 END AS pass, CASE WHEN pos % 4 < 3 THEN price_cents END AS offer, CASE WHEN pos % 4 = 0 THEN price_cents + 100 END AS original, CASE pos % 4 WHEN 0 THEN 20 WHEN 3 THEN 30 END AS discount, CASE WHEN pos % 4 IN (1, 2) THEN 'kg' END AS unit, pos FROM fly)
        SELECT doc_id, name, pass, offer, original, discount, unit FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, name, coalesce(offer, -1) ORDER BY pass, pos) = 1""", "active")
reg.add("x6_repairs", lambda r: ex.repair(live(r).selectExpr("id", "chain_id AS doc_id", "valid_from", "IF(price_cents % 2 = 0, valid_to, NULL) AS valid_to", "array('', ' ', concat('https://', id)) AS images"), r.chains.where("id % 5 = 0").selectExpr("id AS doc_id", "DATE '1998-06-01' AS valid_from", "CAST(NULL AS DATE) AS valid_to")).select("id", "valid_from", "valid_to", "image_url"),
        "SELECT id, CASE WHEN chain_id % 5 = 0 THEN DATE '1998-06-01' ELSE valid_from END AS valid_from, CASE WHEN price_cents % 2 = 0 THEN valid_to WHEN chain_id % 5 = 0 THEN DATE '1998-06-07' ELSE valid_from + 6 END AS valid_to, 'https://' || id AS image_url FROM active", "active")


# streaming forms, run to the end of what there is
def _stream(r, df, name):
    scratch = Scratch(r.spark, name)
    df.write.parquet(scratch.path + "/in")
    return r.spark.readStream.schema(df.schema).parquet(scratch.path + "/in"), scratch


def _daily(r):
    events, scratch = _stream(r, r.api_events, "st1")
    out = st.daily_event_counts(events, "60 days")
    # a group goes to the sink again when it changes, until the watermark closes it; the last state of each is the result
    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(f"{scratch.path}/out/batch={batch_id}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch.path + "/cp").trigger(availableNow=True).start().awaitTermination()
    return r.spark.read.parquet(scratch.path + "/out").groupBy("day", "event_type").agg(F.max_by("events", "batch").alias("events"), F.max_by("sessions", "batch").alias("sessions"))


def _daily_sessions(r):
    """Daily counts of the stream, and whether its sessions lie within three standard errors (5 % each) of the exact ones."""
    exact = r.api_events.groupBy("day", "event_type").agg(F.count_distinct("session_id").alias("s"))
    return _daily(r).join(exact, ["day", "event_type"]).select("day", "event_type", "events", (F.abs(F.col("sessions") - F.col("s")) <= 0.15 * F.col("s") + 1).alias("sessions_near"))


def _alerts(r, batches=1, k=10):
    """Alerts of the offers in some micro-batches, without those that were sent before the stream began."""
    scratch = Scratch(r.spark, "st2")
    live(r).repartition(batches, "id").write.parquet(scratch.path + "/in")
    there = r.spark.read.parquet(scratch.path + "/in")
    # as many batches as asked for, however many files there are
    offers = r.spark.readStream.schema(there.schema).option("maxFilesPerTrigger", max(1, -(-len(there.inputFiles()) // batches))).parquet(scratch.path + "/in")
    # what every batch reads is made once; only the tags of SKUs on offer can match
    tags = scratch.table(tagged(r, there.select(F.col("sku_id").alias("id"), "raw_name").distinct()))
    told, sink = scratch.table(r.told), st.AlertSink(r.spark, scratch.path + "/sent")
    st.stream_alerts(offers, r.watches, tags, sink, scratch.path + "/cp", k, sent_to_users=told).awaitTermination()
    return sink.read()


def _history(r):
    offers, scratch = _stream(r, PRICED(r), "st3")
    last: list[str] = []

    def write(df, batch_id):
        df.write.mode("overwrite").parquet(f"{scratch.path}/h/{batch_id}")
        last[:] = [f"{scratch.path}/h/{batch_id}"]

    st.stream_history(offers, lambda: r.spark.read.parquet(last[0]) if last else None, write, scratch.path + "/cp").awaitTermination()
    return r.spark.read.parquet(last[0])


from .relational import TAGGED  # noqa: E402
from .registry import TAG_WORDS  # noqa: E402
from .search_writes import HIST, MATCHSQL, PRICED  # noqa: E402

reg.add("st1_daily_sessions", _daily_sessions, "SELECT day, event_type, count(*) AS events, true AS sessions_near FROM api_events GROUP BY ALL", "api_events")
reg.add("st1_daily_counts", lambda r: _daily(r).drop("sessions"), "SELECT day, event_type, count(*) AS events FROM api_events GROUP BY ALL", "api_events")
reg.add("st2_stream_alerts", _alerts, f"WITH {MATCHSQL} SELECT watch_id, offer_id FROM m WHERE (watch_id, offer_id) NOT IN (SELECT watch_id, offer_id FROM notified) QUALIFY row_number() OVER (PARTITION BY watch_id ORDER BY discount_pct DESC NULLS LAST, price_cents, offer_id) <= 10", "watches", "active", "notified")
reg.add("st2_stream_batches", lambda r: _alerts(r, 3, 1 << 30), f"WITH {MATCHSQL} SELECT DISTINCT watch_id, offer_id FROM m WHERE (watch_id, offer_id) NOT IN (SELECT watch_id, offer_id FROM notified)", "watches", "active", "notified")
reg.add("st3_stream_history", _history, f"{HIST} GROUP BY 1, 2", "offers")


def _purge_counts(r):
    counts = tb.purge_counted(r.offers, AS_OF, Scratch(r.spark, "purge").path + "/kept")
    return r.spark.createDataFrame([(counts["kept"], counts["purged"])], "kept long, purged long")


def _reject_counts(r):
    rules = [("no_brand", F.col("brand").isNull()), ("unmatched", F.col("product_id").isNull()), ("banner", F.length("raw_name") < 8)]
    counts = tb.rejects_counted(r.skus, rules, Scratch(r.spark, "rejects").path + "/rows")
    return r.spark.createDataFrame(sorted(counts.items()), "reason string, n long")


def _swapped(r):
    """All offers, of which two campaigns in ten are replaced, one in ten with nothing, and one store of another tenth."""
    table = tb.ScopedTable(r.spark, Scratch(r.spark, "swap").path)
    ids = lambda rest: r.campaigns.where(f"id % 10 IN ({rest})").select(F.col("id").alias("campaign_id"))
    renamed = lambda rest, mark: r.offers.where(f"campaign_id % 10 IN ({rest})").withColumn("id", F.concat("id", F.lit(mark)))
    table.replace(r.offers, ids("0, 1, 2, 3, 4, 5, 6, 7, 8, 9"))
    table.replace(renamed("1, 2", "-n"), ids("1, 2, 3"))
    table.replace(renamed("4", "-s").where("store_id = 3"), ids("4").withColumn("store_id", F.lit(3).cast("long")))
    return table.read().groupBy("campaign_id").agg(F.count("*").alias("n"), F.max("id").alias("m"))


def _cascaded(r):
    users = r.watches.select("user_id").distinct().where("user_id % 3 <> 0")
    lists = r.list_items.selectExpr("list_id", "IF(list_id % 11 = 0, NULL, list_id % 50) AS user_id").distinct()
    told = r.list_items.where("product_id % 2 = 0").selectExpr("list_id", "product_id")
    tables = {"users": users, "lists": lists, "items": r.list_items.where("product_id % 5 <> 0").withColumn("item", F.concat_ws("-", "list_id", "product_id")), "told": told.withColumn("item", F.concat_ws("-", "list_id", "product_id"))}
    out = tb.cascade_all(tables, [("told", "item", "items", "item"), ("items", "list_id", "lists", "list_id"), ("lists", "user_id", "users", "user_id")])
    return out["told"].groupBy("list_id").agg(F.count("*").alias("n"))


def _sketched(r):
    """Events of a window, and whether the stored sketches tell its sessions and users within three standard errors, by type."""
    day = NOW.date()
    sketches = Scratch(r.spark, "sketches").table(al.daily_sketches(r.api_events))
    near = al.sketch_totals(sketches, day, by=("event_type",)).toDF("event_type", "events", "sessions", "users")
    rows = r.api_events.where(f"day > DATE '{day}' - 30 AND day <= DATE '{day}'")
    exact = rows.groupBy("event_type").agg(F.count_distinct("session_id").alias("s"), F.count_distinct("telegram_user_id").alias("u"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b) + 1
    return near.join(exact, "event_type").select("event_type", "events", close("sessions", "s").alias("sessions_near"), close("users", "u").alias("users_near"))


def _by_sql(r):
    """Normalised names, tags and images of SKUs without a product through SQL functions."""
    r.products.selectExpr("CAST(id * 3 AS STRING) AS ean", "brand", "name", "CAST(NULL AS STRING) AS quantity", "concat('https://img/', id) AS image_url", "CAST(id % 5 AS BIGINT) AS times_seen").createOrReplaceTempView("promolens_images")
    sql.register(r.spark, "promolens_images", TAG_WORDS)
    r.skus.createOrReplaceTempView("promolens_skus")
    return r.spark.sql("SELECT id, norm_text(concat(' ', raw_name, ' ')) AS name, array_join(dietary_tags(raw_name), ',') AS tags FROM promolens_skus")


reg.add("a6_purge_counts", _purge_counts, "SELECT count(*) FILTER (WHERE valid_to >= DATE '1998-06-15' - 14) AS kept, count(*) FILTER (WHERE valid_to < DATE '1998-06-15' - 14) AS purged FROM offers", "offers")
reg.add("s12_reject_counts", _reject_counts, "WITH m AS (SELECT CASE WHEN brand IS NULL THEN 'no_brand' WHEN product_id IS NULL THEN 'unmatched' WHEN length(raw_name) < 8 THEN 'banner' ELSE 'good' END AS reason FROM skus) SELECT r AS reason, count(m.reason) AS n FROM (VALUES ('banner'), ('good'), ('no_brand'), ('unmatched')) v(r) LEFT JOIN m ON m.reason = r GROUP BY r", "skus")
reg.add("s9_swap_on_disk", _swapped, """SELECT campaign_id, count(*) AS n, max(id || CASE WHEN campaign_id % 10 IN (1, 2) THEN '-n' WHEN campaign_id % 10 = 4 AND store_id = 3 THEN '-s' ELSE '' END) AS m FROM offers GROUP BY 1""", "offers")
reg.add("a10_cascade_all", _cascaded, "SELECT list_id, count(*) AS n FROM list_items WHERE product_id % 2 = 0 AND product_id % 5 <> 0 AND (list_id % 11 = 0 OR (list_id % 50 % 3 <> 0 AND list_id % 50 IN (SELECT user_id FROM watches))) GROUP BY 1", "list_items", "watches")
reg.add("g5_sketch_totals", _sketched, "SELECT event_type, count(*)::BIGINT AS events, true AS sessions_near, true AS users_near FROM api_events WHERE day > DATE '2024-01-31' - 30 AND day <= DATE '2024-01-31' GROUP BY 1", "api_events")
reg.add("e9_sql_functions", _by_sql, f"WITH {TAGGED} SELECT id, lower(raw_name) AS name, array_to_string(tags, ',') AS tags FROM tagged", "skus")
