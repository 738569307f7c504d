"""Offers: filters, the star join, cross-chain comparison, deals and rollups.

Every function takes and gives DataFrames; ``d`` is the as-of date.  Dimension tables
(chains, and small ones like it) are left to Spark's size-based broadcast.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..partitions import dealt


def day(d: datetime.date) -> Column:
    return F.lit(d).cast("date")


# ---- predicates ------------------------------------------------------------------------

def active(o: DataFrame, d: datetime.date) -> DataFrame:
    """Offers whose window covers the day."""
    return o.where(day(d).between(F.col("valid_from"), F.col("valid_to")))


def not_expired(o: DataFrame, d: datetime.date) -> DataFrame:
    """Offers that end on the day or later, future ones included."""
    return o.where(F.col("valid_to") >= day(d))


def expiring(o: DataFrame, d: datetime.date, days: int, most: int = 60) -> DataFrame:
    """Offers that end within ``days`` (0 to ``most``) days from the day on."""
    return not_expired(o, d).where(F.col("valid_to") <= F.date_add(day(d), max(0, min(days, most))))


def in_chains(df: DataFrame, slugs: Sequence[str] | None, col: str = "chain_slug") -> DataFrame:
    """Rows of the chains; an empty list filters nothing."""
    return df.where(F.col(col).isin(list(slugs))) if slugs else df


def in_preferred_chains(df: DataFrame, preferences: DataFrame, user_id, col: str = "chain_id") -> DataFrame:
    """Rows of the chains that a user prefers; (user_id, chain_id) rows; a user without any filters nothing."""
    own = preferences.where(F.col("user_id") == user_id).select(F.col("chain_id").alias("__c")).distinct()
    kept = own.agg(F.count("*").alias("__n"))  # one row
    return df.join(own.withColumn("__hit", F.lit(True)), F.col(col) == F.col("__c"), "left").join(F.broadcast(kept)).where("__n = 0 OR __hit").drop("__c", "__hit", "__n")


def in_stores(df: DataFrame, ids: Sequence[int] | None, strict: bool = False) -> DataFrame:
    """Rows of the stores; chain-wide rows (null store) pass unless ``strict``."""
    if not ids:
        return df
    hit = F.col("store_id").isin(list(ids))
    return df.where(hit if strict else hit | F.col("store_id").isNull())


def store_offers(live: DataFrame, stores: DataFrame, store_id: int) -> DataFrame:
    """A store's own offers and its chain's national ones; ``live`` has chain_id and store_id."""
    one = stores.where(F.col("id") == store_id).select(F.col("chain_id").alias("__chain"))
    return live.join(one, F.col("chain_id") == F.col("__chain"), "left_semi").where(F.col("store_id").isNull() | (F.col("store_id") == store_id))


def contains_text(q: str, *cols: str) -> Column:
    """Whether any column contains the text, case folded; the text is literal."""
    needle = F.lit(q.lower())
    return functools.reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in cols])


def word_score(name: Column, q: str) -> Column:
    """2 for the query as the head of the name, behind one token of letters at most, plus 1 as whole words; 0 for neither."""
    text, low = "\\Q" + q.strip().lower().replace("\\E", "") + "\\E", F.lower(name)
    head = low.rlike(rf"^\s*(?:[a-z&.]+\s+)?{text}(?![\p{{L}}\p{{N}}_])")
    return F.when(head, 2).otherwise(0) + F.when(low.rlike(rf"(?:^|\s){text}(?:\s|$)"), 1).otherwise(0)


#: Words with which the fragment of a name starts that is no name of a product.
FRAGMENT_STARTS = "e con al alla alle allo della delle dello del dei di in per su da".split()


def not_fragment(name: Column, shortest: int = 4) -> Column:
    """Names of four characters or more that do not go on from other text."""
    return (F.length(name) >= shortest) & ~F.lower(name).rlike(rf"^\s*(?:{'|'.join(FRAGMENT_STARTS)})\s")


def has_tag(tag: str, col: str = "tags") -> Column:
    return F.array_contains(col, tag)


def has_any_tag(tags: Iterable[str], allowed: Iterable[str], col: str = "tags") -> Column:
    """Overlap with those of the tags that are allowed; none allowed filters nothing."""
    usable = [t for t in tags if t in set(allowed)]
    return F.arrays_overlap(col, F.array(*map(F.lit, usable))) if usable else F.lit(True)


def deal_quality(most_cents: int = 5000, longest: int = 120) -> Column:
    """Discount known, price and name within bounds."""
    return F.col("discount_pct").isNotNull() & (F.col("price_cents") < most_cents) & (F.length("raw_name") < longest)


#: Parts of a name that make it a promotion banner.
BANNERS = ["settimana dal", "concorso", "partecipa", "vince!", "app despar", "happy card", "raccolta punti", "tribù"]


def not_banner(col: str = "raw_name", banners: Sequence[str] = tuple(BANNERS)) -> Column:
    """Names of 6 to 90 characters that hold no part of a promotion banner."""
    name = F.lower(col)
    return F.length(col).between(6, 90) & ~functools.reduce(lambda a, b: a | b, [F.contains(name, F.lit(x)) for x in banners])


def allowed_url(url: Column, hosts: Sequence[str]) -> Column:
    """http or https, and a host that is listed or below a listed one."""
    listed = "|".join(h.lower().replace(".", r"\.") for h in hosts)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & host.rlike(rf"(^|\.)({listed})$"), F.lit(False))


def fresh_flyers(flyers: DataFrame, d: datetime.date, override: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable, stale): flyers whose window covers the day, or all with an override."""
    covers = F.coalesce(day(d).between(F.col("valid_from"), F.col("valid_to")), F.lit(False))
    return (flyers, flyers.limit(0)) if override else (flyers.where(covers), flyers.where(~covers))


def current_promotion(promos: DataFrame, d: datetime.date, keys: Sequence[str] = ("chain_id",), order: Sequence[str] = ("pos",)) -> DataFrame:
    """Of each key the first promotion whose window covers the day, else the first."""
    covers = F.coalesce(day(d).between(F.col("valid_from"), F.col("valid_to")), F.lit(False))
    return first_per(promos, keys, [covers.desc(), *[F.col(c) for c in order]])


def usable_promos(promos: DataFrame, groups: DataFrame, key: str = "promo_id", parts: Sequence[str] = ("sponsor", "ricet"), starts: Sequence[str] = ("news",)) -> DataFrame:
    """Promotions with groups whose alias holds none of the parts and starts with none of the starts; hidden ones go if there is such a column."""
    alias = F.lower("alias")
    bad = functools.reduce(lambda a, b: a | b, [*(F.contains(alias, F.lit(x)) for x in parts), *(alias.startswith(x) for x in starts)])
    if "hidden" in promos.columns:
        bad = bad | F.coalesce(F.col("hidden"), F.lit(False))
    return promos.where(~bad).join(groups, key, "left_semi")


def in_bbox(stores: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Stores inside the box; null and zero coordinates go."""
    return stores.where((F.col("lat") != 0) & (F.col("lng") != 0) & F.col("lat").between(south, north) & F.col("lng").between(west, east))


def other_city(files: DataFrame, cities: DataFrame, city: str, name_col: str = "url") -> DataFrame:
    """Files whose name holds no known city but this one, be it part of a word or several words.

    Names meet cities of two letters or more by the city's first two.
    """
    name = F.upper(F.url_decode(F.element_at(F.split(F.col(name_col), "/"), -1)))
    others = cities.where(F.upper("city") != city.upper()).select(F.upper("city").alias("__city"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    named = files.select(F.col(name_col).alias("__url"), name.alias("__name"), F.explode(F.array_distinct(starts)).alias("__start"))
    found = named.join(others.withColumn("__start", F.substring("__city", 1, 2)), "__start").where(F.contains("__name", F.col("__city")))
    return files.join(found.select("__url").distinct(), F.col(name_col) == F.col("__url"), "left_anti")


# ---- joins -----------------------------------------------------------------------------

def active_offers(o: DataFrame, sk: DataFrame, p: DataFrame, c: DataFrame, d: datetime.date, keep_unmatched: bool = True) -> DataFrame:
    """The star join of active offers; unmatched SKUs stay with category 'uncategorized' or go."""
    more = [c for c in ("image_url", "tags") if c in sk.columns]
    sku = sk.select(F.col("id").alias("sku_id"), "chain_id", "product_id", "raw_name", F.col("brand").alias("sku_brand"), "raw_quantity", *more)
    product = p.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("brand").alias("product_brand"), F.col("category"))
    chain = c.select(F.col("id").alias("chain_id"), F.col("slug").alias("chain_slug"), F.col("name").alias("chain_name"))
    out = active(o, d).join(sku, "sku_id").join(product, "product_id", "left" if keep_unmatched else "inner").join(chain, "chain_id")
    return out.withColumn("category", F.coalesce("category", F.lit("uncategorized")))


def with_display(live: DataFrame) -> DataFrame:
    """Labels that fall back from the product to the SKU."""
    return live.withColumns({"display_name": F.coalesce("product_name", "raw_name"), "display_brand": F.coalesce("product_brand", "sku_brand")})


def count_per_dim(dim: DataFrame, facts: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of ``dim`` (by its id) with the number of fact rows, zero included."""
    counts = facts.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias(name))
    return dim.join(counts, F.col("id") == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)))


def national_chains(c: DataFrame, live: DataFrame) -> DataFrame:
    """Chains with a chain-wide active offer."""
    return c.join(live.where("store_id IS NULL").select(F.col("chain_id").alias("id")), "id", "left_semi")


def abandoned_campaigns(fc: DataFrame, o: DataFrame, history: DataFrame, d: datetime.date, grace: int = 14) -> DataFrame:
    """Campaigns that ended before the grace days and have neither offers nor history."""
    old = fc.where(F.col("valid_to") < F.date_sub(day(d), grace))
    return old.join(o.select(F.col("campaign_id").alias("id")), "id", "left_anti").join(history.select(F.col("campaign_id").alias("id")), "id", "left_anti")


def best_offer_per_product(live: DataFrame) -> DataFrame:
    """Of each product the best price, where it is, the number of chains, and the image of the cheapest offer that has one."""
    by = F.struct("price_cents", "id")
    image = [F.min_by("image_url", F.when(F.col("image_url").isNotNull(), by)).alias("best_image")] if "image_url" in live.columns else []
    return live.where("product_id IS NOT NULL").groupBy("product_id").agg(
        F.min("price_cents").alias("best_cents"), F.min_by("chain_slug", by).alias("best_chain"), F.min_by("discount_pct", by).alias("best_discount"),
        F.min_by("original_cents", by).alias("best_original"), F.count_distinct("chain_id").alias("chains"), *image)


def list_view(items: DataFrame, p: DataFrame, live: DataFrame, categories: DataFrame, override: str = "category_override") -> DataFrame:
    """List items with their category's label and order, and their product's best offer.

    ``categories`` has slug, label and sort_order; a category that is not among them has neither.
    """
    label = categories.select(F.col("slug").alias("category"), F.col("label").alias("category_label"), F.col("sort_order").alias("category_order"))
    return list_with_category(items, p, override).join(label, "category", "left").join(best_offer_per_product(live), "product_id", "left")


def list_order() -> list[Column]:
    """The order of a list view: categories (those without an order last), then items by their own order, the newest first."""
    return [F.asc_nulls_last("category_order"), F.asc_nulls_last("sort_key"), F.desc_nulls_first("created_at"), F.col("product_id")]


def loyalty_programs(c: DataFrame, live: DataFrame, programs: DataFrame) -> DataFrame:
    """Each chain with each loyalty program's label, and its live card offers."""
    n = live.where("requires_card").groupBy("chain_id").agg(F.count("*").alias("card_offers"), F.count_distinct("sku_id").alias("card_skus"))
    every = c.withColumn("__all", F.lit(1)).join(programs.withColumn("__all", F.lit(1)), "__all").drop("__all")  # each chain has a row for each program
    return every.join(n, F.col("id") == F.col("chain_id"), "left").drop("chain_id").fillna(0, ["card_offers", "card_skus"])


def link_taxonomy(p: DataFrame, categories: DataFrame) -> DataFrame:
    """Category text to category id; unknown text takes the id of 'altro'."""
    ids = categories.select(F.col("slug").alias("category"), F.col("id").alias("category_id"))
    rest = categories.where("slug = 'altro'").select(F.col("id").alias("__other"))
    other = rest.agg(F.min("__other").alias("__other"))  # one row, null without 'altro'
    return p.join(ids, "category", "left").join(F.broadcast(other)).withColumn("category_id", F.coalesce("category_id", "__other")).drop("__other")


def cluster_by_publication(stores: DataFrame, city_pub: DataFrame, slug: Column) -> DataFrame:
    """Publications with the sorted ids of the stores in their cities."""
    return stores.withColumn("city_slug", slug).join(city_pub, "city_slug").groupBy("publication").agg(F.array_sort(F.collect_list("id")).alias("store_ids"))


def list_with_category(items: DataFrame, p: DataFrame, override: str = "category_override") -> DataFrame:
    """A list item's category: its own override, else its product's."""
    product = p.select(F.col("id").alias("product_id"), F.col("category").alias("__cat"))
    own = F.col(override) if override in items.columns else F.lit(None).cast("string")
    return items.join(product, "product_id", "left").withColumn("category", F.coalesce(own, "__cat", F.lit("altro"))).drop("__cat")


# ---- aggregations ----------------------------------------------------------------------

def best_current_price(live: DataFrame) -> DataFrame:
    """Best price per product; an unmatched SKU is a group of its own."""
    key = F.coalesce(F.concat(F.lit("p"), F.col("product_id").cast("string")), F.concat(F.lit("s"), F.col("sku_id").cast("string")))
    return live.groupBy(key.alias("item")).agg(F.min("price_cents").alias("min_cents"), F.count_distinct("chain_id").alias("chains"), F.count("*").alias("offers"))


def price_spread(live: DataFrame, least_chains: int = 2) -> DataFrame:
    """Products at several chains: lowest and highest price, spread, savings and where it is cheapest."""
    by = F.struct("price_cents", "chain_slug", "id")
    out = live.where("product_id IS NOT NULL").groupBy("product_id").agg(
        F.count_distinct("chain_id").alias("chains"), F.count("*").alias("offers"), F.min("price_cents").alias("min_cents"), F.max("price_cents").alias("max_cents"),
        F.min_by("chain_slug", by).alias("cheapest"), F.array_join(F.array_sort(F.collect_set("chain_slug")), ",").alias("chain_slugs"))
    out = out.where(F.col("chains") >= least_chains).withColumn("spread_cents", F.col("max_cents") - F.col("min_cents"))
    return out.withColumn("savings_pct", F.expr("(spread_cents * 100) div max_cents"))


def top_spreads(spread: DataFrame, least_pct: int = 5, below: int = 90, k: int = 50) -> DataFrame:
    return spread.where(F.col("savings_pct").between(least_pct, below - 1)).orderBy(F.desc("savings_pct"), F.desc("spread_cents"), "product_id").limit(k)


def category_leaders(live: DataFrame) -> DataFrame:
    """Of each category and chain the offers at their product's lowest price, and their prices."""
    low = F.min("price_cents").over(Window.partitionBy("product_id"))
    lead = live.where("product_id IS NOT NULL").withColumn("__low", low).where("price_cents = __low")
    return lead.groupBy("category", "chain_slug").agg(F.count("*").alias("leads"), F.sum("price_cents").alias("sum_cents"), (F.sum("price_cents") / F.count("*")).alias("mean_cents"))


def promotion_analytics(o: DataFrame, sk: DataFrame) -> DataFrame:
    """Offers and SKUs by chain, week, tag, mechanic and card; SKUs without tags are 'uncategorized'.

    Offers are dealt by SKU: behind the join a task holds each of its SKUs by tag and week.
    """
    tagged = sk.select(F.col("id").alias("sku_id"), "chain_id", F.explode_outer(F.when(F.size("tags") > 0, F.col("tags"))).alias("tag"))
    rows = dealt(o, "sku_id").join(tagged, "sku_id").withColumns({"tag": F.coalesce("tag", F.lit("uncategorized")), "week": F.to_date(F.date_trunc("week", "valid_from"))})
    return rows.groupBy("chain_id", "week", "tag", "mechanic", "requires_card").agg(F.count("*").alias("offers"), F.count_distinct("sku_id").alias("skus"), F.min("price_cents").alias("min_cents"))


def current_promotions(live: DataFrame) -> DataFrame:
    """Per chain: offers, SKUs, counts by mechanic, mean discount, last end."""
    n = lambda m: F.count_if(F.col("mechanic") == m)
    return live.groupBy("chain_slug").agg(
        F.count_distinct("id").alias("offers"), F.count_distinct("sku_id").alias("skus"), n("loyalty_price").alias("loyalty"), n("percentage_off").alias("percentage"), n("price_cut").alias("cuts"),
        (F.sum("discount_pct") / F.count("discount_pct")).alias("mean_discount"), F.max("valid_to").alias("last_end"))


def status(o: DataFrame, sk: DataFrame, fc: DataFrame, d: datetime.date) -> DataFrame:
    """One row of platform totals."""
    live = active(o, d).agg(F.count("*").alias("active_offers"), F.count_distinct("sku_id").alias("active_skus"))
    skus = sk.agg(F.count("*").alias("skus"), F.count("product_id").alias("matched_skus"))
    camps = fc.agg(F.count("*").alias("campaigns"), F.count_if(day(d).between(F.col("valid_from"), F.col("valid_to"))).alias("open_campaigns"))
    return live.crossJoin(skus).crossJoin(camps)  # three single rows


def tag_counts(sk: DataFrame, live: DataFrame) -> DataFrame:
    """SKUs with a live offer, by tag."""
    have = sk.join(live.select(F.col("sku_id").alias("id")), "id", "left_semi")
    return have.select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("id").alias("skus"))


def offers_per_store(stores: DataFrame, live: DataFrame) -> DataFrame:
    """Active offers of each store, zero included."""
    return count_per_dim(stores.select("id", "chain_id"), live, "store_id", "offers")


def offers_per_chain(c: DataFrame, live: DataFrame, positive: bool = False) -> DataFrame:
    out = count_per_dim(c.select("id", "slug"), live, "chain_id", "offers")
    return out.where("offers > 0") if positive else out


def deal_cards(live: DataFrame, *more: Column) -> DataFrame:
    """A card per SKU across stores: price range, best discount, window, stores as JSON, and ``more`` aggregates."""
    stores = F.array_sort(F.collect_list(F.when(F.col("store_id").isNotNull(), F.struct("price_cents", "store_id"))))
    return live.groupBy("sku_id", "raw_name", "chain_slug").agg(
        F.min("price_cents").alias("min_cents"), F.max("price_cents").alias("max_cents"), F.max("discount_pct").alias("best_discount"), F.min("valid_from").alias("valid_from"),
        F.min("valid_to").alias("first_end"), F.max("valid_to").alias("valid_to"), F.count_distinct("store_id").alias("stores"), F.bool_or(F.col("store_id").isNull()).alias("national"),
        F.to_json(stores).alias("stores_json"), *more)


def chain_health(c: DataFrame, o: DataFrame, sk: DataFrame, fc: DataFrame, d: datetime.date, stale_days: int = 9, recent_days: int = 7) -> DataFrame:
    """Per chain: open offers and the share of those with an image, last campaign update, campaigns by state, stale flag.

    Open are offers that end on the day or later.  ``fc`` has chain_id, scrape_status,
    valid_to and updated_at.  Stale is a chain with loaded campaigns that are not over but
    no open offer, or whose last update is more than ``stale_days`` old; a chain without
    campaigns is not.  Facts are summed before they are joined.
    """
    offers = not_expired(o, d).join(sk.select(F.col("id").alias("sku_id"), "chain_id", "image_url"), "sku_id")
    offers = offers.groupBy("chain_id").agg(F.count("*").alias("active_offers"), F.round(F.count("image_url") * 100 / F.count("*"), 1).alias("pct_image"))
    recent = F.col("updated_at") > F.date_sub(day(d), recent_days)
    of = lambda state, when: F.count_if((F.col("scrape_status") == state) & when)
    runs = fc.groupBy("chain_id").agg(
        F.max("updated_at").alias("last_update"), of("loaded", F.col("valid_to") >= day(d)).alias("loaded_active"), of("failed", recent).alias("failed_recent"), of("empty", recent).alias("empty_recent"))
    out = c.select(F.col("id").alias("chain_id"), "slug").join(offers, "chain_id", "left").join(runs, "chain_id", "left").fillna(0, ["active_offers", "loaded_active", "failed_recent", "empty_recent"])
    idle = (F.col("loaded_active") > 0) & (F.col("active_offers") == 0)
    return out.withColumn("stale", idle | F.coalesce(F.datediff(day(d), F.col("last_update")) > stale_days, F.lit(False)))


def match_coverage(sk: DataFrame) -> DataFrame:
    return sk.agg(F.count("*").alias("total"), F.count("product_id").alias("matched"), F.count_distinct("product_id").alias("products"), F.count_if(F.col("product_id").isNull()).alias("unmatched"))


def cross_chain_products(sk: DataFrame, least: int = 2) -> DataFrame:
    return sk.where("product_id IS NOT NULL").groupBy("product_id").agg(F.count_distinct("chain_id").alias("chains")).where(F.col("chains") >= least)


def modal_window(rows: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """The most frequent (valid_from, valid_to) of each key; the first seen wins ties."""
    n = rows.groupBy(*keys, "valid_from", "valid_to").agg(F.count("*").alias("n"), F.min(pos).alias("__first"))
    return first_per(n, keys, [F.desc("n"), F.col("__first")]).drop("__first")


def campaign_span(promos: DataFrame, keys: Sequence[str], text: str, order: str) -> DataFrame:
    """Widest date range and joined distinct descriptions of each key."""
    told = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order, text))), lambda x: x[text]), " | ")
    first = promos.groupBy(*keys, text).agg(F.min(order).alias(order), F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"))
    return first.groupBy(*keys).agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), told.alias("descriptions"))


def category_summary(p: DataFrame, categories: DataFrame) -> DataFrame:
    """Products of each category, categories without any and unknown texts included."""
    n = p.groupBy(F.coalesce("category", F.lit("unmatched")).alias("slug")).agg(F.count("*").alias("products"))
    return categories.select("slug").join(n, "slug", "full_outer").select("slug", F.coalesce("products", F.lit(0)).alias("products"))


def list_groups(items: DataFrame) -> DataFrame:
    """A list's items under category headers."""
    return items.groupBy("list_id", "category").agg(F.count("*").alias("items"), F.array_join(F.transform(F.array_sort(F.collect_list("product_id")), lambda x: x.cast("string")), ",").alias("product_ids"))


# ---- first of a key, and rankings ------------------------------------------------------

def first_per(df: DataFrame, keys: Sequence, order: Sequence, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; Spark limits inside partitions before the shuffle."""
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


keep_first = first_per


def merge_promotions(rows: DataFrame, keys: Sequence, order: Sequence[str], text: str = "promotion") -> DataFrame:
    """The first row of each key with the promotion texts of all its rows, in order.

    A text that the ones before already hold is left out; null texts are.
    """
    at = F.struct(*order)
    named = rows.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    told = F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(at.alias("at"), F.col(text).alias("text"))))), lambda x: x["text"])
    join = F.aggregate(told, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull(), x).when(F.contains(a, x), a).otherwise(F.concat(a, F.lit(" + "), x)))
    first = F.min_by(F.struct(*[c for c in rows.columns if c != text]), at)
    merged = named.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(first.alias("__row"), join.alias(text))
    return merged.select("__row.*", text).select(*rows.columns)


def cheapest_per(live: DataFrame, keys: Sequence[str] = ("product_id", "chain_id")) -> DataFrame:
    return first_per(live, keys, [F.col("price_cents"), F.col("id")])


def best_prices(live: DataFrame) -> DataFrame:
    """A product's cheapest offer with the number of its chains."""
    n = live.groupBy("product_id").agg(F.count_distinct("chain_id").alias("chains"))
    return cheapest_per(live.where("product_id IS NOT NULL"), ("product_id",)).join(n, "product_id")


def top_discounts(live: DataFrame, k: int = 10) -> DataFrame:
    """The highest discount of each name, then the highest overall."""
    best = first_per(live.where("discount_pct IS NOT NULL"), ["raw_name"], [F.desc("discount_pct"), F.col("price_cents"), F.col("id")])
    return best.orderBy(F.desc("discount_pct"), "price_cents", "id").limit(k)


def deals(live: DataFrame, k: int = 100, most: int = 200) -> DataFrame:
    return live.orderBy(F.desc_nulls_last("discount_pct"), "price_cents", "id").limit(max(1, min(k, most)))


def expiring_first(cards: DataFrame, k: int = 50) -> DataFrame:
    return cards.orderBy("first_end", F.desc_nulls_last("best_discount"), "sku_id").limit(k)


def store_directory(stores: DataFrame, c: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` active stores of each chain by name."""
    named = stores.where("is_active").join(c.select(F.col("id").alias("chain_id"), "slug"), "chain_id")
    return first_per(named, ["chain_id"], [F.col("name"), F.col("id")], k, "place")


def stores_and_networks(stores: DataFrame, national: DataFrame) -> DataFrame:
    """Real stores and one synthetic row for each national chain."""
    net = national.select(F.lit(None).cast("long").alias("id"), F.col("id").cast("int").alias("chain_id"), F.concat(F.col("name"), F.lit(" (national)")).alias("name"))
    return stores.where("is_active").select("id", "chain_id", "name").unionByName(net)


def unseen_union(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First rows, and second rows whose key is not among them."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)
