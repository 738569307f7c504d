"""Writes as table-to-table functions: upserts, replaces, purges, history and de-duplication."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .offers import day, first_per


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], rules: dict[str, str] | None = None, order: str | None = None) -> DataFrame:
    """Rows of both tables by null-safe keys.

    A column's rule: "new" (default) takes the batch's value, "coalesce_new" the batch's
    unless null, "keep" the old value, "map_merge" both maps with the batch's keys on top.
    With ``order`` a key that comes twice in the batch gives its last value (last non-null
    for coalesce_new); keys must be unique otherwise.
    """
    rules = rules or {}
    values = [c for c in target.columns if c not in keys]
    if order:
        last = [(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))) if rules.get(c) == "coalesce_new" else F.max_by(c, order)).alias(c) for c in values]
        batch = batch.groupBy(*keys).agg(*last)
    t, b = target.alias("t"), batch.select(*keys, *values).alias("b")
    on = None
    for k in keys:
        c = F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = c if on is None else on & c
    both = t.withColumn("__t", F.lit(True)).join(b.withColumn("__b", F.lit(True)), on, "full_outer")

    def pick(c: str) -> Column:
        old, new, rule = F.col(f"t.{c}"), F.col(f"b.{c}"), rules.get(c, "new")
        if rule == "coalesce_new":
            return F.coalesce(new, old)
        if rule == "keep":
            return F.when(F.col("__t"), old).otherwise(new)
        if rule == "map_merge":
            return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))
        return F.when(F.col("__b"), new).otherwise(old)

    return both.select(*[F.when(F.col("__t"), F.col(f"t.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys], *[pick(c).alias(c) for c in values])


def replace_scope(target: DataFrame, batch: DataFrame, campaign_id, store_ids: Sequence | None = None) -> DataFrame:
    """The target without the scope's rows, and the batch: a campaign, or some stores of it."""
    scope = F.col("campaign_id") == F.lit(campaign_id)
    if store_ids is not None:
        scope &= F.coalesce(F.col("store_id").isin(list(store_ids)), F.lit(False))
    return target.where(~scope).unionByName(batch)


def guard_nonempty(target: DataFrame, batch: DataFrame, scopes: DataFrame, key: str = "campaign_id") -> tuple[DataFrame, DataFrame]:
    """(table, empty scopes): scopes with rows are replaced, those without keep their old rows."""
    full = batch.select(key).distinct()
    kept = target.join(scopes.join(full, key, "left_semi").select(key), key, "left_anti")
    return kept.select(*target.columns).unionByName(batch), scopes.join(full, key, "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.unionByName(batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def split_rejects(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with reason): the first rule that holds is the reason."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        reason = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(reason)
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def merge_run_log(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs with their finish; summaries (maps) merge, the finish's keys on top."""
    f = finishes.select("id", F.col("status").alias("f_status"), "finished_at", F.col("summary").alias("f_summary"))
    out = starts.join(f, "id", "left")
    old = F.map_filter("summary", lambda k, _: ~F.coalesce(F.map_contains_key("f_summary", k), F.lit(False)))
    return out.withColumns({"summary": F.when(F.col("f_summary").isNull(), F.col("summary")).otherwise(F.map_concat(old, "f_summary")), "status": F.coalesce("f_status", "status")}).drop("f_summary", "f_status")


def resolve_stores(ids: DataFrame, stores: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame]:
    """(resolved, missing)."""
    return ids.join(stores, key), ids.join(stores.select(key), key, "left_anti")


def price_history_rollup(o: DataFrame) -> DataFrame:
    """Per SKU and week: lowest and highest price, mechanic at the lowest, lowest reference price.

    With a ``unit_price`` also its lowest and highest, and the lowest that the reference
    price implies.
    """
    rows = o.withColumn("week_start", F.to_date(F.date_trunc("week", "valid_from")))
    by, unit = F.struct("price_cents", "id"), []
    if "unit_price" in o.columns:
        implied = F.col("unit_price") * (F.col("original_cents") / F.nullif("price_cents", F.lit(0)))
        unit = [F.min("unit_price").alias("min_unit_price"), F.max("unit_price").alias("max_unit_price"), F.min(implied).alias("reference_unit_price")]
    return rows.groupBy("sku_id", "week_start").agg(
        F.min("price_cents").alias("min_cents"), F.max("price_cents").alias("max_cents"), F.min_by("mechanic", by).alias("mechanic"),
        F.min("original_cents").alias("reference_cents"), F.max("campaign_id").alias("campaign_id"), *unit)


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Prices and unit prices widen, the campaign is the newest, mechanic and references stay from the first."""
    rows = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)))
    first, unit = F.col("__turn"), []
    if "min_unit_price" in rows.columns:
        unit = [F.min("min_unit_price").alias("min_unit_price"), F.max("max_unit_price").alias("max_unit_price"), F.min_by("reference_unit_price", first).alias("reference_unit_price")]
    return rows.groupBy("sku_id", "week_start").agg(
        F.min("min_cents").alias("min_cents"), F.max("max_cents").alias("max_cents"), F.min_by("mechanic", first).alias("mechanic"),
        F.min_by("reference_cents", first).alias("reference_cents"), F.max_by("campaign_id", first).alias("campaign_id"), *unit)


def dedup_watches(w: DataFrame) -> DataFrame:
    """One watch for each user, type, folded query and (if there are any) chain and store filters: the oldest."""
    filters = [c for c in ("chain_filter", "store_filter") if c in w.columns]
    return first_per(w, ["user_id", "watch_type", F.lower(F.trim("query")), *filters], [F.col(c) for c in ("created_at", "id") if c in w.columns])


def upsert_watches(w: DataFrame, batch: DataFrame) -> DataFrame:
    """A watch of an existing key takes the batch's price and is active again; others are created.

    The key is user, type, folded query and both filters (``chain_filter``,
    ``store_filter``; a missing or null one is an empty list).  A key that the batch holds
    several times counts with its first row.
    """
    def prepared(df: DataFrame) -> DataFrame:
        for c, kind in (("chain_filter", "array<string>"), ("store_filter", "array<bigint>")):
            df = df.withColumn(c, F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.array()).cast(kind))
        if "is_active" not in df.columns:
            df = df.withColumn("is_active", F.lit(True))
        return dedup_watches(df).withColumn("__q", F.lower(F.trim("query")))

    keys = ["user_id", "watch_type", "__q", "chain_filter", "store_filter"]
    t, b = prepared(w).withColumn("__old", F.lit(True)).alias("t"), prepared(batch).withColumn("__new", F.lit(True)).alias("b")
    both = t.join(b, [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    old, new = F.col("t.__old").isNotNull(), F.col("b.__new").isNotNull()
    either = lambda c: F.when(old, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select(
        *map(either, ("id", "user_id", "watch_type", "query", "chain_filter", "store_filter")), F.when(new, F.col("b.max_price_cents")).otherwise(F.col("t.max_price_cents")).alias("max_price_cents"),
        F.when(new, True).otherwise(F.col("t.is_active")).alias("is_active"), (~old).alias("created"))


def mark_notified(w: DataFrame, sent: DataFrame, now: datetime.datetime) -> DataFrame:
    """Watches with ``last_notified_at``: now for those of which an alert (watch_id) was sent, else as before."""
    told = sent.select(F.col("watch_id").alias("id")).distinct().withColumn("__now", F.lit(now))
    old = F.col("last_notified_at") if "last_notified_at" in w.columns else F.lit(None).cast("timestamp")
    return w.join(told, "id", "left").withColumn("last_notified_at", F.coalesce("__now", old)).drop("__now")


def patch_items(items: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set what the patch holds, keep the rest; unknown keys are added."""
    return upsert(items, patch, keys, {c: "coalesce_new" for c in items.columns if c not in keys})


def delete_owned(items: DataFrame, requests: DataFrame, owners: DataFrame) -> DataFrame:
    """Delete (list_id, product_id) where the request's user owns the list."""
    allowed = requests.join(owners, ["list_id", "user_id"], "left_semi")
    return items.join(allowed.select("list_id", "product_id"), ["list_id", "product_id"], "left_anti")


def apply_order(items: DataFrame, order: DataFrame) -> DataFrame:
    """Sort keys (position * 10) from each list's array of product ids."""
    at = order.select("list_id", F.posexplode("product_ids").alias("pos", "product_id"))
    return items.join(at, ["list_id", "product_id"], "left").withColumn("sort_key", (F.col("pos") * 10).cast("int")).drop("pos")


def cap_list(items: DataFrame, n: int = 100, order: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the first ``n`` items of each list in insertion order."""
    place = F.row_number().over(Window.partitionBy("list_id").orderBy(order))
    marked = items.withColumn("place", place)
    return marked.where(F.col("place") <= n), marked.where(F.col("place") > n)


def ensure_default_list(users: DataFrame, lists: DataFrame) -> DataFrame:
    """One default list for each user: the smallest existing default, else a new one."""
    own = first_per(lists.where("is_default"), ["user_id"], [F.col("list_id")]).select("user_id", "list_id")
    new = users.join(own, "user_id", "left_anti").select("user_id", F.xxhash64(F.lit("default"), "user_id").alias("list_id"))
    return own.unionByName(new)


def purge_offers(o: DataFrame, d: datetime.date, grace: int = 14) -> DataFrame:
    """Without offers that ended more than ``grace`` days before."""
    return o.where(F.col("valid_to") >= F.date_sub(day(d), grace))


def reset_chain(o: DataFrame, sk: DataFrame, chain_id: int) -> DataFrame:
    return o.join(sk.where(F.col("chain_id") == chain_id).select(F.col("id").alias("sku_id")), "sku_id", "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


#: Store formats with the parts of a promotion's text that name them.
FORMATS = [("supermarket", ["super"]), ("market", ["market", "supermercat"]), ("ipermarket", ["iper"]), ("cashcarry", ["cash carry", "cashcarry", "cash&carry", "cash & carry"])]
#: Parts that name a pet shop.
PET_SHOPS = ["pet store", "petstore", "buddy"]


def fan_out(o: DataFrame, stores: DataFrame, by_format: Sequence[int] | None = None) -> DataFrame:
    """(id, chain_id, target_store): an offer once for each of its stores.

    An offer's own list (``store_ids``, not empty) wins.  Else the offers of the chains
    ``by_format`` (None: all) go to the active stores of the formats that the promotion's
    text names, to all active stores of the chain if it names none or there is no text, and
    to none if it is a pet shop's; a chain without such stores has no rows.  Offers of other
    chains keep their ``store_id``, or none.
    """
    text = F.regexp_replace(F.lower(F.coalesce("promo", F.lit(""))), r"\s+", " ")
    holds = lambda parts: functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts])
    own = F.col("store_ids") if "store_ids" in o.columns else F.lit(None).cast("array<bigint>")
    dealt = F.lit(True) if by_format is None else F.col("chain_id").isin(list(by_format))
    formats = F.array_compact(F.array(*[F.when(holds(parts), F.lit(f)) for f, parts in FORMATS]))
    rows = o.withColumns({"__own": F.coalesce(F.size(own), F.lit(0)) > 0, "__dealt": dealt, "__formats": formats, "__pet": holds(PET_SHOPS)})
    given = rows.where("__own").select("id", "chain_id", F.explode("store_ids").alias("target_store")) if "store_ids" in o.columns else None
    keep = F.col("store_id") if "store_id" in o.columns else F.lit(None).cast("bigint")
    single = rows.where("NOT __own AND NOT __dealt").select("id", "chain_id", keep.alias("target_store"))
    active = stores.where("is_active") if "is_active" in stores.columns else stores
    s = active.select(F.col("id").alias("target_store"), "chain_id", "format")
    many = rows.where("NOT __own AND __dealt AND NOT __pet").join(s, "chain_id").where((F.size("__formats") == 0) | F.array_contains("__formats", F.col("format"))).select("id", "chain_id", "target_store")
    out = single.unionByName(many)
    return out if given is None else out.unionByName(given)
