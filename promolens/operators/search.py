"""Search and exploration of offers."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import distance_km, similarity
from . import offers as op
from .text_index import TextIndex, TrigramIndex


@dataclass
class ExploreSpec:
    """Filters that combine freely; what is not set filters nothing."""

    q: str | None = None
    chains: Sequence[str] = ()
    stores: Sequence[int] = ()
    categories: Sequence[str] = ()
    within_days: int | None = None
    most_cents: int | None = None
    near: tuple[float, float, float] | None = None  # latitude, longitude, km
    sort: str = "discount"
    k: int = 100
    extra: list = field(default_factory=list)


def explore(live: DataFrame, spec: ExploreSpec, d: datetime.date, stores: DataFrame | None = None) -> DataFrame:
    """Deal cards of the offers that pass the filters; the store filter is strict here.

    ``near`` asks for ``stores`` (id, lat, lng) and keeps offers of stores within the
    radius and those without a store.  Categories are tags if the offers have any.  Sorted
    by relevance, a card has the larger similarity of its SKU's and its product's name.
    """
    df = op.in_stores(op.in_chains(live, spec.chains), spec.stores, strict=True)
    if spec.q:
        df = df.where(op.contains_text(spec.q, "raw_name", "product_name", "sku_brand"))
    if spec.categories:
        df = df.where(F.arrays_overlap("tags", F.array(*map(F.lit, spec.categories))) if "tags" in df.columns else F.col("category").isin(list(spec.categories)))
    if spec.near:
        lat, lng, km = spec.near
        inside = stores.where(distance_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= km).select(F.col("id").alias("store_id"))
        df = df.where("store_id IS NULL").unionByName(df.join(inside, "store_id", "left_semi"))
    if spec.within_days is not None:
        df = op.expiring(df, d, spec.within_days, 14)
    if spec.most_cents is not None:
        df = df.where(F.col("price_cents") <= spec.most_cents)
    for condition in spec.extra:
        df = df.where(condition)
    more = []
    if spec.sort == "relevance":
        q = F.lit(spec.q or "")
        more = [F.max(F.greatest(similarity(F.col("raw_name"), q), similarity(F.coalesce("product_name", F.lit("")), q))).alias("relevance")]
    cards = op.deal_cards(df, *more)
    order = {"discount": [F.desc_nulls_last("best_discount"), "min_cents"], "price": ["min_cents"], "expiring": ["first_end", F.desc_nulls_last("best_discount")],
             "relevance": [F.desc("relevance"), F.desc_nulls_last("best_discount")]}[spec.sort]
    return cards.orderBy(*order, "sku_id").limit(spec.k)


def _narrowed(df: DataFrame, key: str, index: TrigramIndex | None, q: str, t: float) -> DataFrame:
    """Rows that can be similar to the query or contain it, by the index; all without one, or if it cannot tell."""
    part = index.holding(q) if index else None
    if part is None:
        return df
    ids = index.similar(q, t).select("id").unionByName(part).distinct().withColumnRenamed("id", "__id")
    return df.join(ids, F.col(key) == F.col("__id"), "left_semi")


def compare_prices(live: DataFrame, q: str, k: int = 50, t: float = 0.25, index: TrigramIndex | None = None, key: str = "sku_id") -> DataFrame:
    """Offers like the query (similarity or substring), cheapest first; ``index`` is over SKU names by ``key``: sku_id, or raw_name for distinct names."""
    s = similarity(F.col("raw_name"), F.lit(q))
    df = _narrowed(live, key, index, q, t)
    return df.withColumn("similarity", s).where((s > t) | op.contains_text(q, "raw_name")).orderBy("price_cents", "id").limit(k)


def search(o: DataFrame, sk: DataFrame, p: DataFrame, c: DataFrame, q: str, d: datetime.date, words: TextIndex, grams: TrigramIndex, chains: Sequence[str] = (), stores: Sequence[int] = (), k: int = 50, t: float = 0.4, key: str = "id") -> DataFrame:
    """Search over product names: of each product and chain the cheapest offer that is not over.

    A name matches by the query as whole words, by all of its stems, or by a similarity
    above ``t``; names that are fragments do not.  Ranked by the head of the name, text
    rank, similarity and price.  Both indexes are over product names by ``key``: id, or name
    for distinct names, which are then scored once each.
    """
    q = q.strip()
    empty = p.select(F.col(key).alias("id")).limit(0)
    whole = grams.holding(q, whole_words=True)
    ranks = words.match(q).select("id", "rank")
    ids = ranks.select("id").unionByName(grams.similar(q, t).select("id")).unionByName(empty if whole is None else whole).distinct()
    names = p.select(F.col(key).alias("id"), F.col("name").alias("product_name")).distinct().join(ids, "id", "left_semi").join(ranks, "id", "left").where(op.not_fragment(F.col("product_name")))
    names = names.withColumns({"word": op.word_score(F.col("product_name"), q), "similarity": similarity(F.col("product_name"), F.lit(q))})
    hit = names.where(F.col("word").isin(1, 3) | F.col("rank").isNotNull() | (F.col("similarity") > t))
    hit = hit.select(F.col("id").alias("__key"), "product_name", "word", F.coalesce("rank", F.lit(0.0)).alias("rank"), "similarity")
    hit = p.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col(key).alias("__key")).join(hit, ["__key", "product_name"]).drop("__key")
    sku = sk.select(F.col("id").alias("sku_id"), "chain_id", "product_id").join(hit, "product_id")
    sku = op.in_chains(sku.join(c.select(F.col("id").alias("chain_id"), F.col("slug").alias("chain_slug")), "chain_id"), chains)
    live = op.in_stores(op.not_expired(o, d), stores).join(sku, "sku_id")
    best = op.first_per(live, ["product_id", "chain_id"], [F.col("price_cents"), F.col("id")])
    return best.orderBy(F.desc("word"), F.desc("rank"), F.desc("similarity"), "price_cents", "id").limit(k)


def search_products(p: DataFrame, q: str, k: int = 50, t: float = 0.3, index: TrigramIndex | None = None, key: str = "id") -> DataFrame:
    """Products by name: prefix matches first, then similarity; ``index`` is over names by ``key``: id, or name for distinct names.

    Names are scored once each, however many products share them.
    """
    s = similarity(F.col("name"), F.lit(q))
    front = F.when(F.startswith(F.lower("name"), F.lit(q.lower())), 0).otherwise(1)
    df = _narrowed(p, key, index, q, t)
    names = df.select("name").distinct().withColumns({"front": front, "similarity": s}).where((s > t) | op.contains_text(q, "name"))
    return df.join(names, "name").select(*p.columns, "front", "similarity").orderBy("front", F.desc("similarity"), "name", "id").limit(k)
