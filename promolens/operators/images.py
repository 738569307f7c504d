"""The image registry: registration, lookup in steps, backfill and healing."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import norm_text
from ..functions.similarity import trigram_texts
from ..storage import Scratch
from .offers import first_per
from .text_index import TrigramIndex


def register_images(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge images by EAN, else by brand, name and quantity (null-safe, among rows without EAN).

    The image is the last, the source the first, attributes the first that are not null,
    times_seen counts.  ``pos`` orders the batch; URLs must be http or https.
    """
    new = batch.where(F.lower("image_url").rlike("^https?://")).withColumn("times_seen", F.lit(1).cast("long"))
    rows = registry.withColumn("pos", F.lit(-1).cast("long")).unionByName(new)
    rows = rows.withColumn("key", F.when(F.col("ean").isNotNull(), F.struct(F.col("ean"), *[F.lit(None).cast("string").alias(c) for c in ("b", "n", "q")])).otherwise(F.struct(F.lit(None).cast("string").alias("ean"), norm_text(F.col("brand")).alias("b"), norm_text(F.col("name")).alias("n"), norm_text(F.col("quantity")).alias("q"))))
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return rows.groupBy("key").agg(first("ean"), first("brand"), first("name"), first("quantity"), F.max_by("image_url", "pos").alias("image_url"), F.min_by("source", "pos").alias("source"), F.sum("times_seen").alias("times_seen")).drop("key")


def lookup_image(sk: DataFrame, registry: DataFrame, same_brand: float = 0.3, any_brand: float = 0.45, shortest: int = 6) -> DataFrame:
    """(id, image_url, step) by the first step that finds one: EAN, exact triple, name, similar name of the brand, similar name.

    SKUs with one name, brand and quantity find the same image, and of registry rows that agree
    in what a step compares only the best can win: so distinct triples meet distinct triples, and
    SKUs read what theirs found.
    """
    n = lambda c: norm_text(F.col(c))
    scratch = Scratch(sk.sparkSession, "images")  # each step reads what the one before left
    s = scratch.table(sk.select("id", "ean", n("raw_name").alias("name"), n("brand").alias("brand"), n("raw_quantity").alias("quantity")))
    r = registry.select("ean", n("name").alias("name"), n("brand").alias("brand"), n("quantity").alias("quantity"), "image_url", F.coalesce(-F.col("times_seen"), F.lit((1 << 63) - 1)).alias("less"))
    r = scratch.table(r.groupBy("ean", "name", "brand", "quantity").agg(F.min(F.struct("less", "image_url")).alias("best")))
    best_of = lambda df, *keys: df.groupBy(*[F.col(k).alias("r_" + k) for k in keys]).agg(F.min("best").alias("best"))
    triples = scratch.table(s.select("name", "brand", "quantity").where("name IS NOT NULL").distinct())
    rest = triples = scratch.table(triples.withColumn("cls", F.monotonically_increasing_id()))
    found = []

    def take(hits: DataFrame, step: int) -> None:
        nonlocal rest
        if "similarity" not in hits.columns:
            hits = hits.withColumn("similarity", F.lit(None).cast("double"))
        hits = hits.select("cls", F.lit(step).alias("step"), "similarity", "best")
        found.append(scratch.table(first_per(hits, ["cls"], [F.desc("similarity"), F.col("best")])))
        rest = scratch.table(rest.join(found[-1].select("cls"), "cls", "left_anti"))

    rr = best_of(r, "name", "brand", "quantity")
    take(rest.join(rr, F.col("name").eqNullSafe(F.col("r_name")) & F.col("brand").eqNullSafe(F.col("r_brand")) & F.col("quantity").eqNullSafe(F.col("r_quantity"))), 2)
    take(rest.join(best_of(r, "name"), F.col("name") == F.col("r_name")), 3)
    one = F.lit(1).alias("one")
    for step, block, t in ((4, ["brand"], same_brand), (5, ["one"], any_brand)):
        same = block if block == ["brand"] else []
        a = rest.where(F.length("name") >= shortest).select("cls", "name", "brand", "quantity", one)
        b = scratch.table(best_of(r, "name", *same, "quantity").select(F.col("r_name").alias("name"), *[F.col("r_" + c).alias(c) for c in same], "r_quantity", "best"))
        b = b if same else b.withColumn("one", F.lit(1))
        texts = trigram_texts(a, b, "name", block, t)
        hits = a.select("cls", *block, F.col("name").alias("l_text"), "quantity").join(texts, [*block, "l_text"]).join(b.withColumnRenamed("name", "r_text"), [*block, "r_text"])
        take(hits.where("r_quantity IS NULL OR quantity IS NULL OR r_quantity = quantity"), step)
    of_class = found[0]
    for more in found[1:]:
        of_class = of_class.unionByName(more)
    of_class = of_class.join(triples, "cls").select(*[F.col(c).alias("c_" + c) for c in ("name", "brand", "quantity")], "step", "similarity", "best")
    by_ean = s.where("ean IS NOT NULL").select("id", "ean").join(best_of(r.where("ean IS NOT NULL"), "ean"), F.col("ean") == F.col("r_ean")).select("id", F.lit(1).alias("step"), F.lit(None).cast("double").alias("similarity"), "best")
    by_name = s.join(of_class, (F.col("name") == F.col("c_name")) & F.col("brand").eqNullSafe(F.col("c_brand")) & F.col("quantity").eqNullSafe(F.col("c_quantity"))).select("id", "step", "similarity", "best")
    return first_per(by_ean.unionByName(by_name), ["id"], [F.col("step"), F.desc("similarity"), F.col("best")]).select("id", "best.image_url", "step")


def lookup_one_image(registry: DataFrame, index: TrigramIndex, name: str, brand: str | None = None, quantity: str | None = None, ean: str | None = None, same_brand: float = 0.3, any_brand: float = 0.45, shortest: int = 6) -> DataFrame:
    """(image_url, step): what ``lookup_image`` finds for one product, one row at most.

    ``registry`` has an ``id``; ``index`` is over its normalised names by this id, so similar
    names are found without a pass over all names.
    """
    text = lambda v: norm_text(F.lit(v).cast("string"))
    n, b, q = text(name), text(brand), text(quantity)
    r = registry.select("id", "ean", *[norm_text(F.col(c)).alias(c) for c in ("name", "brand", "quantity")], "image_url", "times_seen")
    none = F.lit(None).cast("double").alias("similarity")
    step = lambda df, i, s=none: df.select("image_url", "times_seen", s, F.lit(i).alias("step"))
    found = step(r.where((F.col("name") == n) & F.col("brand").eqNullSafe(b) & F.col("quantity").eqNullSafe(q)), 2).unionByName(step(r.where(F.col("name") == n), 3))
    if ean is not None:
        found = found.unionByName(step(r.where(F.col("ean") == ean), 1))
    if len(name.strip()) >= shortest:
        fits = r.where(F.col("quantity").isNull() | q.isNull() | (F.col("quantity") == q))
        like = fits.join(index.similar(name, min(same_brand, any_brand)), "id")
        alike = F.col("similarity").alias("similarity")
        found = found.unionByName(step(like.where((F.col("brand") == b) & (F.col("similarity") > same_brand)), 4, alike)).unionByName(step(like.where(F.col("similarity") > any_brand), 5, alike))
    return found.orderBy("step", F.desc("similarity"), F.desc("times_seen"), "image_url").limit(1).select("image_url", "step")


def backfill_images(sk: DataFrame, registry: DataFrame) -> DataFrame:
    """SKUs without an image get the registry's."""
    found = lookup_image(sk.where("image_url IS NULL"), registry).select("id", F.col("image_url").alias("__u"))
    return sk.join(found, "id", "left").withColumn("image_url", F.coalesce("image_url", "__u")).drop("__u")


def heal_images(sk: DataFrame) -> DataFrame:
    """SKUs without an image get the newest of their product's."""
    best = sk.where("product_id IS NOT NULL AND image_url IS NOT NULL").groupBy("product_id").agg(F.max_by("image_url", F.struct("updated_at", "id")).alias("__u"))
    return sk.join(best, "product_id", "left").withColumn("image_url", F.coalesce("image_url", "__u")).drop("__u")


def attach_images(df: DataFrame, images: DataFrame, name: str = "raw_name") -> DataFrame:
    """Images by name: exact, else by a part between slashes, else by containment of either name in the other; first by ``pos``.

    Distinct names meet distinct names by the first three characters of the contained one
    (all of it, if it is shorter) among the other's grams, and of images with one name only
    the first counts; rows read what their name found.  Blank names match nothing.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    scratch = Scratch(df.sparkSession, "attach")
    keys = scratch.table(images.select(key(F.col("name")).alias("k"), "image_url", "pos").where("k IS NOT NULL").groupBy("k").agg(F.min(F.struct("pos", "image_url")).alias("best")))
    want = scratch.table(df.where("image_url IS NULL").select("id", key(F.col(name)).alias("n")).where("n IS NOT NULL"))
    names = scratch.table(want.select("n").distinct())
    exact = names.join(keys, F.col("n") == F.col("k")).select("n", "best", F.lit(1).alias("step"))
    # the own name's parts, the first of them that is a whole name of an image
    part = names.select("n", F.posexplode(F.transform(F.split("n", "/"), lambda x: F.trim(x))).alias("at", "part")).join(keys, F.col("part") == F.col("k")).select("n", "best", (F.col("at") + 2).alias("step"))
    first = lambda c: F.substring(c, 1, 3)
    none = F.array().cast("array<string>")
    cut = lambda c, m: F.when(F.length(c) >= m, F.transform(F.sequence(F.lit(1), F.length(c) - (m - 1)), lambda i: F.substring(c, i, F.lit(m)))).otherwise(none)
    grams = lambda c: F.explode(F.array_distinct(F.concat(*[cut(c, m) for m in (1, 2, 3)])))
    # exploded sides are never broadcast: Spark takes their size for that of the names
    inner = keys.withColumn("g", first(F.col("k"))).join(names.withColumn("g", grams(F.col("n"))).hint("merge"), "g").where(F.contains("n", F.col("k")))
    outer = names.withColumn("g", first(F.col("n"))).join(keys.withColumn("g", grams(F.col("k"))).hint("merge"), "g").where(F.contains("k", F.col("n")))
    inside = inner.select("n", "best").unionByName(outer.select("n", "best")).groupBy("n").agg(F.min("best").alias("best")).withColumn("step", F.lit(1 << 30))
    of_name = exact.unionByName(part).unionByName(inside).groupBy("n").agg(F.min(F.struct("step", "best")).alias("found"))
    best = want.join(of_name, "n").groupBy("id").agg(F.min("found")["best"]["image_url"].alias("__u"))
    return df.join(best, "id", "left").withColumn("image_url", F.coalesce("image_url", "__u")).drop("__u")


def image_library_status(reg: DataFrame, now: datetime.datetime) -> DataFrame:
    """Per source: images, EANs, new in 7 and 30 days."""
    since = lambda n: F.col("created_at") >= F.lit(now) - F.make_dt_interval(days=F.lit(n))
    return reg.groupBy("source").agg(F.count("*").alias("images"), F.count_distinct("ean").alias("eans"), F.count_if(since(7)).alias("new_7"), F.count_if(since(30)).alias("new_30"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def image_growth(reg: DataFrame) -> DataFrame:
    return reg.groupBy(F.to_date(F.date_trunc("week", "created_at")).alias("week")).agg(F.count("*").alias("images"), F.count_distinct("source").alias("sources"))


def image_borrowed(sk: DataFrame, reg: DataFrame) -> DataFrame:
    """Per chain: SKUs with an image, and those whose image another chain registered."""
    src = reg.groupBy("image_url").agg(F.min("source").alias("source"))
    rows = sk.where("image_url IS NOT NULL").join(src, "image_url", "left")
    n, b = F.count("*"), F.count_if(F.col("source") != F.col("chain_id"))
    return rows.groupBy("chain_id").agg(n.alias("with_image"), b.alias("borrowed"), F.expr("(count_if(source <> chain_id) * 100) div count(*)").alias("borrowed_pct"))


def borrowed_images(sk: DataFrame, reg: DataFrame) -> DataFrame:
    """SKUs whose image other chains registered, with the number of those chains."""
    src = reg.select("image_url", "source").distinct()
    rows = sk.where("image_url IS NOT NULL").join(src, "image_url").where(F.col("source") != F.col("chain_id"))
    return rows.groupBy("id", "chain_id").agg(F.count("*").alias("lenders"))


def image_coverage(sk: DataFrame, live: DataFrame) -> DataFrame:
    """Per chain: active SKUs, and those with an image."""
    have = sk.join(live.select(F.col("sku_id").alias("id")), "id", "left_semi")
    return have.groupBy("chain_id").agg(F.count("*").alias("skus"), F.count("image_url").alias("with_image"), F.expr("(count(image_url) * 100) div count(*)").alias("pct"))


def missing_images(sk: DataFrame, live: DataFrame) -> DataFrame:
    """The work list: active SKUs without an image and with a usable name, by number of offers."""
    from .offers import not_banner

    n = live.groupBy(F.col("sku_id").alias("id")).agg(F.count("*").alias("offers"))
    return sk.where("image_url IS NULL").where(not_banner()).join(n, "id").select("id", "raw_name", "brand", "offers")


def registry_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).withColumn("added", F.col("after") - F.col("before"))
