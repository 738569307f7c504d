"""Matching SKUs to canonical products, and merging products."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions.similarity import stems, trigram_texts
from ..graph import components
from ..storage import Scratch
from .offers import first_per


def with_key(sk: DataFrame) -> DataFrame:
    return sk.withColumn("match_key", fn.match_key(F.col("brand"), F.col("raw_name"), F.col("raw_quantity")))


def match_groups(sk: DataFrame) -> DataFrame:
    """Unmatched SKUs by key: SKUs, chains, and whether several chains have it."""
    g = with_key(sk.where("product_id IS NULL")).groupBy("match_key").agg(F.count("*").alias("skus"), F.count_distinct("chain_id").alias("chains"))
    return g.withColumn("multi_chain", F.col("chains") > 1)


def elect_names(sk: DataFrame) -> DataFrame:
    """The naming SKU of each key: 10 for a brand plus the name's length, the lowest id on ties."""
    score = F.when(F.col("brand").isNotNull() & (F.col("brand") != ""), 10).otherwise(0) + F.length("raw_name")
    return with_key(sk).groupBy("match_key").agg(F.max_by(F.struct("id", "raw_name", "brand", "raw_quantity"), F.struct(score, -F.col("id"))).alias("e")).select("match_key", "e.*")


def canonicalize(sk: DataFrame, products: DataFrame) -> DataFrame:
    """A canonical row for each key; an existing slug is reused, new ids are hashes of the slug."""
    e = elect_names(sk.where("product_id IS NULL"))
    e = e.withColumn("slug", fn.slugify(F.concat_ws(" ", "brand", "raw_name", "raw_quantity")))
    old = products.select(F.col("id").alias("old_id"), fn.slugify(F.col("name")).alias("slug")).groupBy("slug").agg(F.min("old_id").alias("old_id"))
    q = fn.parse_quantity(F.col("raw_quantity"))
    return e.join(old, "slug", "left").select("match_key", "slug", F.col("raw_name").alias("name"), "brand", q["base_unit"].alias("base_unit"), F.coalesce("old_id", F.xxhash64("slug")).alias("product_id"), F.col("old_id").isNull().alias("created"))


def _candidates(p: DataFrame, sk: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """(members, texts): products with their least and greatest chain, and the similar names (l_text, r_text) of a brand and category."""
    base = p.select("id", "name", F.lower("brand").alias("b"), "category")
    of = sk.where("product_id IS NOT NULL").groupBy(F.col("product_id").alias("id")).agg(F.min("chain_id").alias("low"), F.max("chain_id").alias("high"))
    scratch = Scratch(p.sparkSession, "candidates")
    return scratch.table(base.join(of, "id")), scratch.table(trigram_texts(base, base, "name", ["b", "category"], t))


def candidate_pairs(p: DataFrame, sk: DataFrame, t: float = 0.3) -> DataFrame:
    """Unordered pairs of products with one brand and category, in different chains, and similar names.

    Distinct names are compared; products meet their names' partners last, in joins that
    shuffle products and (product, similar name) only, so pairs leave the task that makes them
    as rows of the result and nowhere else.
    """
    members, texts = _candidates(p, sk, t)
    side = lambda s: members.select("b", "category", F.col("name").alias(f"{s}_text"), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "low", "high")])
    near = texts.join(side("r").hint("merge"), ["b", "category", "r_text"])
    # two chains at least in both: the least of all is not the greatest
    several = F.least("l_low", "r_low") < F.greatest("l_high", "r_high")
    return near.join(side("l").hint("merge"), ["b", "category", "l_text"]).where((F.col("l_id") < F.col("r_id")) & several).select("l_id", "r_id", "similarity")


def fuzzy_link(sk: DataFrame, p: DataFrame, t: float = 0.6) -> DataFrame:
    """The best same-brand product of each unmatched SKU, found once for each of their distinct names."""
    scratch = Scratch(sk.sparkSession, "link")
    a = scratch.table(sk.where("product_id IS NULL").select("id", F.lower("raw_name").alias("name"), F.lower("brand").alias("b")))
    # of products with one name the first is the best of any SKU
    first = scratch.table(p.groupBy("name", F.lower("brand").alias("b")).agg(F.min("id").alias("id")))
    texts = trigram_texts(a, first, "name", ["b"], t).join(first.select("b", F.col("name").alias("r_text"), F.col("id").alias("product_id")), ["b", "r_text"])
    best = first_per(texts, ["b", "l_text"], [F.desc("similarity"), F.col("product_id")])
    best = best.select("b", F.col("l_text").alias("name"), "product_id", F.col("similarity").alias("confidence"))
    return a.join(best, ["b", "name"]).select(F.col("id").alias("sku_id"), "product_id", "confidence")


def merge_products(pairs: DataFrame, sk: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skus, products) after confirmed pairs (l_id, r_id): ids go to the smallest of their component, merged products go."""
    to = components(pairs, "l_id", "r_id")
    skus = sk.join(to.withColumnRenamed("node", "product_id"), "product_id", "left").withColumn("product_id", F.coalesce("component", "product_id")).select(*sk.columns)
    return skus, p.join(to.where("node <> component").select(F.col("node").alias("id")), "id", "left_anti")


def batch_pairs(pairs: DataFrame, size: int = 30) -> DataFrame:
    """Pairs in batches of ``size``: batch number and 1-based place, for an outside decision.

    Numbers run through all pairs, by (l_id modulo 64, l_id, r_id): places inside a block
    plus the sizes of the blocks before it, so no task holds all pairs and only the last
    batch is smaller.
    """
    block = F.pmod("l_id", F.lit(64))
    rows = pairs.withColumn("__block", block).withColumn("__n", F.row_number().over(Window.partitionBy("__block").orderBy("l_id", "r_id")))
    sizes = pairs.groupBy(block.alias("__block")).agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))  # at most 64 rows
    starts = sizes.withColumn("__start", F.coalesce(before, F.lit(0))).drop("__size")
    at = F.col("__start") + F.col("__n") - 1
    return rows.join(F.broadcast(starts), "__block").withColumns({"batch": F.floor(at / size), "place": (at % size + 1).cast("int")}).drop("__n", "__block", "__start")


def candidate_batches(p: DataFrame, sk: DataFrame, size: int = 30, t: float = 0.3) -> DataFrame:
    """What ``batch_pairs`` makes of ``candidate_pairs``, without a shuffle or a sort of the pairs.

    Products with one name, brand and category that are in several chains, or in the same one,
    have the same partners.  This list is numbered once by id, and so is a product's own place in it: its
    pairs are the rest of the list, and their places are differences of these numbers.  Only the
    join that makes the result has a row a pair.
    """
    members, texts = _candidates(p, sk, t)
    # in several chains, or in this one
    members = members.withColumn("kind", F.when(F.col("low") < F.col("high"), "*").otherwise(F.concat(F.lit("="), F.col("low").cast("string"))))
    members = members.withColumn("kind", F.coalesce("kind", F.lit("")))
    key = ["b", "category", "l_text", "l_kind"]
    own = members.select("b", "category", F.col("name").alias("l_text"), F.col("kind").alias("l_kind"), F.col("id").alias("at"), F.lit(0).alias("listed"))
    other = members.select("b", "category", F.col("name").alias("r_text"), F.col("kind").alias("r_kind"), F.col("id").alias("at"), F.lit(1).alias("listed"))
    lists = texts.join(own.select(*key).distinct(), key[:3]).join(other.hint("merge"), ["b", "category", "r_text"])
    lists = lists.where("l_kind = '*' OR r_kind = '*' OR (l_kind <> r_kind AND l_kind <> '' AND r_kind <> '')")
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("at", F.desc("listed")).rowsBetween(Window.unboundedPreceding, 0)
    scratch = Scratch(p.sparkSession, "batches")
    ranked = scratch.table(lists.select(*own.columns).unionByName(own).withColumns({"upto": F.sum("listed").over(upto), "all": F.sum("listed").over(whole)}))
    left = ranked.where("listed = 0").select(*key, F.col("at").alias("l_id"), F.col("upto").alias("own"), (F.col("all") - F.col("upto")).alias("n"))
    block = F.pmod("l_id", F.lit(64))
    sizes = left.groupBy(block.alias("__block")).agg(F.sum("n").alias("__size"))
    starts = sizes.select("__block", F.coalesce(F.sum("__size").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # at most 64 rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__block").orderBy("l_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("__block", block).withColumn("__before", before).join(F.broadcast(starts), "__block")
    left = left.select(*key, "l_id", "own", (F.col("__start") + F.col("__before")).alias("before"))
    right = ranked.where("listed = 1").select(*key, F.col("at").alias("r_id"), "upto")
    at = F.col("before") + F.col("upto") - F.col("own") - 1
    pairs = right.join(left.hint("merge"), key).where("l_id < r_id").withColumn("at", at)
    return pairs.select("l_id", "r_id", F.floor(F.col("at") / size).alias("batch"), (F.col("at") % size + 1).cast("int").alias("place"))


def apply_decisions(batched: DataFrame, decisions: DataFrame) -> DataFrame:
    """The pairs whose (batch, place) is confirmed."""
    return batched.join(decisions, ["batch", "place"], "left_semi").select("l_id", "r_id")


def apply_categories(p: DataFrame, decisions: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories decided outside: unknown slugs and 'altro' are ignored, only rows still 'altro' change."""
    ok = decisions.where("slug <> 'altro'").join(categories.select("slug"), "slug", "left_semi").select("id", F.col("slug").alias("__new"))
    return p.join(ok, "id", "left").withColumn("category", F.when(F.col("category") == "altro", F.coalesce("__new", "category")).otherwise(F.col("category"))).drop("__new")


#: Rules that are sent to every executor; more of them are shuffled, and so are the texts' runs.
MOST_RULES = 100_000


def classify(df: DataFrame, rules: DataFrame, texts: Sequence[str] = ("name", "brand", "description"), id_col: str = "id", default: str = "altro") -> DataFrame:
    """Each row with the ``slug`` of its first rule (rank, slug, keyword) of which the keyword occurs as whole words.

    The words of the columns ``texts`` that the row has follow one another.  A keyword with
    a blank at its end asks for a word behind it.  Runs of words meet keywords in an
    equi-join, so a rule table of any size costs no pass for each rule.  Rows that no rule
    fits get ``default``; of rules of one rank the least slug wins.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    keys = rules.select("rank", "slug", F.col("keyword").endswith(" ").alias("more"), split(F.col("keyword")).alias("k")).where("size(k) > 0")
    keys = keys.select("rank", "slug", "more", F.array_join("k", " ").alias("k"), F.size("k").alias("n"))
    most, rows = keys.agg(F.max("n"), F.count("*")).first()
    most = most or 0
    words = df.select(id_col, split(F.concat_ws(" ", *[F.col(c) for c in texts if c in df.columns])).alias("w"))

    def run(n: int):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("k"), (i + n <= F.size("w")).alias("followed")))

    runs = F.concat(F.array().cast("array<struct<k:string,followed:boolean>>"), *map(run, range(1, most + 1)))
    found = words.select(id_col, F.explode(F.array_distinct(runs)).alias("r")).select(id_col, "r.*")
    # Spark takes the size of exploded runs for that of the texts, and would send them to the driver for a broadcast
    keys = keys.drop("n")
    found = found.join(F.broadcast(keys) if rows <= MOST_RULES else keys.hint("merge"), "k").where("followed OR NOT more")
    best = found.groupBy(id_col).agg(F.min(F.struct("rank", "slug"))["slug"].alias("slug"))
    return df.join(best, id_col, "left").fillna(default, ["slug"])


def refresh_tags(sk: DataFrame, now: datetime.datetime, since_hours: int = 0, tags: dict | None = None) -> DataFrame:
    """New tags, normalised names and, if there is such a column, stems of name and brand for rows that changed in the last hours; 0 means all."""
    touched = F.lit(True) if since_hours == 0 else F.col("updated_at") >= F.lit(now) - F.make_dt_interval(hours=F.lit(since_hours))
    new = {"tags": fn.dietary_tags(F.col("raw_name"), tags), "normalized_name": fn.norm_text(F.col("raw_name"))}
    if "stems" in sk.columns:
        new["stems"] = stems(F.concat_ws(" ", "raw_name", "brand"))
    return sk.withColumns({c: F.when(touched, v).otherwise(F.col(c)) for c, v in new.items()})
