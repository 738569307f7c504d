"""Flyer extraction over a table of documents (doc_id, text).

Four shapes cover the flyers' layouts.  Each takes its patterns as parameters and is a
composition of built-in functions; positions keep the page's order.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_price
from .offers import first_per

PRICE = r"(\d{1,4}[.,]\d{2})"


def extract_cards(docs: DataFrame, card: str, fields: dict[str, str], text: str = "text", key: str | None = None) -> DataFrame:
    """Every match of ``card`` is an offer; ``fields`` are patterns inside it (group 1); one row a key and document."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(card), F.lit(0))).alias("pos", "card"))
    rows = rows.select("doc_id", "pos", *[F.nullif(F.regexp_extract("card", p, 1), F.lit("")).alias(n) for n, p in fields.items()])
    return first_per(rows, ["doc_id", key], [F.col("pos")]) if key else rows


def extract_anchored(docs: DataFrame, anchor: str, noise: str | None = None, text: str = "text") -> DataFrame:
    """Price anchors with the text since the previous anchor as the product's: doc_id, pos, name, price."""
    anchors = F.regexp_extract_all(F.col(text), F.lit(anchor), F.lit(0))
    parts = F.split(F.col(text), anchor, -1)
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(anchors), F.lit(0))).alias("before"), anchors.alias("anchor"))).alias("pos", "r")).where("r.anchor IS NOT NULL")
    name = F.regexp_replace(F.col("r.before"), noise, " ") if noise else F.col("r.before")
    name = F.trim(F.regexp_replace(name, r"\s+", " "))
    return rows.select("doc_id", "pos", name.alias("name"), parse_price(F.regexp_extract("r.anchor", PRICE, 1)).alias("price"))


def extract_sections(docs: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """Lines with the last section marker (group 1) above them: doc_id, pos, line, section."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    found = F.nullif(F.regexp_extract("line", marker, 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("__m", found).withColumn("section", F.last("__m", ignorenulls=True).over(w)).where("__m IS NULL AND trim(line) <> ''").drop("__m")


def extract_blocks(docs: DataFrame, start: str, text: str = "text") -> DataFrame:
    """Line blocks: a line that matches ``start`` opens one; a price at the end of a block's last line belongs to the next.

    Gives doc_id, block, lines (joined) and carried (that price, or null).
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).where("trim(line) <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("block", F.sum(F.col("line").rlike(start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("block").over(w)
    tail = F.regexp_extract("line", rf"{PRICE}\s*$", 1)
    lines = lines.withColumn("tail", F.when((last > F.col("block")) & (tail != ""), tail))
    blocks = lines.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ").alias("lines"), F.max("tail").alias("tail"))
    return blocks.withColumn("carried", F.lag("tail").over(Window.partitionBy("doc_id").orderBy("block"))).where("block > 0").drop("tail")


def extract_passes(docs: DataFrame, anchors: Sequence[str], context: int = 500, stop: str | None = None, text: str = "text") -> DataFrame:
    """Anchor patterns in order of priority; the first pass that claims a name and price wins.

    The name is the last line before the anchor, within ``context`` characters, that is
    not noise (``stop``).
    """
    out = None
    for k, anchor in enumerate(anchors):
        rows = extract_anchored(docs, anchor, text=text) if context is None else _with_context(docs, anchor, context, stop, text)
        rows = rows.withColumn("pass", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return first_per(out.where("name <> '' AND price IS NOT NULL"), ["doc_id", F.lower("name"), "price"], [F.col("pass"), F.col("pos")])


def _with_context(docs: DataFrame, anchor: str, context: int, stop: str | None, text: str) -> DataFrame:
    anchors = F.regexp_extract_all(F.col(text), F.lit(anchor), F.lit(0))
    parts = F.split(F.col(text), anchor, -1)
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(parts.alias("before"), anchors.alias("anchor"))).alias("pos", "r")).where("r.anchor IS NOT NULL")
    lines = F.filter(F.split(F.substring("r.before", -context, context), "\n"), lambda x: (F.trim(x) != "") & (~x.rlike(stop) if stop else F.lit(True)))
    name = F.trim(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
    return rows.select("doc_id", "pos", name.alias("name"), parse_price(F.regexp_extract("r.anchor", PRICE, 1)).alias("price"))


def repair(offers: DataFrame, pages: DataFrame | None = None, days: int = 6) -> DataFrame:
    """Dates of the page over the flyer's; a missing end is the start and ``days``; the first image that is not empty."""
    out = offers
    if pages is not None:
        p = pages.select("doc_id", F.col("valid_from").alias("__f"), F.col("valid_to").alias("__t"))
        out = out.join(p, "doc_id", "left").withColumns({"valid_from": F.coalesce("__f", "valid_from"), "valid_to": F.coalesce("__t", "valid_to")}).drop("__f", "__t")
    out = out.withColumn("valid_to", F.coalesce("valid_to", F.date_add("valid_from", days)))
    return out.withColumn("image_url", F.element_at(F.filter("images", lambda u: F.trim(u) != ""), 1)) if "images" in out.columns else out


def normalize_offers(df: DataFrame, year: datetime.date | None = None) -> DataFrame:
    """Prices, quantities, mechanics, discounts and unit prices of raw offers (name, price, original, quantity, mechanic texts)."""
    from ..functions import scalars as fn

    price, original = fn.parse_price(F.col("price")), fn.parse_price(F.col("original"))
    q, m = fn.parse_quantity(F.coalesce("quantity", "name")), fn.parse_mechanic(F.col("mechanic"))
    out = df.withColumns({"price_eur": price, "original_eur": original, "q": q, "m": m})
    return out.withColumns({"discount_pct": fn.discount(F.lit(None).cast("int"), F.col("m.discount"), F.col("price_eur"), F.col("original_eur")), "unit_price": fn.unit_price(F.col("price_eur"), F.col("q.base_value"))})
