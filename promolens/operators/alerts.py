"""Watch and list alerts, events and run monitoring."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import alert_text, ip_hash
from ..functions.similarity import trigram_texts
from ..storage import Scratch
from .offers import day, first_per


def match_watches(w: DataFrame, live: DataFrame, tags: DataFrame, t: float = 0.4) -> DataFrame:
    """(watch_id, offer_id) by type: category by tag; keyword by substring; product by substring or similarity.

    Distinct queries meet distinct names, not watches offers: names and queries are small
    vocabularies.  Substrings are found by an equi-join on a query's first three characters,
    or on the whole of a shorter query, so no pair that shares none is formed; a blank query
    is in every name.  Watches may have ``chain_filter`` (slugs) and ``store_filter`` (store
    ids); a null or empty list asks for nothing, and offers without a store pass any store list.
    """
    q, hits, o, bounds = _hits(w, live, t)
    text = q.where("watch_type <> 'category'").join(hits, "q").where("watch_type = 'product' OR sub").join(o, "name")
    category = q.where("watch_type = 'category'").join(_of_tag(tags), "q").join(o, "sku_id")
    cols = ["watch_id", "offer_id", *OFFER]
    return _within(text, bounds).select(*cols).unionByName(_within(category, bounds).select(*cols))


#: What a hit tells of its offer.
OFFER = ["price_cents", "discount_pct", "chain_slug", "raw_name", "valid_to"]


def _hits(w: DataFrame, live: DataFrame, t: float) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """(watches, (query, name, whether it is a substring), offers, the bounds that watches have)."""
    bounds = ["max_price_cents", *[c for c in ("chain_filter", "store_filter") if c in w.columns]]
    q = w.select(F.col("id").alias("watch_id"), "watch_type", F.lower(F.trim("query")).alias("q"), *bounds)
    queries = q.where("watch_type <> 'category' AND q IS NOT NULL").select("q").distinct()
    # written once: the star join behind the offers is not planned again for each use
    scratch = Scratch(w.sparkSession, "watches")
    o = scratch.table(live.select(F.col("id").alias("offer_id"), "sku_id", F.lower("raw_name").alias("name"), *OFFER, *(["store_id"] if "store_filter" in bounds else [])))
    queries, names = scratch.table(queries), scratch.table(o.select("name").distinct())
    none = F.array().cast("array<string>")
    grams = lambda c, n: F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(none)
    # a substring's first characters occur in the name
    named = names.withColumn("g", F.explode(F.concat(F.array(F.lit("")), *[grams(F.col("name"), n) for n in (1, 2, 3)])))
    sub = queries.withColumn("g", F.substring("q", 1, 3)).join(named, "g").where(F.contains("name", F.col("q"))).select("q", "name", F.lit(True).alias("sub"))
    like = trigram_texts(queries.select(F.col("q").alias("text"), F.lit(1).alias("one")), names.select(F.col("name").alias("text"), F.lit(1).alias("one")), "text", ["one"], t)
    hits = sub.unionByName(like.select(F.col("l_text").alias("q"), F.col("r_text").alias("name"), F.lit(False).alias("sub"))).groupBy("q", "name").agg(F.max("sub").alias("sub"))
    return q, hits, o, bounds


def _of_tag(tags: DataFrame) -> DataFrame:
    return tags.select(F.col("id").alias("sku_id"), F.explode("tags").alias("q"))


def _within(df: DataFrame, bounds: list[str]) -> DataFrame:
    """Pairs of watch and offer within the watch's bounds."""
    df = df.where("max_price_cents IS NULL OR price_cents <= max_price_cents")
    if "chain_filter" in bounds:
        df = df.where("coalesce(size(chain_filter), 0) <= 0 OR array_contains(chain_filter, chain_slug)")
    if "store_filter" in bounds:
        df = df.where("coalesce(size(store_filter), 0) <= 0 OR store_id IS NULL OR array_contains(store_filter, store_id)")
    return df


def watch_classes(w: DataFrame, who: DataFrame | None = None, by_user: bool = False) -> tuple[DataFrame, DataFrame]:
    """(classes, members (watch_id, id)): watches that ask for the same are one class, a watch of its own under a new id.

    ``who`` (watch_id) lists watches that stay alone; ``by_user`` keeps the users apart.
    """
    scratch = Scratch(w.sparkSession, "classes")
    same = ["watch_type", "query", *[c for c in ("max_price_cents", "chain_filter", "store_filter") if c in w.columns], *(["user_id"] if by_user else [])]
    rows = w.withColumns({"watch_id": F.col("id"), "query": F.lower(F.trim("query"))}).select("watch_id", *same).withColumn("alone", F.lit(None).cast(w.schema["id"].dataType))
    if who is not None:
        rows = rows.join(who.select("watch_id").distinct().withColumn("__who", F.col("watch_id")), "watch_id", "left").withColumn("alone", F.col("__who")).drop("__who")
    same.append("alone")
    rows = scratch.table(rows)
    classes = scratch.table(rows.select(*same).distinct().withColumn("id", F.monotonically_increasing_id()))
    right = classes.select("id", *[F.col(c).alias("__" + c) for c in same])
    on = [F.col(c).eqNullSafe(F.col("__" + c)) for c in same]
    return classes, scratch.table(rows.join(right, functools.reduce(lambda a, b: a & b, on)).select("watch_id", "id"))


def _untold(hits: DataFrame, told: DataFrame | None, users: DataFrame | None) -> DataFrame:
    if told is not None:
        hits = hits.join(told.select(F.col("watch_id").alias("alone"), "offer_id"), ["alone", "offer_id"], "left_anti")
    return hits if users is None else hits.join(users.select("user_id", "offer_id"), ["user_id", "offer_id"], "left_anti")


def watch_totals(w: DataFrame, live: DataFrame, tags: DataFrame, sent_to_users: DataFrame | None = None, t: float = 0.4) -> DataFrame:
    """(watch_id, n, low): the hits of each watch that has any and their lowest price, without offers that its user was told of.

    The totals of ``match_watches``, found once for each class of watches.
    """
    classes, members = watch_classes(w, by_user=sent_to_users is not None)
    hits = match_watches(classes, live, tags, t)
    if sent_to_users is not None:
        hits = _untold(hits.join(classes.select(F.col("id").alias("watch_id"), "user_id"), "watch_id"), None, sent_to_users)
    totals = hits.groupBy(F.col("watch_id").alias("id")).agg(F.count("*").alias("n"), F.min("price_cents").alias("low"))
    return members.join(totals, "id").select("watch_id", "n", "low")


def best_for_watches(w: DataFrame, live: DataFrame, tags: DataFrame, k: int = 10, sent: DataFrame | None = None, t: float = 0.4, block: int = 64, sent_to_users: DataFrame | None = None) -> DataFrame:
    """(watch_id, offer_id, ..., place): the ``k`` best hits of each watch, without those in ``sent`` (watch_id, offer_id).

    The same as the first of ``match_watches``, by discount, price and id, without making all
    hits: what ``best_of_classes`` finds, for each watch of a class.
    """
    found, members = best_of_classes(w, live, tags, k, sent, t, block, sent_to_users)
    return members.join(found, "id").drop("id")


def best_of_classes(w: DataFrame, live: DataFrame, tags: DataFrame, k: int = 10, sent: DataFrame | None = None, t: float = 0.4, block: int = 64, sent_to_users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the ``k`` best (id, offer_id, ..., place) of each class of watches, members (watch_id, id)).

    Watches that ask for the same, and were told of none of these offers, are one class.
    ``sent_to_users`` (user_id, offer_id) tells what the users know by any of their watches.
    The offers of each distinct query or tag are ranked once, and the classes read
    their ranked list in blocks, each four times the one before, until they have ``k`` within their bounds
    or the list ends.
    """
    scratch = Scratch(w.sparkSession, "best")
    told = None if sent is None else scratch.table(sent.select("watch_id", "offer_id").join(live.select(F.col("id").alias("offer_id")), "offer_id", "left_semi"))
    users = None if sent_to_users is None else scratch.table(sent_to_users.select("user_id", "offer_id"))
    classes, members = watch_classes(w, told, users is not None)
    q, hits, o, bounds = _hits(classes, live, t)
    hits = scratch.table(hits)  # read twice
    q = q.withColumnRenamed("watch_id", "id").join(classes.select("id", "alone", *(["user_id"] if users is not None else [])), "id")
    text = hits.join(o, "name").drop("name", "sku_id")
    lists = text.where("sub").withColumn("kind", F.lit("keyword")).unionByName(text.withColumn("kind", F.lit("product"))).drop("sub")
    lists = lists.unionByName(_of_tag(tags).join(o, "sku_id").drop("name", "sku_id").withColumn("kind", F.lit("category")))
    # only what some watch asks for
    asked = q.select(F.col("watch_type").alias("kind"), "q").distinct()
    order = Window.partitionBy("kind", "q").orderBy(F.desc_nulls_last("discount_pct"), "price_cents", "offer_id")
    lists = scratch.table(lists.join(asked, ["kind", "q"], "left_semi").withColumn("rank", F.row_number().over(order)))
    ends = lists.groupBy("kind", "q").agg(F.max("rank").alias("last"))
    open_ = scratch.table(q.withColumnRenamed("watch_type", "kind").join(ends, ["kind", "q"]).withColumn("have", F.lit(0).cast("long")))
    longest = lists.agg(F.max("rank")).first()[0] or 0
    parts, low, block = [], 0, max(block, k)
    while low < longest and open_.take(1):
        high = min(low + block, longest)
        some = _untold(_within(open_.join(lists.where(f"rank > {low} AND rank <= {high}"), ["kind", "q"]), bounds), told, users)
        parts.append(scratch.table(some.select("id", "offer_id", *OFFER, "rank")))
        if high < longest:
            n = parts[-1].groupBy("id").agg(F.count("*").alias("__n"))
            open_ = open_.join(n, "id", "left").withColumn("have", F.col("have") + F.coalesce("__n", F.lit(0))).drop("__n")
            open_ = scratch.table(open_.where((F.col("have") < k) & (F.col("last") > high)))
        low, block = high, 4 * block
    if not parts:
        return classes.select("id").join(o, F.lit(False)).select("id", "offer_id", *OFFER, F.lit(1).alias("place")), members
    found = functools.reduce(DataFrame.unionByName, parts)
    if low <= k:  # no class has read more; places that nobody asks for are not sorted
        return found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).drop("rank"), members
    return first_per(found, ["id"], [F.col("rank")], k, "place").drop("rank"), members


def match_list_items(items: DataFrame, live: DataFrame) -> DataFrame:
    """List items and the live offers of their product, within optional bounds."""
    o = live.select(F.col("id").alias("offer_id"), "product_id", "price_cents", "discount_pct", "chain_slug", "raw_name", "valid_to")
    hits = items.join(o, "product_id")
    if "max_price_cents" in items.columns:
        hits = hits.where("max_price_cents IS NULL OR price_cents <= max_price_cents")
    if "min_discount" in items.columns:
        hits = hits.where("min_discount IS NULL OR discount_pct >= min_discount")
    return hits


def new_alerts(hits: DataFrame, notified: DataFrame, key: str, k: int, known_by: str | None = None) -> DataFrame:
    """Hits that were not told before, the ``k`` best of each key, with their text.

    ``notified`` has the key and offer_id, or the column ``known_by`` of the hits instead of the key.
    """
    by = known_by or key
    fresh = hits.join(notified.select(by, "offer_id"), [by, "offer_id"], "left_anti")
    best = first_per(fresh, [key], [F.desc_nulls_last("discount_pct"), F.col("price_cents"), F.col("offer_id")], k, "place")
    return with_text(best)


def with_text(best: DataFrame) -> DataFrame:
    """Alerts with their text."""
    return best.withColumn("text", alert_text(F.col("raw_name"), F.col("chain_slug"), F.col("price_cents"), F.col("discount_pct"), F.col("valid_to")))


def event_summary(ev: DataFrame, d: datetime.date, days: int = 30, approx: bool = False) -> DataFrame:
    """Per day and type: events, sessions, users; exact unless ``approx``."""
    n = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    rows = ev.where((F.col("day") > F.date_sub(day(d), days)) & (F.col("day") <= day(d)))
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("events"), n("session_id").alias("sessions"), n("telegram_user_id").alias("users"))


def event_totals(ev: DataFrame, d: datetime.date, days: int = 30, approx: bool = False) -> DataFrame:
    """Events, sessions and users of a window; exact unless ``approx``."""
    n = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    rows = ev.where((F.col("day") > F.date_sub(day(d), days)) & (F.col("day") <= day(d)))
    return rows.agg(F.count("*").alias("events"), n("session_id").alias("sessions"), n("telegram_user_id").alias("users"))


#: lgK of the stored sketches: 2^12 registers, a standard error of 1.6 percent.
SKETCH = 12


def daily_sketches(ev: DataFrame) -> DataFrame:
    """Per day and type: events, and sketches of sessions and users whose unions count any window's distinct ones."""
    return ev.groupBy("day", "event_type").agg(
        F.count("*").alias("events"), F.hll_sketch_agg("session_id", SKETCH).alias("sessions"), F.hll_sketch_agg(F.col("telegram_user_id").cast("string"), SKETCH).alias("users"))


def sketch_totals(sketches: DataFrame, d: datetime.date, days: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Events exactly, and sessions and users nearly, of a window from its daily rows; per ``by`` or in all."""
    rows = sketches.where((F.col("day") > F.date_sub(day(d), days)) & (F.col("day") <= day(d)))
    n = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
    return rows.groupBy(*by).agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"), n("sessions"), n("users"))


def top_searches(ev: DataFrame, d: datetime.date, days: int = 30, k: int = 10, path: str = "$.k") -> DataFrame:
    rows = ev.where((F.col("day") > F.date_sub(day(d), days)) & (F.col("day") <= day(d))).select(F.get_json_object("metadata", path).alias("term")).where("term IS NOT NULL")
    return rows.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(k)


def event_mix(ev: DataFrame) -> DataFrame:
    """Events by type, and their share of all in tenths of a percent."""
    n = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).selectExpr("event_type", "n", "(n * 1000) div total AS per_mille")


def daily_series(ev: DataFrame, d: datetime.date, days: int = 30) -> DataFrame:
    """Events of each day, zero where there are none, and the share of the busiest day in percent."""
    calendar = ev.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(day(d), days - 1), day(d))).alias("day"))
    n = ev.groupBy("day").agg(F.count("*").alias("n"))
    rows = calendar.join(n, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.crossJoin(rows.agg(F.max("n").alias("top"))).selectExpr("day", "n", "IF(top = 0, 0, (n * 100) div top) AS pct_of_top")


def clean_events(df: DataFrame, types: list[str], salt: str, most_bytes: int = 2048) -> DataFrame:
    """Events of listed types with metadata within the limit; the address is hashed."""
    return df.where(F.col("event_type").isin(types) & (F.coalesce(F.octet_length("metadata"), F.lit(0)) <= most_bytes)).withColumn("ip_hash", ip_hash(F.col("ip"), salt)).drop("ip")


def recent_runs(r: DataFrame, now: datetime.datetime, k: int = 100, stuck_hours: int = 2) -> DataFrame:
    """Newest runs with their age and a flag for those that are probably stuck."""
    age = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("started_at")
    return r.withColumns({"age_s": age, "stuck": (F.col("status") == "running") & (age > stuck_hours * 3600)}).orderBy(F.desc("started_at"), F.desc("id")).limit(k)


def run_feed(r: DataFrame, now: datetime.datetime, run_type: str | None = None, chain: str | None = None, status: str | None = None, k: int = 50) -> DataFrame:
    """The newest runs of a type, chain and status (None: any), 1 to 200 of them, with their age and the stuck flag."""
    for column, value in (("run_type", run_type), ("chain", chain), ("status", status)):
        if value is not None:
            r = r.where(F.col(column) == value)
    return recent_runs(r, now, max(1, min(k, 200)))


def last_run_per_type(r: DataFrame) -> DataFrame:
    return first_per(r, ["run_type"], [F.desc("started_at"), F.desc("id")])


def last_failures(r: DataFrame, now: datetime.datetime, days: int = 14, k: int = 20) -> DataFrame:
    return r.where((F.col("status") == "failed") & (F.col("started_at") >= F.lit(now) - F.make_dt_interval(days=F.lit(days)))).orderBy(F.desc("started_at"), F.desc("id")).limit(k)


def run_rollup(r: DataFrame) -> DataFrame:
    """Per day: successes, failures, the products of the successes (0 without such a column), and the level.

    The level is critical without a success, warning with failures, else info.
    """
    ok = F.col("status") == "success"
    products = F.sum(F.when(ok, F.col("products"))) if "products" in r.columns else F.lit(None).cast("long")
    g = r.groupBy(F.to_date("started_at").alias("day")).agg(F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(products, F.lit(0)).alias("products"))
    return g.withColumn("level", F.when(F.col("ok") == 0, "critical").when(F.col("failed") > 0, "warning").otherwise("info"))


def new_failures(obs: DataFrame) -> DataFrame:
    """Observations (unit, ts, failed, exit_time) at which a failure is new: not failed before, or with another exit time."""
    w = Window.partitionBy("unit").orderBy("ts", "id")
    was, exit_ = F.lag("failed").over(w), F.lag("exit_time").over(w)
    return obs.withColumns({"__w": was, "__e": exit_}).where("failed AND (__w IS NULL OR NOT __w OR NOT (exit_time <=> __e))").drop("__w", "__e")
