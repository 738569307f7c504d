"""Trigram similarity, its prefix-filtered join, light Italian stems, and great-circle distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Italian words that a text query ignores.
STOP = ["di", "a", "da", "in", "con", "su", "per", "tra", "fra", "il", "lo", "la", "i", "gli", "le", "un", "uno", "una", "e", "del", "della", "dei", "al", "alla"]


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text's words, each word with two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 without any."""
    return F.coalesce(set_similarity(trigrams(a), trigrams(b)), F.lit(0.0))


def trigram_texts(left: DataFrame, right: DataFrame, text: str, block: Sequence[str], t: float) -> DataFrame:
    """(block, l_text, r_text, similarity): the distinct texts of equal block keys with a similarity above ``t``.

    Both sides have ``text`` and the block keys.  Prefix filtering: of each text only the
    rarest trigrams are join keys, as many as a pair above ``t`` must share one of; pairs
    are then verified on the whole sets.  Null keys join nothing.  Rows with equal texts are
    one text here, so copies cost no pairs: callers that need one row of many join the best.
    """
    def prepared(df: DataFrame) -> DataFrame:
        # equal texts of a block are one row until the end
        texts = df.where(F.col(text).isNotNull()).select(*block, text).distinct()
        return texts.select(F.xxhash64(text, *block).alias("k"), *block, text, trigrams(F.col(text)).alias("g")).where(F.size("g") > 0)

    a, b = prepared(left), prepared(right)
    freq = a.select(F.explode("g").alias("t")).unionByName(b.select(F.explode("g").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefix(df: DataFrame, side: str) -> DataFrame:
        rows = df.select("k", *block, F.size("g").alias("n"), F.explode("g").alias("t")).join(freq, "t")
        rare = Window.partitionBy("k", *block).orderBy("f", "t")
        rows = rows.withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * t) + 1)
        return rows.select(F.col("k").alias(f"{side}_k"), "t", *block)

    pairs = prefix(a, "l").join(prefix(b, "r"), ["t", *block]).select("l_k", "r_k", *block).distinct()
    side = lambda df, s: df.select(F.col("k").alias(f"{s}_k"), *block, F.col(text).alias(f"{s}_text"), F.col("g").alias(f"{s}_g"))
    pairs = pairs.join(side(a, "l"), ["l_k", *block]).join(side(b, "r"), ["r_k", *block])
    return pairs.select(*block, "l_text", "r_text", set_similarity(F.col("l_g"), F.col("r_g")).alias("similarity")).where(F.col("similarity") > t)


def trigram_join(left: DataFrame, right: DataFrame, text: str, block: Sequence[str], t: float, on: str = "id") -> DataFrame:
    """Pairs (l_id, r_id, similarity) of the rows of ``trigram_texts``; both sides have ``on``, too."""
    pairs = trigram_texts(left, right, text, block, t)
    ids = lambda df, s: df.select(F.col(on).alias(f"{s}_id"), *block, F.col(text).alias(f"{s}_text"))
    return pairs.join(ids(left, "l"), ["l_text", *block]).join(ids(right, "r"), ["r_text", *block]).select("l_id", "r_id", "similarity")


def stem_list(c: Column) -> Column:
    """The stems of a text in order: folded words without stop words and without their final vowels."""
    from .scalars import no_accents

    words = F.filter(F.split(no_accents(F.lower(c)), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP))
    return F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "[aeiou]+$", "")).otherwise(w))


def stems(c: Column) -> Column:
    """The distinct stems of a text."""
    return F.array_distinct(stem_list(c))


def text_match(doc: Column, query: str) -> Column:
    """Whether a text holds every stem of the query."""
    return F.size(F.array_except(stems(F.lit(query)), stems(doc))) == 0


def text_rank(doc: Column, query: str) -> Column:
    """Matched stems over the document's stems."""
    return F.size(F.array_intersect(stems(doc), stems(F.lit(query)))) / F.nullif(F.size(stems(doc)), F.lit(0))


RADIUS_KM = 6371.0088


def distance_km(lat1, lng1, lat2, lng2) -> Column:
    """Haversine distance."""
    a, b, c, d = (F.radians(x) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within_km(df: DataFrame, lat: float, lng: float, km: float, most: float = 50.0) -> DataFrame:
    """Rows within the radius (50 km at most) with distance_km; rows without coordinates stay."""
    d = distance_km(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    return df.withColumn("distance_km", F.round(d, 1)).where(F.col("lat").isNull() | (d <= min(km, most)))


def geo_join(points: DataFrame, stores: DataFrame, km: float) -> DataFrame:
    """Pairs (point_id, store_id, distance_km) within the radius, by an equi-join on grid cells.

    A cell is one radius high; its width follows the latitude band's widest parallel, so
    that the eight neighbours hold every match.  Distinct positions are compared; what a position
    is near is dealt over all tasks before the stores there are joined, so a busy one is no long task.
    """
    spark = points.sparkSession
    everyone, there = points, stores.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col("id").alias("store_id"), F.col("lat").alias("slat"), F.col("lng").alias("slng"))
    points, stores = points.select("lat", "lng").distinct(), stores.select("lat", "lng").distinct()
    step = km / 111.19
    row = lambda lat: F.floor(lat / step)
    # the band's parallel nearest to the pole decides the width; neighbours use their own band's
    width = lambda r: step / F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step, F.lit(89.0))))
    s = stores.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col("lat").alias("slat"), F.col("lng").alias("slng"), row(F.col("lat")).alias("r"))
    s = s.withColumn("c", F.floor(F.col("slng") / width(F.col("r"))))
    p = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    p = p.withColumn("r", F.explode(F.sequence(row(F.col("plat")) - 1, row(F.col("plat")) + 1))).withColumn("w", width(F.col("r")))
    p = p.withColumn("c", F.explode(F.sequence(F.floor(F.col("plng") / F.col("w")) - 1, F.floor(F.col("plng") / F.col("w")) + 1)))
    d = distance_km(F.col("plat"), F.col("plng"), F.col("slat"), F.col("slng"))
    near = p.join(s, ["r", "c"]).where(d <= km).select("plat", "plng", "slat", "slng", F.round(d, 1).alias("distance_km"))
    near = everyone.select(F.col("id").alias("point_id"), F.col("lat").alias("plat"), F.col("lng").alias("plng")).join(near, ["plat", "plng"])
    # a given number: few rows here are many after the join, which Spark cannot tell when it merges small partitions
    near = near.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "point_id", "slat", "slng")
    return near.join(there, ["slat", "slng"]).select("point_id", "store_id", "distance_km")
