"""Mixing sources to target weights by a time-varying curriculum.

A source has a weight schedule over training time t in [0, 1]: linear pieces between
(t, weight) knots.  The schedule's integral, scaled to the source's target, is the
source's cumulative token demand.  The documents of a source form a stream in hash
order, repeated as often as the target asks (three times at most); a copy is taken if
its middle lies before the target, and its training position is the time at which the
demand reaches that middle.  The taken copies are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Hash buckets of a source's stream; a source's prefix sum runs over buckets first, then inside each.
BUCKET_HEX = 3
#: Rows of one id of a source from which on they have buckets of their own, by size.
HOT = 1_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum
    of all sizes.  A target stops at ``most`` times its source's size and the excess goes
    to the others by weight.  That fixed point is target = min(cap, level * weight): with
    sources ordered by cap / weight, the level is (total - caps so far) / (weights left)
    at the first source that stays below its cap.
    """
    one = F.lit(1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row a source from here on
    order = Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("double"))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(one)
    per = per.withColumns({
        "__total": F.sum("source_size").over(whole).cast("double"),
        "__caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "__left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("__try", (F.col("__total") - F.col("__caps")) / F.col("__left"))
    per = per.withColumn("__place", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("__try") * F.col("weight") <= F.col("cap"), F.struct("__place", "__try"))).over(whole)
    per = per.withColumn("__level", level["__try"])
    target = F.when(F.col("__level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("__level") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _inverse_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which a schedule's integral reaches ``share`` (0 to 1) of its whole."""
    area, steps = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        steps.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    if area <= 0:
        raise ValueError("a schedule needs a positive integral")
    out = F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, start in reversed(steps):
        a, rest = (w1 - w0) / (2 * (t1 - t0)), share * area - start
        if abs(a) < 1e-12:
            x = rest / w0 if w0 else F.lit(0.0)
        else:
            x = (-w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 4 * a * rest))) / (2 * a)
        out = F.when(share * area <= start + (t1 - t0) * (w0 + w1) / 2, t0 + F.greatest(F.lit(0.0), x)).otherwise(out)
    return out


#: Schedules by weight class: heavy sources early, light ones late, the middle even.
SCHEDULES = {5.0: [(0.0, 1.5), (1.0, 0.5)], 2.0: [(0.0, 1.0), (1.0, 1.0)], 1.0: [(0.0, 0.5), (1.0, 1.5)]}


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row a document: doc, size, source, source_size, weight, target, start, epochs.

    ``epochs`` lists the passes (0 to most-1) over the source's stream in which the mix
    takes the document.  A size is the number of words; null and empty texts have size 0
    and are never taken.  A null source is a source of its own.  Rows are entries of their
    own, also when they repeat an id or have a null id; ``row_col``, a key of the rows, is
    kept as ``row`` and tells them apart.  However many rows share an id or have none, they are
    spread over buckets by size.  An empty table gives an empty plan.  Nothing is
    drawn at random, so reruns agree.
    """
    key = [F.col(row_col).alias("row")] if row_col else []
    slim = docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *key,
    )
    key = ["row"] if row_col else []
    slim = slim.withColumn("h", F.md5(F.coalesce(F.col("doc").cast("string"), F.lit("")).cast("binary")))
    if not row_col:
        # rows of one id and size are alike: one row with their number, until their places are known
        slim = slim.groupBy("doc", "source", "size", "h").agg(F.count("*").alias("rows"))
    else:
        slim = slim.withColumn("rows", F.lit(1).cast("long"))
    slim = Scratch(docs.sparkSession, "mix").table(slim)  # ids and sizes; the texts are read once
    per = source_targets(slim.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most).withColumnRenamed("source", "p_source")
    if _few(per):
        per = F.broadcast(per)
    slim = slim.join(_hot_ids(slim), F.col("source").eqNullSafe(F.col("h_source")) & (F.substring("h", 1, BUCKET_HEX) == F.col("h_prefix")), "left")
    # a hot id's rows lie in buckets by size (and row), between those of the hashes before and behind it
    last_hot = F.array_max(F.filter("hot", lambda x: x <= F.col("h")))
    size = F.concat(F.col("h"), F.lit("-"), F.lpad(F.col("size").cast("string"), 20, "0"), F.substring(F.md5(F.col("row").cast("string").cast("binary")), 1, 2) if row_col else F.lit(""))
    prefix = F.substring("h", 1, BUCKET_HEX)
    slim = slim.withColumn("bucket", F.when(last_hot == F.col("h"), size).when(last_hot.isNotNull(), F.concat(last_hot, F.lit("~"))).otherwise(F.concat(prefix, F.lit(" ")))).drop("hot", "h_source", "h_prefix")
    # the stream offset of a document: the buckets before its own, then the documents before it in the bucket
    before = Window.partitionBy("b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("rows")
    buckets = slim.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket")).agg(F.sum(words).alias("n"))
    buckets = buckets.select("b_source", "b_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc", "size", *key).rowsBetween(Window.unboundedPreceding, -1)
    at = slim.withColumn("start", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    at = at.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    at = at.withColumn("start", F.col("start") + F.col("base"))
    if not row_col:
        at = at.withColumn("__nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("start", F.col("start") + F.col("__nth") * F.col("size"))
    at = at.join(per, F.col("source").eqNullSafe(F.col("p_source")))
    taken = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: (F.col("size") > 0) & (_middle(e) <= F.col("target")))
    return at.select("doc", "size", "source", "source_size", "weight", "target", "start", taken.alias("epochs"), *key)


def _hot_ids(slim: DataFrame) -> DataFrame:
    """(h_source, h_prefix, hot): the hashes of ids with HOT rows or more, in arrays by source and bucket prefix."""
    counts = slim.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT)
    return counts.groupBy(F.col("source").alias("h_source"), F.substring("h", 1, BUCKET_HEX).alias("h_prefix")).agg(F.collect_list("h").alias("hot"))


def _middle(epoch: Column) -> Column:
    """Where in its source's stream the middle of a document's copy lies."""
    return epoch * F.col("source_size") + F.col("start") + F.col("size") / 2


def positions(plan: DataFrame, schedules: dict | None = None) -> DataFrame:
    """The taken copies of a plan: doc, epoch, position (0 to 1), size, source_size, target, and row if the plan has it."""
    copies = plan.withColumn("epoch", F.explode("epochs"))
    return copies.select("doc", "epoch", _position(F.col("epoch"), schedules).alias("position"), "size", "source_size", "target", *[c for c in plan.columns if c == "row"])


def _position(epoch: Column, schedules: dict | None = None) -> Column:
    """The training time of a document's copy in a pass."""
    share, position = _middle(epoch) / F.col("target"), F.lit(None).cast("double")
    for w, knots in (schedules or SCHEDULES).items():
        position = F.when(F.col("weight") == w, _inverse_demand(share, knots)).otherwise(position)
    return F.coalesce(position, share)


def training_order(plan: DataFrame, schedules: dict | None = None) -> DataFrame:
    """A plan with ``positions``, those of all taken copies, range-sorted by them; untaken documents have none and come last."""
    at = plan.withColumn("positions", F.transform("epochs", lambda e: _position(e, schedules)))
    order = [F.size("positions") == 0, F.col("positions"), F.col("doc")]
    return at.repartitionByRange(*order).sortWithinPartitions(*order)


def _few(per: DataFrame, most: int = 10_000) -> bool:
    """Whether there are at most ``most`` sources, so that their table may be broadcast."""
    return per.limit(most + 1).count() <= most


def mix_documents(docs: DataFrame, schedules: dict | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """The training order: one row a taken copy, all input columns, range-sorted by position.

    Adds epoch, position, size, source_size, target and taken (the words of the copy);
    input columns of these names give way.  Documents that the mix does not take are
    absent.  Each row has a key of its own, written once to the shared folder, so rows
    that repeat an id or have a null id come once for each of their own taken copies.
    """
    new = ["epoch", "position", "size", "source_size", "target", "taken"]
    # written before it is used: the numbers may differ if the rows are read again
    keyed = Scratch(docs.sparkSession, "mix-rows").table(docs.withColumn("__row", F.monotonically_increasing_id()))
    taken = positions(plan_mix(keyed, id_col=id_col, row_col="__row", **how), schedules).withColumn("taken", F.col("size")).drop("doc")
    out = keyed.drop(*new).join(taken.withColumnRenamed("row", "__row"), "__row").drop("__row")
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the order of their first copies in training, with the positions of the first and the last copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return training_order(plan_mix(docs)).select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("epochs")).cast("long").alias("taken"),
        F.get("positions", F.lit(0)).alias("first_position"), F.try_element_at("positions", F.lit(-1)).alias("last_position"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER a, 0) AS rest, (sum(weight) OVER ()) - coalesce(sum(weight) OVER a, 0) AS left_w,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
  FROM w WINDOW a AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, weight, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * weight) END AS target
  FROM (SELECT *, arg_min(CASE WHEN rest / left_w * weight <= cap THEN rest / left_w END, CASE WHEN rest / left_w * weight <= cap THEN place END) OVER () AS lvl FROM r)
), o AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), c AS (
  SELECT doc_id, size, source_size, target, weight, start,
         (SELECT count(*) FROM range(3) e(i) WHERE o.size > 0 AND e.i * source_size + start + size / 2 <= target) AS copies
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source
), m AS (
  -- the share of its target that a source has taken at the middle of the first copy and of the last
  SELECT *, (start + size / 2) / target AS s0, ((copies - 1) * source_size + start + size / 2) / target AS s1 FROM c
)
-- inverse of the integrated schedules: 1.5 - t for the heavy sources, 1 for the middle ones, 0.5 + t for the light ones
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN CASE weight WHEN 5 THEN 1.5 - sqrt(greatest(0, 2.25 - 2 * s0)) WHEN 2 THEN s0 ELSE sqrt(0.25 + 2 * s0) - 0.5 END END::DOUBLE AS first_position,
       CASE WHEN copies > 0 THEN CASE weight WHEN 5 THEN 1.5 - sqrt(greatest(0, 2.25 - 2 * s1)) WHEN 2 THEN s1 ELSE sqrt(0.25 + 2 * s1) - 0.5 END END::DOUBLE AS last_position
FROM m
"""
