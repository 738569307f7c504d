"""Streaming forms of the incremental jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import best_of_classes
from ..operators.writes import merge_history, price_history_rollup
from ..partitions import dealt
from ..storage import Generations, Scratch

#: About so many alerts of a class are one part of the work, and so many of its members are one list.
PART = 1024


def daily_event_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and approximate sessions per day and type; events later than the watermark are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
            .agg(F.count("*").alias("events"), F.approx_count_distinct("session_id").alias("sessions"))
            .select(F.to_date("window.start").alias("day"), "event_type", "events", "sessions"))


class AlertSink:
    """Sent alerts (watch_id, offer_id) on disk, a folder a micro-batch: the memory that outlives a restart.

    Alerts of a class of watches are stored once, as rows (cls, offer_id), beside its members
    (cls, watch_id); single alerts are rows without a class.  Reading joins them: a class's alerts
    are dealt over the tasks in parts, and each part meets the members in lists, not row by row.
    """

    def __init__(self, spark: SparkSession, path: str, kinds: str = "watch_id long, offer_id string"):
        self.spark, self.path, self.kinds = spark, path.rstrip("/"), kinds
        self.batches = Generations(spark, self.path)

    def _rows(self, before: int | None, offers: DataFrame | None) -> tuple[DataFrame, DataFrame] | None:
        """(alerts, members) as they are stored, or None without complete batches."""
        there = [g for g in self.batches.complete() if before is None or g < before]
        if not there:
            return None
        rows = self.batches.read(there, f"{self.kinds}, cls long")
        told = rows.where("offer_id IS NOT NULL")
        if offers is not None:
            told = told.join(offers.select("offer_id"), "offer_id", "left_semi")
        return told, rows.where("cls IS NOT NULL AND offer_id IS NULL").select("gen", "cls", "watch_id")

    def knows(self, before: int, offers: DataFrame) -> bool:
        """Whether a complete batch before one has an alert of these offers (offer_id)."""
        rows = self._rows(before, offers)
        return rows is not None and bool(rows[0].take(1))

    def read(self, before: int | None = None, offers: DataFrame | None = None) -> DataFrame:
        """Alerts of the complete batches, or of those before one; of all offers or of these (offer_id)."""
        rows = self._rows(before, offers)
        if rows is None:
            return self.spark.createDataFrame([], self.kinds)
        told, members = rows
        expanded = self._expanded(told.where("cls IS NOT NULL").select("gen", "cls", "offer_id"), members)
        return told.where("cls IS NULL").select("watch_id", "offer_id").unionByName(expanded)

    @staticmethod
    def _expanded(found: DataFrame, members: DataFrame) -> DataFrame:
        """(watch_id, offer_id): the alerts (gen, cls, offer_id) of classes for each of their members (gen, cls, watch_id)."""
        cls, keys = ["gen", "cls"], ["gen", "cls", "part"]

        def sizes(df: DataFrame) -> DataFrame:
            return df.groupBy(*cls).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))

        def in_parts(df: DataFrame, key: str) -> DataFrame:
            return df.join(sizes(df), cls).withColumn("part", F.pmod(F.xxhash64(key), "parts").cast("int")).drop("parts")

        # of structs, since a list leaves nulls out
        lists = in_parts(members, "watch_id").groupBy(*keys).agg(F.collect_list(F.struct("watch_id")).alias("w")).select(*cls, F.col("w.watch_id").alias("watches"))
        lists = lists.join(sizes(found), cls).select(*cls, "watches", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        pairs = dealt(in_parts(found, "offer_id"), *keys).join(dealt(lists, *keys).hint("merge"), keys)
        return pairs.select(F.explode("watches").alias("watch_id"), "offer_id")

    @staticmethod
    def of_classes(found: DataFrame, members: DataFrame) -> DataFrame:
        """Rows to write: alerts (id, offer_id) of classes with their members (watch_id, id)."""
        whose = members.join(found.select("id").distinct(), "id", "left_semi").select("watch_id", F.col("id").alias("cls"))
        return found.select(F.col("id").alias("cls"), "offer_id").distinct().unionByName(whose, allowMissingColumns=True)

    def write(self, found: DataFrame, batch_id: int) -> None:
        """Alerts (watch_id, offer_id), or rows of ``of_classes``."""
        found.write.mode("overwrite").parquet(f"{self.path}/gen={batch_id}")


def stream_alerts(offers: DataFrame, watches: DataFrame, tags: DataFrame, sink: AlertSink, checkpoint: str, k: int = 10, sent: DataFrame | None = None, sent_to_users: DataFrame | None = None) -> StreamingQuery:
    """New offers against watches, each batch without what earlier batches sent, or ``sent``
    (watch_id, offer_id) or ``sent_to_users`` (user_id, offer_id) holds.

    A batch that runs again after a restart sees the batches before it only and overwrites
    itself, so no pair is sent twice and none is lost.  An offer that comes again while the
    stream's watermark (column ``ts``, if it has one) remembers it is dropped before it is
    matched; the sink remembers for ever.  A batch's offers are written once, so its source is
    read once and its matching runs in the session of ``watches``.
    """
    if "ts" in offers.columns:
        offers = offers.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id"])

    def batch(df: DataFrame, batch_id: int) -> None:
        new = Scratch(watches.sparkSession, "batch").table(df.dropDuplicates(["id"]))
        ids = new.select(F.col("id").alias("offer_id"))
        told = None if sent is None else sent.select("watch_id", "offer_id")
        if sink.knows(batch_id, ids):
            before = sink.read(batch_id, ids)
            told = before if told is None else before.unionByName(told)
        found, members = best_of_classes(watches, new, tags, k, told, sent_to_users=sent_to_users)
        sink.write(sink.of_classes(found, members), batch_id)

    return offers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_history(offers: DataFrame, read_history: Callable[[], DataFrame | None], write_history: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Roll each batch of offers up and merge it into the history."""
    def batch(df: DataFrame, batch_id: int) -> None:
        new, old = price_history_rollup(df), read_history()
        write_history(new if old is None else merge_history(old, new), batch_id)

    return offers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
