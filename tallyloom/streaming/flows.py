"""Streams of events: each function takes a streaming or a static DataFrame and means the same for both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.advice import alert_name, blank_as_null
from ..sources.shared import cut


def throughput(events: DataFrame, window: str, slide: str | None = None, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Completions per window (tumbling, or sliding) and key; a stream drops rows later than the watermark."""
    return events.withWatermark("at", late).groupBy(F.window("at", window, slide), *by).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("begin_ts"), *by, "n")


def runner_sessions(heartbeats: DataFrame, gap: str = "120 seconds", late: str = "1 hour") -> DataFrame:
    """Spells in which a runner was alive: a heartbeat prolongs the spell by the gap, silence ends it."""
    spell = F.session_window("at", gap)
    return heartbeats.withWatermark("at", late).groupBy(spell, "runner_id").agg(F.count("*").alias("beats")).select("runner_id", F.unix_seconds("session_window.start").alias("begin_ts"), F.unix_seconds("session_window.end").alias("end_ts"), "beats")


def alert_sink(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to its own folder, overwritten if the batch is run again, so no alert is lost or doubled."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return alerts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ALERT = (
    "fingerprint string, code string, disk string, count long, first_at struct<ts:bigint,seq:bigint>, at struct<ts:bigint,seq:bigint>, severity string, detail string, action string, "
    "url string, url_at struct<ts:bigint,seq:bigint>, origins string, origins_at struct<ts:bigint,seq:bigint>, ended struct<ts:bigint,seq:bigint>, batch_id long, bucket int"
)
_NAMES = [c.split()[0] for c in _ALERT.replace("<ts:bigint,seq:bigint>", "").split(", ")]


def upsert_alerts(batch: DataFrame, batch_id: int, path: str, buckets: int = 16) -> None:
    """Folds a batch of firings and resolves (kind, and the columns of dedup_alerts) into the list of alerts at a path.

    The list is kept in buckets of fingerprints, and only those that the batch touches are written anew, each with the
    number of the batch. Where a run broke off and comes again, buckets that have the batch already are left alone, so
    nothing counts twice.
    """
    spark = batch.sparkSession
    at = F.struct(F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"))
    rows = batch.withColumn("fingerprint", F.when(F.col("kind") == "fire", alert_name()).otherwise(F.col("fingerprint"))).where("fingerprint is not null").withColumn("at", at)
    fired, told = F.col("kind") == "fire", lambda c: F.when(F.col("kind") == "fire", F.col(c))
    filled = lambda c: F.when(F.col("kind") == "fire", blank_as_null(c))
    new = rows.select(
        "fingerprint", told("code").alias("code"), told("disk").alias("disk"), F.when(fired, 1).otherwise(0).cast("long").alias("count"), told("at").alias("first_at"), told("at").alias("at"), *(told(c).alias(c) for c in ("severity", "detail", "action")),
        filled("url").alias("url"), F.when(filled("url").isNotNull(), F.col("at")).alias("url_at"), filled("origins").alias("origins"), F.when(filled("origins").isNotNull(), F.col("at")).alias("origins_at"),
        F.when(~fired, F.col("at")).alias("ended"), F.lit(batch_id).cast("long").alias("batch_id"), F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int").alias("bucket"))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # one number for each bucket at most
    if not touched:
        return
    try:
        old = spark.read.schema(_ALERT).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException:  # the first batch
        old = spark.createDataFrame([], _ALERT)
    done = [r[0] for r in old.where(F.col("batch_id") >= batch_id).select("bucket").distinct().collect()]
    both = old.select(*_NAMES).unionByName(new.select(*_NAMES)).where(~F.col("bucket").isin(done) if done else F.lit(True))
    merged = both.groupBy("bucket", "fingerprint").agg(
        F.min_by("code", "first_at").alias("code"), F.min_by("disk", "first_at").alias("disk"), F.sum("count").alias("count"), F.min("first_at").alias("first_at"), *(F.max_by(c, "at").alias(c) for c in ("severity", "detail", "action")), F.max("at").alias("at"),
        F.max_by("url", "url_at").alias("url"), F.max("url_at").alias("url_at"), F.max_by("origins", "origins_at").alias("origins"), F.max("origins_at").alias("origins_at"), F.max("ended").alias("ended")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    # what is read is also written: it is computed in full before
    cut(merged.select(*_NAMES)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def alert_list(alerts: DataFrame, path: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """dedup_alerts as a stream: each micro-batch is folded into the list at a path (see upsert_alerts, read_alert_list)."""
    return alerts.writeStream.foreachBatch(lambda batch, n: upsert_alerts(batch, n, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alert_list(spark: SparkSession, path: str, keep: int | None = None) -> DataFrame:
    """The list of alerts as dedup_alerts gives it; `keep`: those that fired last."""
    rows = spark.read.schema(_ALERT).parquet(path).where("count > 0").withColumns({"first_ts": F.col("first_at.ts"), "last_ts": F.col("at.ts"), "active": F.coalesce(F.col("at") > F.col("ended"), F.lit(True))})
    if keep is not None:
        rows = rows.orderBy(F.desc("at"), "fingerprint").limit(keep)
    return rows.select("fingerprint", "code", "disk", "count", "first_ts", "last_ts", "severity", "detail", "action", "url", "origins", "active")
