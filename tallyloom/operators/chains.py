"""Chains of events by pointer jumping: joins that double the length of every pointer, instead of a walk along a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

#: Ranges that the table's time is cut into, at most: each is one task's work for one key.
RANGES = 4096


def _ranged(times: DataFrame, lo: int, width: int) -> DataFrame:
    return times.withColumn("range", F.floor((F.col("t") - lo) / width))


def throttle_chain(events: DataFrame, min_gap_s: int, ranges: int = RANGES) -> DataFrame:
    """(key, ts, seq) of the events shown: a key's first one, then each that comes min_gap_s or more after the last shown.
    Of events of one key and time only the first (by seq) can be; without a gap, all are.

    Every time points to the first time of its key that is at least the gap later; both are found in ranges of time, with
    one row for each key and range handed on, so a single key is as many tasks' work as it has ranges. An event after a
    silence of the gap is shown whatever came before. From these, pointers are followed: what is shown so far takes one
    jump, then all pointers double, so the jumps needed are the logarithm of the longest chain.
    """
    rows = events.select("key", "ts", "seq").where("key is not null and ts is not null")
    if min_gap_s <= 0:
        return rows
    one = cut(rows.groupBy("key", F.col("ts").alias("t")).agg(F.min("seq").alias("seq")))
    lo, hi = one.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return rows
    width = max(min_gap_s, -(-(hi - lo + 1) // ranges))
    nodes = _ranged(one.select("key", "t"), lo, width)
    firsts = nodes.groupBy("key", "range").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    # a time's own events, and what asks for the first event from its time on
    asked = _ranged(nodes.select("key", (F.col("t") + min_gap_s).alias("t"), F.col("t").alias("of")), lo, width)
    both = nodes.select("key", "range", "t", F.lit(None).cast("long").alias("of"), F.col("t").alias("event")).unionByName(asked.withColumn("event", F.lit(None).cast("long")))
    within = Window.partitionBy("key", "range").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("to", F.min("event").over(within)).where("of is not null").select("key", "range", F.col("of").alias("t"), "to")
    down = Window.partitionBy("key").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    marks = firsts.select("key", "range", "first_t").unionByName(found.where("to is null").select("key", "range", F.lit(None).cast("long").alias("first_t")).distinct())
    later = marks.groupBy("key", "range").agg(F.min("first_t").alias("first_t")).withColumn("later", F.min("first_t").over(down)).select("key", "range", "later")
    pointers = found.where("to is not null").select("key", "t", "to").unionByName(found.where("to is null").join(later, ["key", "range"]).where("later is not null").select("key", "t", F.col("later").alias("to")))
    # heads: the first event, and those after a silence
    up = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = firsts.withColumn("earlier", F.max("last_t").over(up)).select("key", "range", "earlier")
    prior = F.lag("t").over(Window.partitionBy("key", "range").orderBy("t"))
    heads = nodes.withColumn("prior", prior).join(held, ["key", "range"]).withColumn("prior", F.coalesce("prior", "earlier")).where(F.col("prior").isNull() | (F.col("t") - F.col("prior") >= min_gap_s)).select("key", "t")
    shown = cut(heads)
    jumps = cut(pointers.join(shown.withColumnRenamed("t", "to"), ["key", "to"], "left_anti").select("key", "t", "to"))
    while not jumps.isEmpty():
        shown = cut(shown.unionByName(shown.join(jumps, ["key", "t"]).select("key", F.col("to").alias("t"))).distinct())
        on = jumps.select("key", F.col("t").alias("to"), F.col("to").alias("far"))
        jumps = cut(jumps.join(on, ["key", "to"]).select("key", "t", F.col("far").alias("to")))
    return one.join(shown, ["key", "t"], "left_semi").select("key", F.col("t").alias("ts"), "seq")
