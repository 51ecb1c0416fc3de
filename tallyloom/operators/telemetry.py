"""Rates, detection and summaries over samples in time; times are epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import classify_result, error_signature, hash_shard, shard_of
from .spans import Spans


def rate_series(samples: DataFrame, value: str, by: Sequence[str], ts: str = "ts", rows: int | None = None) -> DataFrame:
    """Change per second since the key's last sample; 0 where time stands still or the value falls, null at the first.

    A key of more than `rows` samples is split into spans of time (see spans).
    """
    s = Spans(samples, by, [ts], rows).lag(_ts=F.col(ts), _value=F.col(value)).rows()
    dt, dv = F.col(ts) - F.col("_ts"), F.col(value) - F.col("_value")
    return s.withColumn("rate", F.when(dt.isNotNull(), F.when(dt > 0, F.greatest(dv / dt, F.lit(0.0))).otherwise(0.0))).drop("_ts", "_value")


def rolling_io(samples: DataFrame, most: int = 60, rows: int | None = None) -> DataFrame:
    """Read and write MB/s and utilisation of each disk over its last `most` samples, sectors being 512 bytes.

    A disk of more than `rows` samples is split into spans of time, each with the last samples of those before it.
    """
    names = ("ts", "read_sectors", "write_sectors", "io_ms")
    s = Spans(samples.select("disk", "seq", *names), ["disk"], ["ts", "seq"], rows).trailing_first(most, **{f"_{c}": F.col(c) for c in names}).rows()
    dt = F.col("ts") - F.col("_ts")
    per = lambda c, f: F.when(dt > 0, (F.col(c) - F.col(f"_{c}")) * f / dt).otherwise(0.0)
    return s.select("disk", "ts", "seq", per("read_sectors", 512 / 1e6).alias("read_mbps"), per("write_sectors", 512 / 1e6).alias("write_mbps"), F.least(per("io_ms", 0.1), F.lit(100.0)).alias("util_pct"))


def contribution_stack(samples: DataFrame) -> DataFrame:
    """Running share of each runner at each time, in percent of the job at its end, the smallest contributor first."""
    last = samples.groupBy("runner").agg(F.max("done").alias("last"))
    total = last.agg(F.sum("last").alias("all_done"))
    w = Window.partitionBy("ts").orderBy("last", "runner").rowsBetween(Window.unboundedPreceding, 0)
    stacked = samples.join(last, "runner").join(F.broadcast(total))  # one row
    return stacked.select("runner", "ts", (100.0 * F.sum("done").over(w) / F.col("all_done")).alias("upto_pct"))


def plateau(samples: DataFrame, now: int, by: str, recent_s: int, base_from_s: int, base_to_s: int, least: float = 0.25) -> DataFrame:
    """Per key the slope lately and in an earlier range, and whether it has fallen under a share of that."""
    age = F.lit(now) - F.col("ts")
    slope = lambda cond: (F.max(F.when(cond, F.col("done"))) - F.min(F.when(cond, F.col("done")))) / F.nullif(F.max(F.when(cond, F.col("ts"))) - F.min(F.when(cond, F.col("ts"))), F.lit(0))
    out = samples.groupBy(by).agg(slope(age <= recent_s).alias("recent"), slope((age >= base_from_s) & (age <= base_to_s)).alias("base"))
    return out.withColumn("plateau", F.coalesce((F.col("base") > 0) & (F.coalesce("recent", F.lit(0.0)) < least * F.col("base")), F.lit(False)))


def plateau_report(samples: DataFrame, now: int, total: int, recent_s: int = 30, base_from_s: int = 60, base_to_s: int = 240, least: float = 0.25, least_share: float = 0.1, history_s: int = 120) -> DataFrame:
    """Who stopped contributing: a row for the whole (a null runner) and for each runner, with its rate lately and before,
    its share of the earlier rate, and whether it fell under `least` of that.

    A runner is only named if it made least_share of the earlier rate. Nothing is reported before history_s seconds of
    samples or when all `total` items are done. The whole's `done` at a time is the sum over the runners' samples then.
    """
    age = F.lit(now) - F.col("ts")
    whole = samples.groupBy("ts").agg(F.sum("done").alias("done")).select(F.lit(None).cast("string").alias("runner"), "ts", "done")

    def rate(within: Column) -> Column:
        ends = [f(F.when(within, F.col("ts"))) for f in (F.min, F.max)]
        steps = [f(F.when(within, F.struct("ts", "done")))["done"] for f in (F.min, F.max)]
        return F.coalesce(F.greatest(F.lit(0.0), (steps[1] - steps[0]) / F.nullif(ends[1] - ends[0], F.lit(0))), F.lit(0.0))

    by = whole.unionByName(samples.select("runner", "ts", "done")).where(age >= 0).groupBy("runner").agg(
        rate(age <= recent_s).alias("recent"), rate((age >= base_from_s) & (age <= base_to_s)).alias("base"), F.min("ts").alias("begin"), F.max("done").alias("done"))
    all_ = by.where("runner is null").select(F.col("base").alias("all_base"), F.col("begin").alias("all_begin"), F.col("done").alias("all_done"))
    out = by.join(F.broadcast(all_)).where((F.lit(now) - F.col("all_begin") >= history_s) & (F.col("all_done") < total))  # one row
    share = F.when(F.col("all_base") > 0, F.col("base") / F.col("all_base")).otherwise(F.when(F.col("base") > 0, 1.0).otherwise(0.0))
    fell = (F.col("base") > 0) & (F.col("recent") < least * F.col("base")) & (F.col("runner").isNull() | (share >= least_share))
    return out.select("runner", "recent", "base", share.alias("share"), fell.alias("plateau"))


def item_trace(events: DataFrame, n: int = 20) -> DataFrame:
    """The last n events of each item, numbered from the newest."""
    w = Window.partitionBy("item_id").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def item_timeline(events: DataFrame, ledger: DataFrame, n: int = 20) -> DataFrame:
    """Per item that has events the last n of them, oldest first (an array), beside its row of the ledger, whose columns are
    null where the ledger has lost the item. The ledger has one row for each item."""
    fields = [c for c in events.columns if c not in ("item_id", "ts", "seq")]
    kept = item_trace(events, n).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", *fields))).alias("events"))
    return kept.join(ledger, "item_id", "left")


def resample_linear(series: DataFrame, step: int) -> DataFrame:
    """Each key's values on a grid of `step` seconds from its first time, between the two samples around each point.

    A sample owns the grid points from itself up to the next one, so no join is needed.
    """
    w = Window.partitionBy("key").orderBy("ts")
    start = F.min("ts").over(Window.partitionBy("key"))
    t1, v1 = F.lead("ts").over(w), F.lead("value").over(w)
    s = series.withColumn("start", start).withColumn("t1", t1).withColumn("v1", v1)
    first = F.ceil((F.col("ts") - F.col("start")) / step)
    last = F.when(F.col("t1").isNull(), F.floor((F.col("ts") - F.col("start")) / step)).otherwise(F.ceil((F.col("t1") - F.col("start")) / step) - 1)
    grid = s.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<bigint>)"))))
    t = F.col("start") + F.col("k") * step
    part = F.when(F.col("t1").isNull() | (F.col("t1") <= F.col("ts")), 0.0).otherwise((t - F.col("ts")) / (F.col("t1") - F.col("ts")))
    return grid.select("key", t.alias("ts"), (F.col("value") + part * (F.coalesce("v1", "value") - F.col("value"))).alias("value"))


def sustained(df: DataFrame, key: str, cond: Column, sustain_s: int, rows: int | None = None) -> DataFrame:
    """Episodes in which the condition held without a break for long enough: start, first firing, end and rows.

    A key of more than `rows` rows is split into spans of time; an episode may run through many of them.
    """
    s = Spans(df.withColumn("_on", F.coalesce(cond, F.lit(False))), [key], ["ts"], rows).lag(_was=F.col("_on"))
    starts = F.when(F.col("_on") & ~F.coalesce("_was", F.lit(False)), F.col("ts"))
    spells = s.running(spell=("sum", F.when(F.col("_on"), 0).otherwise(1)), begin=("last", starts)).rows().where("_on")
    fires = F.col("ts") - F.col("begin") >= sustain_s
    return spells.groupBy(key, "spell").agg(F.min("begin").alias("begin_ts"), F.min(F.when(fires, F.col("ts"))).alias("fire_ts"), F.max("ts").alias("end_ts"), F.count_if(fires).alias("firings")).where("firings > 0").drop("spell")


def collapse(samples: DataFrame, ratio: float = 0.4, least_base: float = 0.1, history: int = 900) -> DataFrame:
    """Samples whose last three rates average less than a share of the earlier ones, with work left and six samples seen.

    Work left is what is pending or, where samples have the column, leased. Earlier rates are those of the last `history`
    samples, and must average more than least_base items a second.
    """
    open_ = F.col("pending") + F.coalesce("leased", F.lit(0)) if "leased" in samples.columns else F.col("pending")
    w = Window.partitionBy("job").orderBy("ts")
    rated = rate_series(samples, "done", ["job"]).withColumn("n", F.row_number().over(w))
    late, base = F.avg("rate").over(w.rowsBetween(-2, 0)), F.avg("rate").over(w.rowsBetween(1 - history, -3))
    out = rated.withColumn("late", late).withColumn("base", base)
    return out.withColumn("collapsed", F.coalesce((F.col("n") >= 6) & (open_ > 0) & (F.col("base") > least_base) & (F.col("late") < ratio * F.col("base")), F.lit(False)))


def failure_spike(samples: DataFrame, burst: int = 20, share: float = 0.3, least: int = 3, rows: int | None = None) -> DataFrame:
    """Samples at which failures jumped by a burst, or made up a share of what ended since the last sample. A job of more than
    `rows` samples is split into spans of time."""
    s = Spans(samples, ["job"], ["ts"], rows).lag(**{f"_{c}": F.col(c) for c in ("failed", "done", "ts")}).rows()
    d = s.withColumns({f"d_{c}": F.col(c) - F.col(f"_{c}") for c in ("failed", "done", "ts")}).drop("_failed", "_done", "_ts")
    f, all_ = F.col("d_failed"), F.col("d_failed") + F.col("d_done")
    return d.where((F.col("d_ts") >= 1) & ((f >= burst) | ((f >= least) & (f >= share * all_))))


def true_rate(df: DataFrame, ts: str, by: Sequence[str]) -> DataFrame:
    span = F.max(ts) - F.min(ts)
    return df.groupBy(*by).agg(F.count("*").alias("n"), span.alias("span_s"), F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("rate"))


# The share of the best throughput that each bias asks for, that of any other, and what is suggested without samples.
BIAS = {"conservative": 0.85, "balanced": 0.90, "aggressive": 1.0}
OTHER_BIAS, NO_SAMPLES = 0.95, 4


def suggest_concurrency(samples: DataFrame, bias: str | float = "balanced", disks: DataFrame | None = None) -> DataFrame:
    """Per disk the lowest concurrency that reaches a share of the best throughput, and where that is.

    bias: a name, or the share itself. With a table of disks, those without samples get a default and no peak.
    """
    share = bias if isinstance(bias, float) else BIAS.get(bias, OTHER_BIAS)
    best = F.max("mbps").over(Window.partitionBy("disk"))
    ok = samples.withColumn("best", best)
    out = ok.groupBy("disk").agg(F.min(F.when(F.col("mbps") >= share * F.col("best"), F.col("concurrency"))).alias("suggested"), F.max("mbps").alias("peak"), F.max_by("concurrency", F.struct("mbps", -F.col("concurrency"))).alias("peak_concurrency"))
    if disks is None:
        return out
    return disks.select("disk").distinct().join(out, "disk", "left").withColumn("suggested", F.coalesce("suggested", F.lit(NO_SAMPLES)))


def profile_fold(samples: DataFrame) -> DataFrame:
    """Per item the mean and peak of its CPU, its peak memory, what it read and wrote (the last less the first of
    cumulative counters), in MB, its samples and the seconds between the first and the last."""
    at = F.struct("ts", "seq")
    moved = lambda c: (F.max_by(c, at) - F.min_by(c, at)) / 1e6
    return samples.groupBy("item_id").agg(
        F.round(F.avg("cpu_pct"), 1).alias("cpu_pct_mean"), F.round(F.max("cpu_pct"), 1).alias("cpu_pct_peak"), F.round(F.max("rss_bytes") / 1e6, 1).alias("rss_peak_mb"),
        F.round(moved("read_bytes"), 1).alias("read_mb"), F.round(moved("write_bytes"), 1).alias("write_mb"), (F.max("ts") - F.min("ts")).alias("wall_s"), F.count("*").alias("samples"))


def scheduling_summary(decisions: DataFrame, now: int, window_s: int) -> DataFrame:
    """Per host what it asked for and got, how often for which reason (a map) and mainly for which, and whether it starves."""
    rows = decisions.where((F.col("ts") > now - window_s) & (F.col("ts") <= now))
    by = rows.groupBy("host", "reason").agg(F.count("*").alias("n"), F.sum("requested").alias("requested"), F.sum("granted").alias("granted"))
    out = by.groupBy("host").agg(F.sum("n").alias("decisions"), F.sum("requested").alias("requested"), F.sum("granted").alias("granted"), F.max_by("reason", F.struct("n", "reason")).alias("main_reason"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("reason", F.lit("?")), "n")))).alias("reasons"))  # an entry for each reason
    ratio = F.when(F.col("requested") > 0, F.col("granted") / F.col("requested")).otherwise(1.0)
    return out.withColumn("grant_ratio", ratio).withColumn("starved", (F.col("requested") > 0) & (ratio < 0.05) & (F.col("decisions") >= 2))


def failure_breakdown(results: DataFrame) -> DataFrame:
    """Failures by class and signature, and each one's share of its runner's failures."""
    rows = results.withColumn("class", classify_result(F.col("status"), F.col("error"))).where("class <> 'ok'").withColumn("signature", error_signature(F.col("error")))
    n = rows.groupBy("runner_id", "class", "signature").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("runner_id")))


def assess_layout(manifest: DataFrame, depth: int = 1) -> DataFrame:
    return manifest.groupBy(shard_of(F.col("rel_path"), depth).alias("shard")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def layout_by_disk(manifest: DataFrame, depth: int = 1) -> DataFrame:
    """Per disk its files, bytes and shards, and its share of all bytes; a null disk is what no rule has placed, with the names
    of its shards (the first 50)."""
    shard = shard_of(F.col("rel_path"), depth)
    per = manifest.groupBy("disk", shard.alias("shard")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    by = per.withColumn("place", F.when(F.col("disk").isNull(), F.row_number().over(Window.partitionBy("disk").orderBy("shard")))).groupBy("disk").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.sort_array(F.collect_list(F.when(F.col("place") <= 50, F.col("shard")))).alias("unmatched"))
    total = by.agg(F.sum("bytes").alias("all_bytes"))
    return by.join(F.broadcast(total)).select("disk", "files", "bytes", "shards", (F.col("bytes") / F.nullif("all_bytes", F.lit(0))).alias("share"), F.array_join("unmatched", ",").alias("unmatched"))  # one row


def layout_skew(shards: DataFrame) -> DataFrame:
    """Largest over smallest shard in bytes, and the verdict."""
    one = shards.agg(F.count("*").alias("shards"), F.max("bytes").alias("most"), F.min("bytes").alias("least"))
    skew = F.when(F.col("least") > 0, F.col("most") / F.col("least"))
    verdict = F.when(F.col("shards") == 0, "empty").when(skew <= 1.25, "well-balanced").when(skew <= 2, "slightly-skewed").otherwise("skewed")
    return one.select("shards", skew.alias("skew"), verdict.alias("verdict"))


def log_tail(lines: DataFrame, n: int = 500, most_bytes: int = 200_000) -> DataFrame:
    """Each item's last n lines, as far as they fit into the last `most_bytes` bytes."""
    w = Window.partitionBy("item_id").orderBy(F.desc("line_no"))
    size = F.sum(F.octet_length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("place", F.row_number().over(w)).withColumn("bytes", size).where((F.col("place") <= n) & (F.col("bytes") <= most_bytes)).select("item_id", "line_no", "place", "bytes")


def parse_diskstats(lines: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Device, disk, sectors read and written and busy milliseconds of kernel counter lines with at least 14 fields.

    devices(device, disk) names disks; a device without a row is a disk of its own name.
    """
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 14)
    counters = [F.col("f")[i].cast("long").alias(c) for i, c in ((5, "read_sectors"), (9, "write_sectors"), (12, "io_ms"))]
    rows = f.select(F.col("f")[2].alias("device"), *counters)
    named = rows.withColumn("disk", F.lit(None).cast("string")) if devices is None else rows.join(devices.select("device", "disk"), "device", "left")
    return named.select("device", F.coalesce("disk", "device").alias("disk"), "read_sectors", "write_sectors", "io_ms")


def move_plan(plan: DataFrame, rebalance: bool = True) -> DataFrame:
    """Where each file of a shard plan goes: shard_NN/ before its path, the folder of an older shard taken off; or skip.

    With `rebalance` a file is skipped if it is in its shard already; without, for a first move, if it is in any.
    """
    there = F.rlike("rel_path", F.lit("^shard_[^/]*/"))
    target = F.concat(F.format_string("shard_%02d/", F.col("shard")), F.regexp_replace("rel_path", "^shard_[^/]*/", ""))
    stays = F.col("rel_path") == target if rebalance else there
    return plan.select("rel_path", target.alias("target"), F.when(stays, "skip").otherwise("move").alias("action"))


def shard_topology(plan: DataFrame, kind: str = "hdd", read: str | None = None, write: str | None = None) -> DataFrame:
    """The topology rows of a shard plan: disk N takes what holds shard_NN. read and write are templates of its roots, in
    which {n}, {disk} and {shard} stand for those. One row for each shard that holds a file."""
    rows = plan.select("shard").distinct().select(F.col("shard").cast("long").alias("place"), F.concat(F.lit("disk"), "shard").alias("disk"), F.format_string("shard_%02d", F.col("shard")).alias("match"))

    def filled(template: str | None) -> Column:
        out = F.lit(template).cast("string")
        for name, value in (("{n}", F.col("place").cast("string")), ("{disk}", F.col("disk")), ("{shard}", F.col("match"))):
            out = F.replace(out, F.lit(name), value)
        return out

    return rows.select("place", "disk", F.lit(kind).alias("kind"), "match", filled(read).alias("read"), filled(write).alias("write"))


def demote_items(files: DataFrame, read_root: str, to: str, n: int = 7, union: str = "/mnt/user") -> DataFrame:
    """One copy item for each file (rel_path): its disk by a stable hash of its path, and its roots.

    `to` is a template with {n}, or has one folder with a star, as /mnt/user/Word*/rest, of which there is one on each
    disk: under the union of all disks it stands for /mnt/disk{n}/Word{n}/rest. direct_disk_write says that the union is
    passed over on purpose.
    """
    if "{n}" not in to:
        head, star, rest = to.replace("\\", "/").rstrip("/").partition("*")
        before, _, word = head.rpartition("/")
        if not star or not word or (rest and not rest.startswith("/")):
            raise ValueError(f"{to!r} has neither {{n}} nor a folder that ends with a star")
        root = "/mnt/disk{n}" if before == union.rstrip("/") else before
        to = f"{root}/{word}{{n}}{rest}" if root else f"{word}{{n}}{rest}"
    k = hash_shard(F.col("rel_path"), n).cast("string")
    return files.select(
        F.col("rel_path").alias("subjob_id"), F.concat(F.lit("disk"), k).alias("disk"), F.col("rel_path").alias("src_path"), F.col("rel_path").alias("dst_path"),
        F.lit(read_root.rstrip("/\\")).alias("read_root"), F.replace(F.lit(to), F.lit("{n}"), k).alias("write_root"), F.lit(True).alias("direct_disk_write"))
