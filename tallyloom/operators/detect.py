"""Verdicts and alarms over resource samples and results; times are epoch seconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import classify_result, error_signature
from .spans import Spans
from .telemetry import sustained

DISKS = "array<struct<disk:string,util_pct:double,mbps:double,ceiling_mbps:double,inflight:bigint>>"


def _share(used: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(used) / F.col(total)).otherwise(0.0)


def _most(array: Column) -> Column:
    return F.coalesce(F.array_max(array), F.lit(0.0))


# The limits that a sample's readings are held against.
CEILINGS = {"cpu": 0.9, "mem": 0.9, "disk_util_pct": 95.0, "disk": 0.9, "net": 0.9, "gpu": 0.95, "vram": 0.9, "latency": 0.5}


def bottleneck(samples: DataFrame, report: bool = False, **ceilings: float) -> DataFrame:
    """The sample's verdict, the resource it names and the largest pressure of any resource.

    With `report` also the pressure of each resource (a map; disks as disk:<id>, at most 1), what to do and what was seen.
    `ceilings` replaces some of CEILINGS. Disks are an array of (disk, util_pct, mbps, ceiling_mbps, inflight), as long as a host has disks. The first verdict
    in the order below that fits wins; an empty or null array is a host without disks.
    """
    top = CEILINGS | ceilings
    gpu = F.col("vram_total_gb") > 0
    flat = {
        "vram": F.when(gpu, F.col("vram_used_gb") / F.col("vram_total_gb")).otherwise(0.0), "gpu": F.when(gpu, F.least(F.col("gpu_util_pct") / 100, F.lit(1.0))).otherwise(0.0),
        "mem": _share("mem_used_gb", "mem_total_gb"), "net": _share("net_mbps", "net_cap_mbps"), "cpu": F.least(F.col("cpu_pct") / 100, F.lit(1.0)),
    }

    def load(d: Column) -> Column:
        return F.greatest(F.when(d.ceiling_mbps > 0, d.mbps / d.ceiling_mbps).otherwise(d.util_pct / 100), d.util_pct / 100)

    def hot(d: Column) -> Column:
        return (load(d) >= top["disk"]) | (d.util_pct >= top["disk_util_pct"])

    def busy(d: Column) -> Column:
        return ~hot(d) & ((d.util_pct >= 50) | (d.inflight > 0))

    def idle(d: Column) -> Column:
        return ~hot(d) & (d.inflight == 0) & (d.util_pct < 20)

    s = samples.withColumn("disks", F.coalesce("disks", F.expr(f"cast(array() as {DISKS})")))
    s = s.select("*", *(p.alias(f"_{n}") for n, p in flat.items()), F.filter("disks", hot).alias("_hot"), F.filter("disks", busy).alias("_busy"), F.size(F.filter("disks", idle)).alias("_idle"))
    most = F.greatest(*(F.col(f"_{n}") for n in flat), F.least(_most(F.transform("disks", load)), F.lit(1.0)))
    late = (F.col("expected") > 0) & (F.col("observed") < top["latency"] * F.col("expected")) & (most < top["disk"])
    ranked = [
        ("vram_pressure", F.lit("vram"), F.col("_vram") >= top["vram"]), ("gpu_bound", F.lit("gpu"), F.col("_gpu") >= top["gpu"]), ("mem_pressure", F.lit("mem"), F.col("_mem") >= top["mem"]),
        ("disk_at_ceiling", F.concat(F.lit("disk:"), F.get("_hot", F.lit(0)).disk), F.size("_hot") > 0),
        ("nas_single_spindle", F.concat(F.lit("disk:"), F.get("_busy", F.lit(0)).disk), (F.size("_busy") == 1) & (F.col("_idle") >= 2)),
        ("net_bound", F.lit("net"), F.col("_net") >= top["net"]), ("cpu_bound", F.lit("cpu"), F.col("_cpu") >= top["cpu"]), ("latency_bound", F.lit("latency"), late), ("healthy", F.lit("none"), F.lit(True)),
    ]
    first = lambda part: F.coalesce(*(F.when(cond, part(name, resource)) for name, resource, cond in ranked))
    out = [first(lambda n, r: F.lit(n)).alias("verdict"), first(lambda n, r: r).alias("resource"), most.alias("max_pressure")]
    if not report:
        return s.select("ts", *out)
    disks = F.transform("disks", lambda d: F.struct(F.concat(F.lit("disk:"), d.disk).alias("key"), F.least(load(d), F.lit(1.0)).alias("value")))
    flats = F.array(*(F.struct(F.lit(n).alias("key"), F.col(f"_{n}").cast("double").alias("value")) for n in flat))
    whole = lambda c, unit="": F.concat(F.round(c, 0).cast("long").cast("string"), F.lit(unit))
    share = lambda used, total, unit: F.concat(F.round(used, 1).cast("string"), F.lit(" of "), F.round(total, 1).cast("string"), F.lit(unit))
    hot_disk, warm = F.get("_hot", F.lit(0)), F.get("_busy", F.lit(0))
    seen = {
        "vram_pressure": share(F.col("vram_used_gb"), F.col("vram_total_gb"), " GB of video memory"), "gpu_bound": whole(F.col("gpu_util_pct"), " % of the GPU"), "mem_pressure": share(F.col("mem_used_gb"), F.col("mem_total_gb"), " GB of memory"),
        "disk_at_ceiling": F.concat(hot_disk.disk, F.lit(": "), F.when(hot_disk.ceiling_mbps > 0, share(hot_disk.mbps, hot_disk.ceiling_mbps, " MB/s")).otherwise(whole(hot_disk.util_pct, " % busy"))),
        "nas_single_spindle": F.concat(warm.disk, F.lit(": "), warm.inflight.cast("string"), F.lit(" in flight; idle: "), F.array_join(F.transform(F.filter("disks", idle), lambda d: d.disk), ", ")),
        "net_bound": share(F.col("net_mbps"), F.col("net_cap_mbps"), " MB/s of the link"), "cpu_bound": whole(F.col("cpu_pct"), " % of the CPU"),
        "latency_bound": F.concat(share(F.col("observed"), F.col("expected"), " items a second"), F.lit("; nothing above "), whole(100 * most, " %")), "healthy": F.lit("room everywhere"),
    }
    detail = F.coalesce(*(F.when(F.col("verdict") == v, text) for v, text in seen.items()))
    hint = F.coalesce(*(F.when(F.col("verdict") == v, text) for v, text in HINTS.items()))
    told = s.select("*", *out, F.map_from_entries(F.concat(flats, disks)).alias("pressures"))
    return told.select("ts", "verdict", "resource", "max_pressure", "pressures", hint.alias("hint"), detail.alias("detail"))


#: What to do about each verdict.
HINTS = {
    "vram_pressure": "take smaller batches, or move part of the work to the CPU", "gpu_bound": "add GPUs, or give each item less GPU work", "mem_pressure": "run fewer workers, or make each need less memory",
    "disk_at_ceiling": "the disk gives all it can: stage its hot data elsewhere, or spread the reads", "nas_single_spindle": "all reads go to one disk while others idle: look at the placement rules and the shard plan",
    "net_bound": "the link is full: stage data near the workers", "cpu_bound": "add workers or hosts, or make the task cheaper", "latency_bound": "slow, but nothing is full: batch small operations, read ahead, or stage to a faster tier", "healthy": "",
}


def thrash(inflight: DataFrame, budgets: DataFrame, factor: float = 1.2) -> DataFrame:
    """Disks with more in flight than the whole part of factor times their budget; budgets of 0 or less are none."""
    return inflight.join(budgets.where("budget > 0"), "disk").where(F.col("inflight") > F.floor(F.col("budget") * factor)).select("disk", "inflight", "budget", F.lit("warn").alias("severity"))


def saturation(io: DataFrame, parity: DataFrame, pct: float = 95) -> DataFrame:
    """Samples of disks that are busy at least pct of the time: critical on parity disks, else warn."""
    kind = parity.where("parity_protected").select("disk", F.lit(True).alias("guarded")).distinct()
    return io.where(F.col("util_pct") >= pct).join(kind, "disk", "left").select("disk", "ts", "util_pct", F.when(F.col("guarded"), "critical").otherwise("warn").alias("severity"))


def write_pressure(samples: DataFrame) -> DataFrame:
    """Samples of parity disks whose budget is used up while work waits."""
    return samples.where("parity_protected and budget > 0 and inflight >= budget and pending > 0").withColumn("severity", F.lit("info"))


def idle_windows(io: DataFrame, gates: DataFrame, most_pct: float = 15, sustain_s: int = 1800, rows: int | None = None) -> DataFrame:
    """Per gate the spells in which its busiest disk stayed at or under a utilisation for long enough; a breach starts anew.

    Times without samples leave the spell as it is. Gates are rows of (gate, disk).
    """
    load = io.join(gates.select("gate", "disk").distinct(), "disk").groupBy("gate", "ts").agg(F.max("util_pct").alias("util_pct"))
    return sustained(load, "gate", F.col("util_pct") <= most_pct, sustain_s, rows)


def idle_gate(io: DataFrame, gates: DataFrame, most_pct: float = 15, sustain_s: float | None = None, sustain_min: float | None = None, rows: int | None = None) -> DataFrame:
    """Per gate and time: is it open, why, the busiest disk's utilisation, and for how long the gate's disks were quiet.

    io: disk, ts, util_pct and samples; a disk with fewer than two samples says nothing. Quiet is at or under most_pct.
    Without any telemetry a gate is open (NO_TELEMETRY), and its quiet time neither ends nor begins; a breach ends it.
    Gates are rows of (gate, disk); the time may be given in minutes, and is 1,800 seconds by default.
    """
    sustain = sustain_s if sustain_s is not None else sustain_min * 60 if sustain_min is not None else 1800
    util = F.max(F.when(F.col("samples") >= 2, F.col("util_pct"))).alias("cur_util")
    load = io.join(gates.select("gate", "disk").distinct(), "disk").groupBy("gate", "ts").agg(util)
    quiet = F.col("cur_util") <= most_pct
    # quiet time begins at the first quiet sample after a breach, or at the first of all
    s = Spans(load, ["gate"], ["ts"], rows).running(before=True, _was=("last", quiet))
    s = s.running(_since=("last", F.when(quiet & ~F.coalesce("_was", F.lit(False)), F.col("ts"))))
    rows_ = s.rows().withColumn("quiet_for_s", F.when(quiet, F.col("ts") - F.col("_since")).otherwise(0))
    reason = F.when(F.col("cur_util").isNull(), "NO_TELEMETRY").when((F.col("cur_util") <= most_pct) & (F.col("quiet_for_s") >= sustain), "OPEN").otherwise("WAIT")
    return rows_.select("gate", "ts", (reason != "WAIT").alias("admit"), reason.alias("reason"), "cur_util", "quiet_for_s")


def failure_storms(results: DataFrame, by: str = "runner_id", run: int = 3, window: int = 20, least: int = 5) -> DataFrame:
    """The first result of each key at which failures make a storm: `run` permanent ones in a row, or, among the last
    `window` results (`least` at the least), half failed and one signature has four fifths of those.

    Each row looks back over at most `window` rows, so state stays small whatever a key's length.
    """
    w = Window.partitionBy(by).orderBy("ts", "seq")
    kind = classify_result(F.col("status"), F.col("error"))
    rows = results.select(by, "ts", "seq", kind.alias("class"), error_signature(F.col("error")).alias("sig"))
    back = w.rowsBetween(1 - window, 0)
    seen = rows.select(by, "ts", "seq", "sig", F.collect_list("class").over(w.rowsBetween(1 - run, 0)).alias("late"), F.count("*").over(back).alias("seen"), F.collect_list(F.when(F.col("class") != "ok", F.col("sig"))).over(back).alias("sigs"))
    hard = (F.size("late") == run) & F.forall("late", lambda c: c == "permanent")
    top = F.array_max(F.transform(F.array_distinct("sigs"), lambda s: F.size(F.filter("sigs", lambda x: x == s))))
    wide = (F.col("seen") >= least) & (2 * F.size("sigs") >= F.col("seen")) & (5 * top >= 4 * F.size("sigs"))
    trips = seen.select(by, "ts", "seq", "seen", F.size("sigs").alias("failed"), F.when(hard, "permanent_run").when(wide, "same_failure").alias("reason")).where("reason is not null")
    first = F.min_by(F.struct("ts", "seq", "seen", "failed", "reason"), F.struct("ts", "seq")).alias("t")
    return trips.groupBy(by).agg(first).select(by, "t.*")


def readiness(shards: DataFrame, assigned: DataFrame) -> DataFrame:
    """Four checks of a layout, a row each: format (nine tenths of the files match a rule), coverage (all do), distribution
    (several disks, none with over three fifths of the bytes) and balance (largest over smallest shard at most 3). What a
    failed check found is its issue; numbers are cut to whole ones, skew to tenths.

    shards: shard, bytes. assigned: disk (null without a rule), size. Empty tables fail format, distribution and balance.
    """
    a = assigned.groupBy("disk").agg(F.count("*").alias("n"), F.sum("size").alias("b")).agg(
        F.sum("n").alias("files"), F.sum(F.when(F.col("disk").isNotNull(), F.col("n"))).alias("matched"), F.count("disk").alias("disks"),
        (F.max(F.when(F.col("disk").isNotNull(), F.col("b"))) / F.sum(F.when(F.col("disk").isNotNull(), F.col("b")))).alias("top"),
    )
    one = a.join(F.broadcast(shards.agg(F.max("bytes").alias("most"), F.min("bytes").alias("fewest"))))  # one row each
    share, skew = F.coalesce(F.col("matched") / F.col("files"), F.lit(0.0)), F.when(F.col("fewest") > 0, F.col("most") / F.col("fewest"))
    checks = {
        "format": (share, share >= 0.9), "coverage": (share, F.coalesce(F.col("matched"), F.lit(0)) == F.coalesce(F.col("files"), F.lit(0))),
        "distribution": (F.col("top"), (F.col("disks") > 1) & (F.col("top") <= 0.6)), "balance": (skew, skew <= 3),
    }
    said = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    whole = lambda v: F.floor(v).cast("long")
    files, matched = (F.coalesce(c, F.lit(0)) for c in ("files", "matched"))
    issues = {
        "format": said(whole(100 * share), " % of the files match a rule"), "coverage": said(files - matched, " files match no rule"),
        "distribution": F.when(F.col("disks") > 1, said("one disk holds ", whole(100 * F.col("top")), " % of the bytes")).otherwise(said(F.col("disks"), " disk in use")),
        "balance": F.coalesce(said("the largest shard is ", whole(10 * skew), " tenths of the smallest"), F.lit("a shard is empty")),
    }
    good = {n: F.coalesce(ok, F.lit(False)) for n, (_, ok) in checks.items()}
    rows = F.array(*(F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), good[n].alias("ok"), F.when(good[n], "").otherwise(issues[n]).alias("issue")) for n, (v, _) in checks.items()))
    return one.select(F.inline(rows))


# The code and severity of the alert for each verdict.
BOTTLENECKS = {
    "cpu_bound": ("host.cpu_bound", "warn"), "mem_pressure": ("host.mem_pressure", "warn"), "disk_at_ceiling": ("disk.at_ceiling", "warn"), "nas_single_spindle": ("nas.single_spindle", "warn"),
    "net_bound": ("net.bound", "info"), "gpu_bound": ("gpu.bound", "warn"), "vram_pressure": ("gpu.vram_pressure", "critical"), "latency_bound": ("nas.latency_bound", "warn"),
}


def with_expected(samples: DataFrame, rate: str, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """observed: the newest positive rate; expected: the highest positive one before it (itself, if it is the only one). A key
    of more than `rows` samples is split into spans of time."""
    good = F.when(F.col(rate) > 0, F.col(rate))
    s = Spans(samples, by, ["ts"], rows).running(observed=("last", good)).running(before=True, _before=("max", good))
    s = s.running(_start=("last", F.when(good.isNotNull(), F.col("_before"))))
    out = s.rows().withColumns({"expected": F.coalesce("_start", "observed", F.lit(0.0)), "observed": F.coalesce("observed", F.lit(0.0))})
    return out.drop("_before", "_start")


def bottleneck_alerts(verdicts: DataFrame, by: Sequence[str], sustain_s: int, rows: int | None = None) -> DataFrame:
    """Spells of a verdict other than healthy that lasted long enough: the alert's code, severity and disk, when it began,
    fired and was last seen, and how often. Another verdict, healthy too, resolves the one before it.

    verdicts: the `by` columns (a host, say, so that hosts are apart), ts, verdict, resource. A host of more than `rows` of
    them is split into spans of time.
    """
    s = Spans(verdicts, by, ["ts"], rows).lag(_was=F.col("verdict"), _any=F.lit(1))
    turns = ~F.col("verdict").eqNullSafe(F.col("_was"))
    s = s.running(turn=("sum", F.when(turns, 1).otherwise(0)), begin_ts=("last", F.when(turns | F.col("_any").isNull(), F.col("ts"))))
    begun = s.rows().where(F.col("verdict").isin(*BOTTLENECKS))
    fires = F.col("ts") - F.col("begin_ts") >= sustain_s
    pick = lambda i: F.coalesce(*(F.when(F.col("verdict") == v, x[i]) for v, x in BOTTLENECKS.items()))
    out = begun.groupBy(*by, "turn").agg(
        F.first("verdict").alias("verdict"), F.min("begin_ts").alias("begin_ts"), F.min(F.when(fires, F.col("ts"))).alias("fire_ts"), F.max("ts").alias("end_ts"), F.count_if(fires).alias("firings"),
        F.max_by("resource", "ts").alias("resource")).where("firings > 0")
    disk = F.nullif(F.regexp_extract("resource", "^[^:]*:(.*)$", 1), F.lit(""))
    return out.select(*by, "verdict", pick(0).alias("code"), pick(1).alias("severity"), disk.alias("disk"), "begin_ts", "fire_ts", "end_ts", "firings")


def newest_verdicts(verdicts: DataFrame, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Spells of one verdict: a new verdict ends the one before it. A key of more than `rows` of them is split into spans."""
    s = Spans(verdicts, by, ["ts"], rows).lag(_was=F.col("verdict"))
    runs = s.running(turn=("sum", F.when(F.col("verdict").eqNullSafe(F.col("_was")), 0).otherwise(1))).rows()
    return runs.groupBy(*by, "turn").agg(F.first("verdict").alias("verdict"), F.min("ts").alias("begin_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("samples")).drop("turn")
