"""Analytics and transforms of a work ledger: one row per item with its job, state, holder and times in epoch seconds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import job_health
from .joins import missing_hosts

STATES = ("done", "pending", "leased", "failed")


def _n(state: str) -> Column:
    return F.count_if(F.col("state") == state)


def _recent(now: int, window_s: int) -> Column:
    return F.count_if((F.col("state") == "done") & (F.col("completed_at") >= now - window_s))


def fleet_stats(ledger: DataFrame, now: int, window_s: int) -> DataFrame:
    """One row: items by state, those done in the window, the rate and the time left at it (null without a rate)."""
    one = ledger.agg(*(_n(s).alias(s) for s in STATES), F.count("*").alias("total"), _recent(now, window_s).alias("recent"))
    left, rate = F.col("pending") + F.col("leased"), F.col("recent") / F.lit(float(window_s))
    return one.select(*STATES, "total", "recent", rate.alias("rate"), left.alias("remaining"), F.when(F.col("recent") > 0, left / rate).alias("eta_s"))


def host_stats(ledger: DataFrame, now: int, window_s: int) -> DataFrame:
    """Per host (null as ?) with work in flight: how much, and its recent rate."""
    by = ledger.groupBy(F.coalesce("host", F.lit("?")).alias("host")).agg(_n("leased").alias("in_flight"), _recent(now, window_s).alias("recent"))
    return by.where("in_flight > 0").select("host", "in_flight", (F.col("recent") / F.lit(float(window_s))).alias("rate"))


def disk_counts(ledger: DataFrame, state: str) -> DataFrame:
    return ledger.where((F.col("state") == state) & F.col("disk").isNotNull()).groupBy("disk").agg(F.count("*").alias("n"))


def job_rollup(ledger: DataFrame, jobs: DataFrame, limit: int = 200) -> DataFrame:
    """Per job: label, counts, first and last times and runners; the most recently active jobs, ties by name."""
    by = ledger.groupBy("job").agg(
        F.count("*").alias("total"), *(_n(s).alias(s) for s in STATES), F.min("created_at").alias("first_created"), F.max("leased_at").alias("last_leased"),
        F.max("completed_at").alias("last_completed"), F.array_join(F.sort_array(F.collect_set("runner_id")), ",").alias("runners"))
    return by.join(jobs, "job", "left").orderBy(F.coalesce("last_completed", "last_leased", "first_created").desc(), "job").limit(limit)


def contribution(ledger: DataFrame, top_jobs: int = 40) -> DataFrame:
    """Items done by (job, runner) in the most recently active jobs; a null runner is an empty name."""
    last = ledger.groupBy("job").agg(F.max(F.coalesce("completed_at", "leased_at", "created_at")).alias("at")).orderBy(F.desc("at"), "job").limit(top_jobs)
    return ledger.where("state = 'done'").join(last, "job", "left_semi").groupBy("job", F.coalesce("runner_id", F.lit("")).alias("runner")).agg(F.count("*").alias("done"))


def job_windows(ledger: DataFrame, now: int, window_s: int) -> DataFrame:
    """Per job: done in the window, rate and time left."""
    by = ledger.groupBy("job").agg(_recent(now, window_s).alias("recent"), F.count_if(F.col("state").isin("pending", "leased")).alias("remaining"))
    rate = F.col("recent") / F.lit(float(window_s))
    return by.select("job", "recent", rate.alias("rate"), F.when(F.col("recent") > 0, F.col("remaining") / rate).alias("eta_s"))


def error_digest(ledger: DataFrame, k: int = 5) -> DataFrame:
    """Per job the k most frequent failure texts, ties by text; blank ones do not count."""
    n = ledger.where("state = 'failed' and error is not null and trim(error) <> ''").groupBy("job", "error").agg(F.count("*").alias("n"))
    order = Window.partitionBy("job").orderBy(F.desc("n"), "error")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def leased_sample(ledger: DataFrame, k: int) -> DataFrame:
    """Per job the k items that are held longest."""
    order = Window.partitionBy("job").orderBy("leased_at", "item_id")
    return ledger.where("state = 'leased'").select("job", "item_id", "leased_at").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def search_items(ledger: DataFrame, states: Sequence[str] = (), job: str | None = None, id_re: str | None = None, error_re: str | None = None, newest_first: bool = True, limit: int = 100) -> DataFrame:
    """Items by state, job and patterns found anywhere in id and error (a null error never matches), by last activity."""
    for pattern in (id_re, error_re):
        if pattern:
            re.compile(pattern)  # a bad pattern fails here, not in a task
    if states:
        ledger = ledger.where(F.col("state").isin(*states))
    if job is not None:
        ledger = ledger.where(F.col("job") == job)
    if id_re:
        ledger = ledger.where(F.col("item_id").rlike(id_re))
    if error_re:
        ledger = ledger.where(F.col("error").rlike(error_re))
    at = F.coalesce("completed_at", "leased_at", "created_at")
    return ledger.withColumn("at", at).orderBy(F.desc("at") if newest_first else F.asc("at"), "item_id").limit(limit)


def expired_holds(ledger: DataFrame, now: int) -> DataFrame:
    return ledger.where((F.col("state") == "leased") & (F.col("lease_deadline") < now))


def hold_ttl(base_s: float, heartbeat_s: float, tolerance: float, cap_s: float) -> float:
    return min(max(base_s, heartbeat_s * tolerance), cap_s)


def stuck_items(marks: DataFrame, now: int, least_s: int) -> DataFrame:
    """Items in flight for longer than the bound; marks with an empty id or a start or pid that is no number are dropped."""
    m = marks.withColumn("started", F.expr("try_cast(started as double)")).withColumn("pid", F.expr("try_cast(pid as bigint)"))
    return m.where("item_id <> '' and started is not null and pid is not null").withColumn("elapsed_s", F.lit(now) - F.col("started")).where(F.col("elapsed_s") > least_s)


def inflight_items(marks: DataFrame, now: int, max_age_s: int | None = None) -> DataFrame:
    """Items in flight by their newest mark; marks older than the bound, if there is one, are left over from workers that died."""
    m = marks.withColumn("started", F.expr("try_cast(started as double)")).where("item_id <> '' and started is not null").withColumn("elapsed_s", F.lit(now) - F.col("started"))
    m = m if max_age_s is None else m.where(F.col("elapsed_s") <= max_age_s)
    return m.groupBy("item_id").agg(F.min("elapsed_s").alias("elapsed_s"))


def upsert_by_job(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """A setting of jobs (job, column) after an upsert: the new value where there is a row, null included (which clears it), else the old."""
    fresh = new.select("job", F.col(column).alias("fresh"), F.lit(True).alias("given"))
    both = old.select("job", column).join(fresh, "job", "full_outer")
    return both.select("job", F.when(F.col("given"), F.col("fresh")).otherwise(F.col(column)).alias(column)).where(F.col(column).isNotNull())


def no_progress(results: DataFrame, now: int, timeout_s: int) -> DataFrame:
    """Runners whose last result is older than twice the timeout; none if no timeout is set."""
    last = results.groupBy("runner_id").agg(F.max("ts").alias("last_ts"))
    return last.where(F.lit(bool(timeout_s)) & (F.lit(now) - F.col("last_ts") > 2 * (timeout_s or 0)))


def retention_split(df: DataFrame, ts: str, now: int, max_age_s: int) -> DataFrame:
    return df.withColumn("expired", F.lit(now) - F.col(ts) > max_age_s)


def keep_latest(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first n rows in the order, overall or per key."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def export_metrics(ledger: DataFrame, job: str | None = None, states: Sequence[str] = ("done",)) -> DataFrame:
    rows = ledger.where(F.col("state").isin(*states))
    rows = rows if job is None else rows.where(F.col("job") == job)
    return rows.select("item_id", "metrics", "state", "job", "disk")


def rank_by_metric(export: DataFrame, field: str, k: int) -> DataFrame:
    """Per job the k items with the largest value of a numeric metric in the JSON column."""
    value = F.expr("try_cast(v as double)")
    rows = export.withColumn("v", F.get_json_object("metrics", f"$.{field}")).withColumn("value", value).where("value is not null")
    order = Window.partitionBy("job").orderBy(F.desc("value"), "item_id")
    return rows.select("job", "item_id", "value").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def parse_ledger(ledger: DataFrame) -> DataFrame:
    """JSON columns as maps; bad or empty JSON is an empty map."""
    kind = "map<string,string>"
    empty = F.expr(f"cast(map() as {kind})")
    return ledger.withColumn("metrics", F.coalesce(F.from_json("metrics", kind), empty))


def job_resources(runners: DataFrame) -> DataFrame:
    """Per job the workers and process memory of its runners in sum, and the highest of each reading of their hosts."""
    most = ("cpu_pct", "mem_used_gb", "mem_total_gb", "gpu_util_pct", "vram_used_gb", "vram_total_gb")
    return runners.groupBy("job").agg(F.sum("workers").alias("workers"), F.sum("tree_rss_gb").alias("tree_rss_gb"), *(F.max(c).alias(c) for c in most))


def latest_runners(heartbeats: DataFrame, now: int, stale_s: int = 120) -> DataFrame:
    """Newest values per runner, its age and whether it is alive.

    What a heartbeat leaves out stays as it was: an unknown host (?) never replaces a known one, nor a null any other
    value; readings (cpu_pct, mem_used_gb) come together from the newest heartbeat that has any. in_flight and circuit
    (closed, if never told) are given where heartbeats have such columns.
    """
    order = F.struct("last_seen", "seq")

    def newest(value: Column, known: Column | None = None) -> Column:
        return F.max_by(value, F.when(value.isNotNull() if known is None else known, order))

    host = F.when(F.col("host") != "?", F.col("host"))
    more = [c for c in ("in_flight", "circuit") if c in heartbeats.columns]
    readings = F.struct("cpu_pct", "mem_used_gb")
    last = heartbeats.groupBy("runner_id").agg(
        F.coalesce(newest(host), F.lit("?")).alias("host"), newest(F.col("job")).alias("job"), newest(F.col("workers")).alias("workers"),
        newest(readings, F.coalesce("cpu_pct", "mem_used_gb").isNotNull()).alias("readings"), *(newest(F.col(c)).alias(c) for c in more), F.max("last_seen").alias("last_seen"))
    last = last.select("runner_id", "host", "job", "workers", "readings.*", *(F.coalesce(c, F.lit("closed")).alias(c) if c == "circuit" else c for c in more), "last_seen")
    return last.withColumn("stale_s", F.lit(now) - F.col("last_seen")).withColumn("alive", F.col("stale_s") <= stale_s)


def status_view(ledger: DataFrame, jobs: DataFrame, now: int, window_s: int, runners: DataFrame | None = None, configured: DataFrame | None = None) -> DataFrame:
    """One row per job: counts, percent done, rate, time left, health, badge, its most frequent failure, when it should end
    (in 5 minutes if nothing is known), what it holds on each disk (a map), and what to do next, blank for nothing.

    With runners, also what they use (job_resources); with configured hosts too, the hint names those that are missing.
    """
    roll = job_rollup(ledger, jobs, 1 << 30)
    rate = job_windows(ledger, now, window_s)
    top = error_digest(ledger, 1).select("job", F.col("error").alias("top_error"))
    out = roll.join(rate, "job").join(top, "job", "left")
    health = job_health(F.col("leased"), F.col("pending"), F.col("rate"), F.col("last_completed"), F.col("last_leased"), now)
    on_disk = ledger.where("state = 'leased'").groupBy("job", F.coalesce("disk", F.lit("?")).alias("disk")).agg(F.count("*").alias("n"))
    on_disk = on_disk.groupBy("job").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("disk", "n")))).alias("disk_inflight"))  # a row for each disk
    out = out.join(on_disk, "job", "left").withColumn("health", health)
    badge = (
        F.when((F.col("failed") > 0) & (F.col("pending") == 0) & (F.col("leased") == 0), "failed").when((F.col("done") >= F.col("total")) & (F.col("total") > 0), "complete")
        .when(F.col("leased") > 0, "running").otherwise("queued")
    )
    used, missing, task = [], F.lit(None).cast("string"), F.lit("")
    if runners is not None:
        tasks = runners.groupBy("job").agg(F.min_by("task", "runner_id").alias("task"))
        res = job_resources(runners).join(tasks, "job")
        out, used, task = out.join(res, "job", "left"), [c for c in res.columns if c not in ("job", "task")], F.coalesce("task", F.lit(""))
        if configured is not None:
            gone = missing_hosts(configured, runners, now).agg(F.array_join(F.slice(F.sort_array(F.collect_set("host")), 1, 3), ", ").alias("gone"))
            out, missing = out.join(F.broadcast(gone)), F.nullif(F.col("gone"), F.lit(""))  # one row
    todo = (
        F.when(F.col("health") == "stalled", "stop the runners that hang, then give held items back")
        .when(F.col("health") == "queued", F.concat(F.lit("start a runner for task "), task, F.lit(" of "), F.col("job")))
        .when(F.col("health") == "idle", "all is done: gather the outputs")
    )
    hint = F.concat_ws("; ", F.concat(F.lit("attach missing hosts: "), missing), todo)
    return out.select(
        "job", "label", "total", "done", "pending", "leased", "failed", (100.0 * F.col("done") / F.col("total")).alias("pct_done"), "rate", "eta_s", "health", badge.alias("badge"), "top_error",
        (F.lit(now) + F.coalesce("eta_s", F.lit(300.0))).alias("projected_end"), "disk_inflight", hint.alias("hint"), *used)


def apply_results(ledger: DataFrame, results: DataFrame, max_retries: int = 3) -> DataFrame:
    """Folds each item's results, in order of (ts, seq), into its ledger row.

    ok and skipped finish it; requeue gives it back without using up an attempt; an error fails it for good if it is the
    second `timeout` in a row or attempts exceed the retries, else gives it back. Results of unknown items are dropped.
    Where both tables have `metrics`, an item gets those of its last ok or skipped result that has any.
    """
    ends = F.coalesce(F.col("status").isin("ok", "skipped"), F.lit(False))
    back = F.coalesce(F.col("status") == "requeue", F.lit(False))
    has = "metrics" in ledger.columns and "metrics" in results.columns
    rows = results.select("item_id", (F.col("metrics") if has else F.lit(None)).alias("fresh"), F.struct("ts", "seq", "status", "error").alias("key"), ends.alias("ends"), back.alias("back"), (~ends & ~back & F.col("error").eqNullSafe("timeout")).alias("late"))
    # Aggregates only, which each task begins by itself, so that no task holds an item's results. What the fold comes to
    # depends on the last result, how many gave the item back, and the timeouts after the last result that was none.
    by = rows.groupBy("item_id").agg(
        F.max("key").alias("last"), F.max_by(F.struct("ends", "back", "late"), "key").alias("kind"), F.count_if("back").alias("returns"), F.max(F.when(~F.col("late"), F.col("key"))).alias("other"),
        F.max_by("fresh", F.when(F.col("ends") & F.col("fresh").isNotNull(), F.col("key"))).alias("fresh"))
    after = rows.where("late").join(by.where("kind.late").select("item_id", "other"), "item_id").where("other is null or key > other").groupBy("item_id").agg(F.count("*").alias("run"))
    both = ledger.join(by, "item_id", "left").join(after, "item_id", "left")
    attempts = F.when(F.col("returns") > 0, F.greatest(F.col("attempts").cast("long") - F.col("returns"), F.lit(0))).otherwise(F.col("attempts")).cast("int")
    before = (F.col("other").isNull() & F.col("error").eqNullSafe("timeout")).cast("int")
    twice = F.col("kind.late") & ((F.col("run") + before) % 2 == 0)
    new = {
        "state": F.when(F.col("last").isNull(), F.col("state")).when(F.col("kind.ends"), "done").when(F.col("kind.back"), "pending").when(twice | (attempts > max_retries), "failed").otherwise("pending"),
        "attempts": attempts,
        "error": F.when(F.col("last").isNull(), F.col("error")).when(F.col("kind.ends") | F.col("kind.back"), None).when(twice, "quarantined: second timeout").otherwise(F.substring("last.error", 1, 2000)),
    }
    if has:
        new["metrics"] = F.coalesce("fresh", "metrics")
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in ledger.columns))


def requeue(ledger: DataFrame, states: Sequence[str] = ("failed",), reset_attempts: bool = False) -> DataFrame:
    """Items of the states (failed ones, if none are named) go back to pending, and nobody holds them; what is no state of a
    ledger is ignored."""
    wanted = [s for s in states or ("failed",) if s in STATES]
    hit = F.coalesce(F.col("state").isin(*wanted), F.lit(False)) if wanted else F.lit(False)
    free = [c for c in ("error", "lease_id", "runner_id", "leased_at", "lease_deadline") if c in ledger.columns]
    new = {"attempts": F.when(hit & F.lit(reset_attempts), 0).otherwise(F.col("attempts")), "state": F.when(hit, "pending").otherwise(F.col("state"))}
    return ledger.withColumns(new | {c: F.when(~hit, F.col(c)) for c in free})


def cancel(ledger: DataFrame, job: str, purge: bool = False) -> DataFrame:
    """The ledger without the job's pending and leased items, or with purge without any of its items. Items without a job are
    never cancelled, and a job must be named."""
    if not job:
        raise ValueError("which job to cancel?")
    gone = F.lit(purge) | F.coalesce(F.col("state").isin("pending", "leased"), F.lit(False))
    return ledger.where(~(F.col("job").eqNullSafe(F.lit(job)) & gone))


def expire(ledger: DataFrame, now: int) -> DataFrame:
    late = F.coalesce((F.col("state") == "leased") & (F.col("lease_deadline") < now), F.lit(False))
    return ledger.withColumns({"state": F.when(late, "pending").otherwise(F.col("state")), "host": F.when(~late, F.col("host")), "runner_id": F.when(~late, F.col("runner_id"))})
