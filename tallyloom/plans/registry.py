"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..adapters import DAY, EVENTS_NOW, LEDGER_NOW, sql_with, view
from ..functions import expr, items
from ..operators import advice, detect, folds, graph, joins, ledger, placement, resample, shards, stages, telemetry
from ..sources import files
from ..streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

WEEKS = 400 * DAY
_ACT = "coalesce(completed_at, leased_at, created_at)"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ledger.STATES)
_RECENT = f"count(*) FILTER (WHERE state = 'done' AND completed_at >= {LEDGER_NOW - WEEKS})"


def add(views: str, sql: str | None = None, name: str | None = None) -> Callable[[Callable[..., DataFrame]], None]:
    """Registers a function of the named views (see adapters), and the SQL that gives the same rows."""

    def put(f: Callable[..., DataFrame]) -> None:
        key = name or f.__name__
        _QUERIES[key] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views.split()))
        if sql:
            _SQL[key] = sql_with(views, sql)

    return put


@add("ledger", f"SELECT *, CAST(recent AS DOUBLE) / {WEEKS} AS rate, pending + leased AS remaining, CASE WHEN recent > 0 THEN (pending + leased) / (CAST(recent AS DOUBLE) / {WEEKS}) END AS eta_s FROM (SELECT {_COUNTS}, count(*) AS total, {_RECENT} AS recent FROM ledger)")
def fleet_stats(led):
    return ledger.fleet_stats(led, LEDGER_NOW, WEEKS)


@add("ledger", f"SELECT coalesce(host, '?') AS host, count(*) FILTER (WHERE state = 'leased') AS in_flight, {_RECENT} / CAST({WEEKS} AS DOUBLE) AS rate FROM ledger GROUP BY 1 HAVING count(*) FILTER (WHERE state = 'leased') > 0")
def host_stats(led):
    return ledger.host_stats(led, LEDGER_NOW, WEEKS)


@add("ledger", "SELECT disk, count(*) AS n FROM ledger WHERE state = 'leased' AND disk IS NOT NULL GROUP BY 1")
def disk_inflight(led):
    return ledger.disk_counts(led, "leased")


@add("ledger", "SELECT disk, count(*) AS n FROM ledger WHERE state = 'done' AND disk IS NOT NULL GROUP BY 1")
def disk_done(led):
    return ledger.disk_counts(led, "done")


_ROLL = f"SELECT l.job, count(*) AS total, {_COUNTS}, min(created_at) AS first_created, max(leased_at) AS last_leased, max(completed_at) AS last_completed, coalesce(string_agg(DISTINCT runner_id, ',' ORDER BY runner_id), '') AS runners, any_value(label) AS label FROM ledger l LEFT JOIN jobs USING (job) GROUP BY 1"


@add("ledger jobs", _ROLL)
def job_rollup(led, jobs):
    return ledger.job_rollup(led, jobs)


@add("ledger", f"SELECT job, coalesce(runner_id, '') AS runner, count(*) AS done FROM ledger WHERE state = 'done' AND job IN (SELECT job FROM ledger GROUP BY job ORDER BY max({_ACT}) DESC, job LIMIT 3) GROUP BY 1, 2")
def contribution(led):
    return ledger.contribution(led, 3)


@add("ledger", f"SELECT job, recent, recent / CAST({WEEKS} AS DOUBLE) AS rate, CASE WHEN recent > 0 THEN remaining / (recent / CAST({WEEKS} AS DOUBLE)) END AS eta_s FROM (SELECT job, {_RECENT} AS recent, count(*) FILTER (WHERE state IN ('pending', 'leased')) AS remaining FROM ledger GROUP BY 1)")
def job_done_in_window(led):
    return ledger.job_windows(led, LEDGER_NOW, WEEKS)


@add("ledger", "SELECT * FROM (SELECT job, error, n, row_number() OVER (PARTITION BY job ORDER BY n DESC, error) AS place FROM (SELECT job, error, count(*) AS n FROM ledger WHERE state = 'failed' AND trim(error) <> '' GROUP BY 1, 2)) WHERE place <= 3")
def error_digest(led):
    return ledger.error_digest(led, 3)


@add("ledger", "SELECT * FROM (SELECT job, item_id, leased_at, row_number() OVER (PARTITION BY job ORDER BY leased_at, item_id) AS place FROM ledger WHERE state = 'leased') WHERE place <= 10")
def leased_sample(led):
    return ledger.leased_sample(led, 10)


@add("ledger", f"SELECT item_id, state, error, {_ACT} AS seen_at FROM ledger WHERE state IN ('failed', 'leased') AND regexp_matches(item_id, '7.*npz') AND regexp_matches(error, '(?i)perm|reset') ORDER BY seen_at DESC, item_id LIMIT 200")
def search_items(led):
    return ledger.search_items(led, ("failed", "leased"), None, "7.*npz", "(?i)perm|reset", True, 200).select("item_id", "state", "error", F.col("at").alias("seen_at"))


@add("ledger", f"SELECT item_id, job, lease_deadline FROM ledger WHERE state = 'leased' AND lease_deadline < {LEDGER_NOW - WEEKS}")
def expired_holds(led):
    return ledger.expired_holds(led, LEDGER_NOW - WEEKS).select("item_id", "job", "lease_deadline")


_NEWEST = "arg_max({0}, seq + last_seen * 10000000) FILTER (WHERE {1}) AS {0}"
_PARTLY = "SELECT runner_id, last_seen, seq, CASE WHEN seq % 3 <> 0 THEN host ELSE '?' END AS host, CASE WHEN seq % 4 = 0 THEN job END AS job, CASE WHEN seq % 5 = 0 THEN workers END AS workers, CASE WHEN seq % 2 = 0 THEN cpu_pct END AS cpu_pct, CASE WHEN seq % 6 = 0 THEN mem_used_gb END AS mem_used_gb, CASE WHEN seq % 7 = 0 THEN seq % 50 END AS in_flight, CASE WHEN seq % 400 = 0 THEN 'open' END AS circuit FROM heartbeats"


@add("heartbeats", f""", p AS ({_PARTLY}) SELECT *, {EVENTS_NOW} - last_seen AS stale_s, {EVENTS_NOW} - last_seen <= {2 * DAY} AS alive FROM (SELECT runner_id, coalesce({_NEWEST.format('host', "host <> '?'").split(' AS ')[0]}, '?') AS host,
 {_NEWEST.format('job', 'job IS NOT NULL')}, {_NEWEST.format('workers', 'workers IS NOT NULL')}, {_NEWEST.format('cpu_pct', 'cpu_pct IS NOT NULL OR mem_used_gb IS NOT NULL')},
 arg_max_null(mem_used_gb, seq + last_seen * 10000000) FILTER (WHERE cpu_pct IS NOT NULL OR mem_used_gb IS NOT NULL) AS mem_used_gb, {_NEWEST.format('in_flight', 'in_flight IS NOT NULL')}, coalesce(max(circuit), 'closed') AS circuit, max(last_seen) AS last_seen FROM p GROUP BY 1)""")
def latest_runners(beats):
    """Heartbeats that leave most things out."""
    told = lambda c, cond: F.when(F.expr(cond), F.col(c))
    partly = beats.select("runner_id", "last_seen", "seq", F.coalesce(told("host", "seq % 3 <> 0"), F.lit("?")).alias("host"), told("job", "seq % 4 = 0").alias("job"), told("workers", "seq % 5 = 0").alias("workers"),
        told("cpu_pct", "seq % 2 = 0").alias("cpu_pct"), told("mem_used_gb", "seq % 6 = 0").alias("mem_used_gb"), F.expr("CASE WHEN seq % 7 = 0 THEN seq % 50 END").alias("in_flight"), F.expr("CASE WHEN seq % 400 = 0 THEN 'open' END").alias("circuit"))
    return ledger.latest_runners(partly, EVENTS_NOW, 2 * DAY)


@add("results", f"SELECT runner_id, max(ts) AS last_ts FROM results GROUP BY 1 HAVING {EVENTS_NOW} - max(ts) > {2 * 42900}")
def no_progress_runners(res):
    return ledger.no_progress(res, EVENTS_NOW, 42900)


@add("results", f"SELECT ts, seq, item_id, {EVENTS_NOW} - ts > {10 * DAY} AS expired FROM results")
def retention_split(res):
    return ledger.retention_split(res, "ts", EVENTS_NOW, 10 * DAY).select("ts", "seq", "item_id", "expired")


@add("results", "SELECT * FROM (SELECT runner_id, ts, seq, row_number() OVER (PARTITION BY runner_id ORDER BY ts DESC, seq DESC) AS place FROM results) WHERE place <= 20")
def keep_latest(res):
    return ledger.keep_latest(res.select("runner_id", "ts", "seq"), 20, [F.desc("ts"), F.desc("seq")], ["runner_id"])


@add("ledger", "SELECT item_id, metrics, state, job, disk FROM ledger WHERE state = 'done'")
def export_metrics(led):
    return ledger.export_metrics(led)


@add("ledger", "SELECT * FROM (SELECT job, item_id, CAST(json_extract_string(metrics, '$.bytes') AS DOUBLE) AS value, row_number() OVER (PARTITION BY job ORDER BY CAST(json_extract_string(metrics, '$.bytes') AS DOUBLE) DESC, item_id) AS place FROM ledger WHERE state = 'done') WHERE place <= 10")
def rank_by_metric(led):
    return ledger.rank_by_metric(ledger.export_metrics(led), "bytes", 10)


# Each item's results one after another: its state, attempts and error after the k-th.
_FOLDED = """, q AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts, seq) AS k FROM results), f AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT) AS k, 'leased' AS state, {start} AS attempts, CAST(NULL AS VARCHAR) AS error FROM results
 UNION ALL SELECT f.item_id, q.k, CASE WHEN q.status IN ('ok', 'skipped') THEN 'done' WHEN q.status = 'requeue' THEN 'pending' WHEN q.error = 'timeout' AND f.error = 'timeout' THEN 'failed' WHEN f.attempts + {lease} > 3 THEN 'failed' ELSE 'pending' END,
 CASE WHEN q.status = 'requeue' THEN greatest(f.attempts + {lease} - 1, 0) ELSE f.attempts + {lease} END, CASE WHEN q.status IN ('ok', 'skipped', 'requeue') THEN NULL WHEN q.error = 'timeout' AND f.error = 'timeout' THEN 'quarantined: second timeout' ELSE substr(q.error, 1, 2000) END
 FROM f JOIN q ON q.item_id = f.item_id AND q.k = f.k + 1) SELECT item_id, state, attempts, error FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC) AS z FROM f) WHERE z = 1"""


@add("ledger", "SELECT item_id, job, state, json_extract_string(metrics, '$.bytes') AS bytes FROM ledger")
def read_ledger(led):
    return ledger.parse_ledger(led).select("item_id", "job", "state", F.col("metrics")["bytes"].alias("bytes"))


@add("heartbeats", f"SELECT job, sum(workers) AS workers, sum(tree_rss_gb) AS tree_rss_gb, {', '.join(f'max({c}) AS {c}' for c in ('cpu_pct', 'mem_used_gb', 'mem_total_gb', 'gpu_util_pct', 'vram_used_gb', 'vram_total_gb'))} FROM heartbeats GROUP BY 1")
def job_resources(beats):
    return ledger.job_resources(beats)


@add("ledger jobs", f", r AS ({_ROLL}), w AS (SELECT job, {_RECENT} AS recent FROM ledger GROUP BY 1), e AS (SELECT job, error AS top_error FROM (SELECT job, error, row_number() OVER (PARTITION BY job ORDER BY count(*) DESC, error) AS p FROM ledger WHERE state = 'failed' AND trim(error) <> '' GROUP BY 1, 2) WHERE p = 1) SELECT r.job, label, total, done, pending, leased, failed, 100.0 * CAST(done AS DOUBLE) / total AS pct_done, recent / CAST({WEEKS} AS DOUBLE) AS rate, CASE WHEN recent > 0 THEN (pending + leased) / (recent / CAST({WEEKS} AS DOUBLE)) END AS eta_s, CASE WHEN leased <= 0 AND pending <= 0 THEN 'idle' WHEN leased > 0 AND recent <= 0 AND {LEDGER_NOW} - coalesce(last_completed, last_leased) >= 600 THEN 'stalled' WHEN leased > 0 AND recent > 0 THEN 'running' WHEN pending > 0 AND leased = 0 THEN 'queued' ELSE 'active' END AS health, top_error FROM r JOIN w USING (job) LEFT JOIN e USING (job)")
def status_view(led, jobs):
    out = ledger.status_view(led, jobs, LEDGER_NOW, WEEKS)
    return out.drop("badge", "projected_end", "disk_inflight", "hint")  # status_board has these


@add("ledger", f"SELECT item_id, CASE WHEN state = 'leased' AND lease_deadline < {LEDGER_NOW} THEN 'pending' ELSE state END AS state, CASE WHEN NOT (state = 'leased' AND lease_deadline < {LEDGER_NOW}) OR lease_deadline IS NULL THEN host END AS host FROM ledger")
def expire(led):
    return ledger.expire(led, LEDGER_NOW).select("item_id", "state", "host")


@add("ledger", "SELECT item_id, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state, CASE WHEN state = 'failed' THEN 0 ELSE attempts END AS attempts, CASE WHEN state <> 'failed' THEN error END AS error FROM ledger")
def requeue(led):
    return ledger.requeue(led, ("failed", "nonsense"), True).select("item_id", "state", "attempts", "error")


@add("ledger", "SELECT item_id, state FROM ledger WHERE attempts = 3 OR job <> 'seg/BUILDING' OR state NOT IN ('pending', 'leased')")
def cancel(led):
    """Items of three attempts have lost their job: they stay."""
    return ledger.cancel(led.withColumn("job", F.when(F.col("attempts") != 3, F.col("job"))), "seg/BUILDING").select("item_id", "state")


@add("results", _FOLDED.format(start="1", lease="0"))
def apply_results(res):
    items = res.select("item_id").distinct().select("item_id", F.lit("leased").alias("state"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return ledger.apply_results(items, res)


_RULES = (("d1", "src0/"), ("d2", "src1..3"), ("d3", ""), ("d4", "src1*/de/*"), ("d5", "src[!0-35-9]/[a-e]?/doc_*[02468].txt"), ("d6", "src1"), ("d7", "src5..9"))


@add("manifest", "SELECT rel_path, CASE WHEN contains(rel_path, 'src0/') THEN 'd1' WHEN contains(rel_path, 'src1') OR contains(rel_path, 'src2') OR contains(rel_path, 'src3') THEN 'd2' WHEN rel_path GLOB 'src1*/de/*' THEN 'd4' WHEN regexp_full_match(rel_path, 'src4/[a-e]./doc_.*[02468][.]txt') THEN 'd5' WHEN regexp_matches(rel_path, 'src[5-9]') THEN 'd7' END AS disk FROM manifest")
def assign_by_rules(man):
    return joins.assign_by_rules(man, _RULES, ["rel_path"]).select("rel_path", "disk")


_ROOTED = """SELECT rel_path, CASE size % 4 WHEN 0 THEN concat('//nas', CAST(size % 11 AS STRING), '/share/a/b') WHEN 1 THEN concat('//Nas', CAST(size % 11 AS STRING), '/DIRECT/in/') WHEN 2 THEN concat('//nas', CAST(size % 11 AS STRING), '/sharex') END AS read_root,
 CASE WHEN size % 6 = 1 THEN concat('//nas', CAST(size % 9 AS STRING), '/share') ELSE '' END AS write_root FROM manifest"""
_OWNER = """SELECT x.rel_path, arg_min(t.disk, t.place) AS disk FROM x JOIN topology t ON coalesce(t.read, t.direct_path) IS NOT NULL AND (lower(rtrim({0}, '/')) = lower(rtrim(coalesce(t.read, t.direct_path), '/')) OR starts_with(lower({0}), concat(lower(rtrim(coalesce(t.read, t.direct_path), '/')), '/'))) GROUP BY 1"""


@add("manifest topology", f""", x AS ({_ROOTED}), m AS (SELECT x.rel_path, arg_min(t.disk, t.place) AS disk FROM x JOIN topology t ON t.match <> '' AND CASE t.place % 5 WHEN 0 THEN contains(rel_path, t.match)
 WHEN 1 THEN contains(rel_path, concat('doc_', CAST(3 * t.place AS VARCHAR))) OR contains(rel_path, concat('doc_', CAST(3 * t.place + 1 AS VARCHAR))) OR contains(rel_path, concat('doc_', CAST(3 * t.place + 2 AS VARCHAR)))
 ELSE regexp_full_match(rel_path, concat('src', CAST(t.place % 20 AS VARCHAR), '/[a-e]./doc_.*', CAST(t.place % 10 AS VARCHAR), '[^02468][.]txt')) END GROUP BY 1), r AS ({_OWNER.format('read_root')}), w AS ({_OWNER.format('write_root')})
 SELECT x.rel_path, coalesce(m.disk, r.disk, w.disk) AS disk FROM x LEFT JOIN m ON m.rel_path = x.rel_path LEFT JOIN r ON r.rel_path = x.rel_path LEFT JOIN w ON w.rel_path = x.rel_path""")
def assign_by_topology(man, topology):
    rooted = man.sparkSession.sql(_ROOTED.replace("FROM manifest", "FROM {man}"), man=man)
    return placement.assign_by_topology(rooted, topology, ["rel_path"]).select("rel_path", "disk")


class Resample:
    """A task that makes an item of a clip for each of its rates."""

    @staticmethod
    def enumerate_subjobs(args):
        for fps in args["rates"]:
            yield {"subjob_id": f"{args['clip']}@{fps}", "spec": {"fps": fps}}


@add("manifest", "SELECT rel_path AS clip, concat(rel_path, '@', fps) AS subjob_id, concat('{\"fps\": ', fps, '}') AS spec FROM (SELECT rel_path, unnest([8, 24, 30, 60][1:CAST(size % 5 AS BIGINT)]) AS fps FROM manifest)")
def fan_out(man):
    rates = F.slice(F.array(*map(F.lit, (8, 24, 30, 60))), F.lit(1), (F.col("size") % 5).cast("int"))
    return items.fan_out(man.select(F.col("rel_path").alias("clip"), rates.alias("rates")), Resample).select("clip", "subjob_id", "spec")


@add("results ledger", "SELECT item_id, any_value('pending') AS state, '(ungrouped)' AS job, min(seq) AS seq FROM results WHERE item_id NOT IN (SELECT item_id FROM ledger) GROUP BY 1")
def seed_new(res, led):
    return joins.seed_new(res.select("item_id", "seq"), led, ["seq"]).select("item_id", "state", "job", "seq")


@add("manifest", "SELECT rel_path, size FROM manifest WHERE NOT (size % 3 = 0)")
def skip_existing(man):
    return joins.skip_existing(man.select("rel_path", "size"), man.where("size % 3 = 0").select("rel_path", "size"), "path_size")


_KEY = "regexp_replace(regexp_replace(regexp_extract(item_id, '([^/]*)$', 1), '\\.npz$', ''), '^[A-Za-z0-9]{1,8}-', '')"


@add("ledger", f"SELECT DISTINCT {_KEY} AS key FROM ledger WHERE job = 'seg/BUILDING' AND state = 'done' AND {_KEY} NOT IN (SELECT concat(CAST(CAST({_KEY} AS BIGINT) + 3 AS VARCHAR)) FROM ledger WHERE job = 'seg/MACHINERY')")
def edge_each(led):
    down = led.where("job = 'seg/MACHINERY'").select(F.concat((expr.item_key(F.col("item_id")).cast("long") + 3).cast("string"), F.lit(".npz")).alias("item_id"))
    return joins.edge_each(led.where("job = 'seg/BUILDING'"), down)


@add("ledger", "SELECT count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'done') >= 100 AS open FROM ledger WHERE job = 'seg/BUILDING'")
def edge_barrier(led):
    return joins.edge_barrier(led.where("job = 'seg/BUILDING'"), "quorum", 100)


@add("manifest", "SELECT count(*) AS required, count(*) FILTER (WHERE size > 500) AS present, count(*) > 0 AND count(*) = count(*) FILTER (WHERE size > 500) AS open FROM manifest WHERE starts_with(rel_path, 'src1/')")
def edge_artifact(man):
    return joins.edge_artifact(man.where("startswith(rel_path, 'src1/')").select("rel_path"), man.where("size > 500"))


@add("results", f"SELECT DISTINCT host, item_id FROM results WHERE host <> 'host3' AND (host, item_id) NOT IN (SELECT (host, item_id) FROM results WHERE status = 'requeue' AND ts + {5 * DAY} > {EVENTS_NOW})")
def cooldown_exclude(res):
    pairs = res.select("host", "item_id").distinct()
    return joins.cooldown_exclude(pairs, res.where("host = 'host3'").select("host").distinct(), res.where("status = 'requeue'"), EVENTS_NOW, 5 * DAY)


@add("results heartbeats", f"SELECT DISTINCT concat('host', CAST(CAST(substr(item_id, 2) AS BIGINT) % 15 AS VARCHAR)) AS host FROM results WHERE host NOT IN (SELECT 'x') AND concat('host', CAST(CAST(substr(item_id, 2) AS BIGINT) % 15 AS VARCHAR)) NOT IN (SELECT lower(host) FROM heartbeats WHERE {EVENTS_NOW} - last_seen <= {3 * DAY})")
def missing_hosts(res, beats):
    wanted = res.select(F.concat(F.lit("HOST"), (F.substring("item_id", 2, 9).cast("long") % 15).cast("string")).alias("host"))
    return joins.missing_hosts(wanted, beats, EVENTS_NOW, 3 * DAY)


@add("results", "SELECT item_id, seq, status, CASE WHEN status <> 'error' OR lower(trim(error)) IN ('timeout', 'pool_reset') THEN 'ok' WHEN regexp_matches(lower(error), 'nt_status_logon_failure|permissionerror') THEN 'permanent' ELSE 'transient' END AS class, CASE WHEN error IS NULL THEN '<none>' WHEN contains(lower(error), 'nt_status_logon_failure') THEN 'nt_status_logon_failure' WHEN contains(lower(error), 'permissionerror') THEN 'permissionerror' ELSE error END AS signature FROM results")
def classify_result(res):
    return res.select("item_id", "seq", "status", expr.classify_result(F.col("status"), F.col("error")).alias("class"), expr.error_signature(F.col("error")).alias("signature"))


@add("ledger", f"SELECT item_id, regexp_extract(item_id, '^(.+)/[^/]*$', 1) AS job_of, {_KEY} AS key, split_part(item_id, '/', 1) AS shard FROM ledger")
def path_parts(led):
    i = F.col("item_id")
    return led.select("item_id", expr.job_of(i).alias("job_of"), expr.item_key(i).alias("key"), expr.shard_of(i).alias("shard"))


@add("manifest", "SELECT rel_path, CAST(1 + CAST(concat('0x', substr(sha1(rel_path), 1, 8)) AS BIGINT) % 7 AS INTEGER) AS shard FROM manifest")
def hash_shard(man):
    return man.select("rel_path", expr.hash_shard(F.col("rel_path"), 7).alias("shard"))


@add("log_lines", "SELECT item_id, line_no, replace(line, 'example', 'exa…REDACTED') AS line FROM log_lines")
def redact(lines):
    return lines.select("item_id", "line_no", expr.redact(F.col("line"), ["example", "the"]).alias("line"))


@add("manifest", "SELECT rel_path, concat('out/', rel_path, '.npz') AS item_id FROM manifest")
def render_items(man):
    return man.select("rel_path", expr.render("out/{stem}.npz", F.col("rel_path")).alias("item_id"))


@add("runner_progress", "SELECT runner, ts, done, CASE WHEN l IS NOT NULL THEN greatest((done - p) / CAST(ts - l AS DOUBLE), 0.0) END AS rate FROM (SELECT *, lag(ts) OVER w AS l, lag(done) OVER w AS p FROM runner_progress WINDOW w AS (PARTITION BY runner ORDER BY ts))")
def rate_series(s):
    return telemetry.rate_series(s, "done", ["runner"])


@add("disk_samples", "SELECT disk, ts, seq, CASE WHEN d > 0 THEN r * 0.000512e0 / d ELSE 0.0 END AS read_mbps, CASE WHEN d > 0 THEN x * 0.000512e0 / d ELSE 0.0 END AS write_mbps, CASE WHEN d > 0 THEN least(i * 0.1e0 / d, 100.0) ELSE 0.0 END AS util_pct FROM (SELECT disk, ts, seq, ts - first(ts) OVER w AS d, read_sectors - first(read_sectors) OVER w AS r, write_sectors - first(write_sectors) OVER w AS x, io_ms - first(io_ms) OVER w AS i FROM disk_samples WINDOW w AS (PARTITION BY disk ORDER BY ts, seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))")
def rolling_io(s):
    return telemetry.rolling_io(s)


@add("runner_progress", "SELECT runner, ts, 100.0 * CAST(sum(done) OVER (PARTITION BY ts ORDER BY last, runner ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT sum(m) FROM (SELECT max(done) AS m FROM runner_progress GROUP BY runner)) AS upto_pct FROM runner_progress JOIN (SELECT runner, max(done) AS last FROM runner_progress GROUP BY 1) USING (runner)")
def contribution_stack(s):
    return telemetry.contribution_stack(s)


@add("results", "SELECT * FROM (SELECT item_id, ts, seq, status, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, seq DESC) AS place FROM results) WHERE place <= 20")
def item_trace(res):
    return telemetry.item_trace(res.select("item_id", "ts", "seq", "status"))


_TRACED = "SELECT item_id, ts, seq, status, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, seq DESC) AS place FROM results"


@add("results", f"SELECT item_id, string_agg(concat(seq, ':', status), ',' ORDER BY ts, seq) AS trace, max(state) AS state, max(attempts) AS attempts FROM (SELECT t.*, CASE WHEN CAST(substr(item_id, 2) AS BIGINT) % 3 <> 0 THEN n.state END AS state, CASE WHEN CAST(substr(item_id, 2) AS BIGINT) % 3 <> 0 THEN n.attempts END AS attempts FROM ({_TRACED}) t JOIN (SELECT item_id, max(status) AS state, count(*) AS attempts FROM results GROUP BY 1) n USING (item_id) WHERE place <= 20) GROUP BY 1")
def item_timeline(res):
    """The ledger has lost every third item."""
    led = res.where("CAST(substr(item_id, 2) AS BIGINT) % 3 <> 0").groupBy("item_id").agg(F.max("status").alias("state"), F.count("*").alias("attempts"))
    out = telemetry.item_timeline(res.select("item_id", "ts", "seq", "status"), led)
    return out.select("item_id", F.array_join(F.transform("events", lambda e: F.concat(e.seq.cast("string"), F.lit(":"), e.status)), ",").alias("trace"), "state", "attempts")


@add("series", "SELECT key, ts, round(v + CASE WHEN t1 IS NULL THEN 0 ELSE (ts - t0) / CAST(t1 - t0 AS DOUBLE) * (v1 - v) END, 6) AS value FROM (SELECT key, CAST(s + k * 21600 AS BIGINT) AS ts, t0, v, t1, v1 FROM (SELECT key, ts AS t0, value AS v, min(ts) OVER (PARTITION BY key) AS s, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS t1, lead(value) OVER (PARTITION BY key ORDER BY ts) AS v1 FROM series) x, unnest(generate_series(CAST(ceil((t0 - s) / 21600.0) AS BIGINT), CASE WHEN t1 IS NULL THEN CAST(floor((t0 - s) / 21600.0) AS BIGINT) ELSE CAST(ceil((t1 - s) / 21600.0) AS BIGINT) - 1 END)) g(k))")
def resample_linear(s):
    return telemetry.resample_linear(s, 21600).withColumn("value", F.round("value", 6))


@add("disk_samples", "SELECT disk, min(ts) AS begin_ts, min(CASE WHEN ts - b >= 600 THEN ts END) AS fire_ts, max(ts) AS end_ts, count(*) FILTER (WHERE ts - b >= 600) AS firings FROM (SELECT *, min(ts) OVER (PARTITION BY disk, spell) AS b FROM (SELECT disk, ts, write_sectors % 4 <> 0 AS ok, sum(CASE WHEN write_sectors % 4 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY disk ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM (SELECT disk, ts, max(write_sectors) AS write_sectors FROM disk_samples GROUP BY 1, 2)) WHERE ok) GROUP BY disk, spell HAVING count(*) FILTER (WHERE ts - b >= 600) > 0")
def sustained(s):
    return _sustained(s)


def _sustained(s, rows=None):
    return telemetry.sustained(s.groupBy("disk", "ts").agg(F.max("write_sectors").alias("write_sectors")), "disk", F.col("write_sectors") % 4 != 0, 600, rows)


@add("progress", "SELECT job, ts, d_failed, d_done FROM (SELECT job, ts, failed - lag(failed) OVER w AS d_failed, done - lag(done) OVER w AS d_done, ts - lag(ts) OVER w AS d_ts FROM progress WINDOW w AS (PARTITION BY job ORDER BY ts)) WHERE d_ts >= 1 AND (d_failed >= 20 OR (d_failed >= 3 AND d_failed >= 0.3 * (d_failed + d_done)))")
def detect_failure_spike(s):
    return telemetry.failure_spike(s).select("job", "ts", "d_failed", "d_done")


@add("progress", "SELECT job, ts, coalesce(n >= 6 AND pending > 0 AND base > 1e-4 AND late < 0.4 * base, false) AS collapsed FROM (SELECT *, avg(rate) OVER (PARTITION BY job ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS late, avg(rate) OVER (PARTITION BY job ORDER BY ts ROWS BETWEEN 899 PRECEDING AND 3 PRECEDING) AS base FROM (SELECT *, row_number() OVER w AS n, (done - lag(done) OVER w) / CAST(ts - lag(ts) OVER w AS DOUBLE) AS rate FROM progress WINDOW w AS (PARTITION BY job ORDER BY ts)))")
def detect_collapse(s):
    return telemetry.collapse(s, least_base=1e-4).select("job", "ts", "collapsed")


@add("results", "SELECT runner_id, count(*) AS n, max(ts) - min(ts) AS span_s, CASE WHEN max(ts) > min(ts) THEN count(*) / CAST(max(ts) - min(ts) AS DOUBLE) ELSE 0.0 END AS rate FROM results GROUP BY 1")
def true_rate(res):
    return telemetry.true_rate(res, "ts", ["runner_id"])


@add("samples", "SELECT disk, min(concurrency) FILTER (WHERE mbps >= 0.9 * peak) AS suggested, arg_max(concurrency, mbps) AS peak_concurrency, round(max(mbps), 6) AS peak FROM (SELECT *, max(mbps) OVER (PARTITION BY disk) AS peak FROM samples) GROUP BY 1")
def suggest_concurrency(s):
    return telemetry.suggest_concurrency(s).withColumn("peak", F.round("peak", 6))


@add("decisions", f"SELECT host, sum(n) AS decisions, sum(q) AS requested, sum(g) AS granted, arg_max(reason, concat(lpad(CAST(n AS VARCHAR), 9, '0'), reason)) AS main_reason, sum(g) / CAST(sum(q) AS DOUBLE) AS grant_ratio, sum(q) > 0 AND sum(g) / CAST(sum(q) AS DOUBLE) < 0.05 AND sum(n) >= 2 AS starved, map_from_entries(list(row(coalesce(reason, '?'), n) ORDER BY reason)) AS reasons FROM (SELECT host, reason, count(*) AS n, sum(requested) AS q, sum(granted) AS g FROM decisions WHERE ts > {LEDGER_NOW - WEEKS} AND ts <= {LEDGER_NOW} GROUP BY 1, 2) GROUP BY 1")
def scheduling_summary(d):
    return telemetry.scheduling_summary(d, LEDGER_NOW, WEEKS)


@add("results", "SELECT runner_id, class, signature, n, n / CAST(sum(n) OVER (PARTITION BY runner_id) AS DOUBLE) AS share FROM (SELECT runner_id, CASE WHEN regexp_matches(lower(error), 'nt_status_logon_failure|permissionerror') THEN 'permanent' ELSE 'transient' END AS class, CASE WHEN contains(lower(error), 'nt_status_logon_failure') THEN 'nt_status_logon_failure' WHEN contains(lower(error), 'permissionerror') THEN 'permissionerror' ELSE error END AS signature, count(*) AS n FROM results WHERE status = 'error' AND error NOT IN ('timeout', 'pool_reset') GROUP BY 1, 2, 3)")
def failure_breakdown(res):
    return telemetry.failure_breakdown(res)


@add("manifest", "SELECT split_part(rel_path, '/', 1) AS shard, count(*) AS files, sum(size) AS bytes FROM manifest GROUP BY 1")
def assess_layout(man):
    return telemetry.assess_layout(man)


@add("manifest", """SELECT disk, CAST(sum(n) AS BIGINT) AS files, CAST(sum(b) AS BIGINT) AS bytes, count(*) AS shards, sum(b) / CAST(sum(sum(b)) OVER () AS DOUBLE) AS share, coalesce(string_agg(CASE WHEN disk IS NULL THEN shard END, ',' ORDER BY shard), '') AS unmatched
 FROM (SELECT CASE WHEN length(split_part(rel_path, '/', 1)) <> 5 THEN size % 4 END AS disk, split_part(rel_path, '/', 1) AS shard, count(*) AS n, sum(size) AS b FROM manifest GROUP BY 1, 2) GROUP BY disk""")
def layout_by_disk(man):
    return telemetry.layout_by_disk(man.withColumn("disk", F.when(F.length(F.substring_index("rel_path", "/", 1)) != 5, F.col("size") % 4)))


@add("manifest", "SELECT shards, skew, CASE WHEN skew <= 1.25 THEN 'well-balanced' WHEN skew <= 2 THEN 'slightly-skewed' ELSE 'skewed' END AS verdict FROM (SELECT count(*) AS shards, max(b) / CAST(min(b) AS DOUBLE) AS skew FROM (SELECT sum(size) AS b FROM manifest GROUP BY split_part(rel_path, '/', 1)))")
def layout_skew(man):
    return telemetry.layout_skew(telemetry.assess_layout(man))


@add("log_lines", "SELECT item_id, line_no, place, bytes FROM (SELECT item_id, line_no, row_number() OVER w AS place, sum(strlen(line) + 1) OVER (PARTITION BY item_id ORDER BY line_no DESC ROWS UNBOUNDED PRECEDING) AS bytes FROM log_lines WINDOW w AS (PARTITION BY item_id ORDER BY line_no DESC)) WHERE place <= 5 AND bytes <= 600")
def log_tail(lines):
    return telemetry.log_tail(lines, 5, 600)


@add("manifest", "SELECT rel_path, concat('shard_', lpad(CAST(1 + size % 7 AS VARCHAR), 2, '0'), '/', rel_path) AS target, 'move' AS action FROM manifest")
def move_plan(man):
    return telemetry.move_plan(man.withColumn("shard", 1 + F.col("size") % 7))


_SHARDED = "SELECT CASE size % 3 WHEN 0 THEN rel_path WHEN 1 THEN concat('shard_', lpad(CAST(1 + size % 5 AS VARCHAR), 2, '0'), '/', rel_path) ELSE concat('shard_old/', rel_path) END AS rel_path, rel_path AS inside, 1 + size % 7 AS shard FROM manifest"


@add("manifest", f"SELECT rel_path, concat('shard_', lpad(CAST(shard AS VARCHAR), 2, '0'), '/', inside) AS target, CASE WHEN starts_with(rel_path, 'shard_') THEN 'skip' ELSE 'move' END AS first_action, CASE WHEN rel_path = concat('shard_', lpad(CAST(shard AS VARCHAR), 2, '0'), '/', inside) THEN 'skip' ELSE 'move' END AS action FROM ({_SHARDED})")
def move_plan_modes(man):
    """Files without a shard's folder, in a numbered one, and in an old one."""
    numbered = F.concat(F.format_string("shard_%02d/", 1 + F.col("size") % 5), "rel_path")
    old = F.when(F.col("size") % 3 == 0, F.col("rel_path")).when(F.col("size") % 3 == 1, numbered).otherwise(F.concat(F.lit("shard_old/"), "rel_path"))
    plan = man.select(old.alias("rel_path"), (1 + F.col("size") % 7).alias("shard"))
    first = telemetry.move_plan(plan, rebalance=False).select("rel_path", F.col("action").alias("first_action"))
    return telemetry.move_plan(plan).join(first, "rel_path")


@add("manifest", "SELECT DISTINCT 1 + size % 7 AS place, concat('disk', 1 + size % 7) AS disk, 'hdd' AS kind, concat('shard_0', 1 + size % 7) AS match, concat('//nas/disk', 1 + size % 7, '/shard_0', 1 + size % 7) AS read, concat('/mnt/', 1 + size % 7) AS write FROM manifest")
def shard_topology(man):
    return telemetry.shard_topology(man.withColumn("shard", 1 + F.col("size") % 7), read="//nas/{disk}/{shard}", write="/mnt/{n}")


@add("manifest", "SELECT rel_path AS subjob_id, concat('disk', k) AS disk, rel_path AS src_path, rel_path AS dst_path, '/nvme/in' AS read_root, concat('/mnt/disk', k, '/Word', k, '/Set') AS write_root, true AS direct_disk_write FROM (SELECT rel_path, 1 + CAST(concat('0x', substr(sha1(rel_path), 1, 8)) AS BIGINT) % 7 AS k FROM manifest)")
def demote_items(man):
    return telemetry.demote_items(man, "/nvme/in/", "/mnt/user/Word*/Set")


@add("edges node_states", ", c AS (SELECT src AS node FROM edges WHERE CAST(src AS BIGINT) % 97 = 5 UNION SELECT dst FROM c JOIN edges ON node = src) SELECT node, state FROM c JOIN node_states USING (node) WHERE state <> 'clean'")
def dirty_closure(edges, states):
    start = edges.where("cast(src as bigint) % 97 = 5").select(F.col("src").alias("node"))
    return graph.dependency_closure(edges, start).join(states, "node").where("state <> 'clean'").select("node", "state")


@add("ledger budgets", "SELECT disk, inflight, budget, 'warn' AS severity FROM (SELECT disk, count(*) AS inflight FROM ledger WHERE state = 'leased' GROUP BY 1) x JOIN (SELECT disk, CAST(sum(budget) AS BIGINT) AS budget FROM budgets GROUP BY 1) y USING (disk) WHERE budget > 0 AND inflight > floor(budget * 1.2)")
def detect_thrash(led, budgets):
    inflight = led.where("state = 'leased'").groupBy("disk").agg(F.count("*").alias("inflight"))
    return detect.thrash(inflight, budgets.groupBy("disk").agg(F.sum("budget").alias("budget")))


@add("utils budgets", "SELECT disk, ts, util_pct, CASE WHEN disk IN (SELECT disk FROM budgets WHERE parity_protected AND budget > 40) THEN 'critical' ELSE 'warn' END AS severity FROM utils WHERE util_pct >= 95")
def detect_saturation(s, budgets):
    return detect.saturation(s, budgets.withColumn("parity_protected", F.expr("parity_protected and budget > 40")))


@add("ledger budgets", "SELECT disk, parity_protected, budget, inflight, pending, 'info' AS severity FROM budgets JOIN (SELECT disk, count(*) FILTER (WHERE state = 'leased') AS inflight, count(*) FILTER (WHERE state = 'pending') AS pending FROM ledger GROUP BY 1) x USING (disk) WHERE parity_protected AND budget > 0 AND inflight >= budget AND pending > 0")
def detect_write_pressure(led, budgets):
    work = led.groupBy("disk").agg(F.count_if(F.col("state") == "leased").alias("inflight"), F.count_if(F.col("state") == "pending").alias("pending"))
    return detect.write_pressure(budgets.join(work, "disk"))


_LOAD = "greatest(mbps / ceiling_mbps, util_pct / 100)"
_HOT = f"({_LOAD} >= 0.9 OR util_pct >= 95)"
_BUSY = f"(NOT {_HOT} AND (util_pct >= 50 OR inflight > 0))"
_VERDICTS = f"""SELECT ts, CASE WHEN vram >= 0.9 THEN 'vram_pressure' WHEN gpu >= 0.95 THEN 'gpu_bound' WHEN mem >= 0.9 THEN 'mem_pressure' WHEN hot IS NOT NULL THEN 'disk_at_ceiling' WHEN busy = 1 AND idle >= 2 THEN 'nas_single_spindle'
 WHEN net >= 0.9 THEN 'net_bound' WHEN cpu >= 0.9 THEN 'cpu_bound' WHEN expected > 0 AND observed < 0.5 * expected AND most < 0.9 THEN 'latency_bound' ELSE 'healthy' END AS verdict, hot, warm, most FROM (
 SELECT *, greatest(vram, gpu, mem, net, cpu, least(coalesce(load, 0), 1.0)) AS most FROM (SELECT *, CASE WHEN vram_total_gb > 0 THEN vram_used_gb / vram_total_gb ELSE 0.0e0 END AS vram, CASE WHEN vram_total_gb > 0 THEN least(gpu_util_pct / 100, 1.0e0) ELSE 0.0e0 END AS gpu,
 mem_used_gb / mem_total_gb AS mem, net_mbps / net_cap_mbps AS net, least(cpu_pct / 100, 1.0e0) AS cpu FROM host_hours LEFT JOIN (SELECT ts, max({_LOAD}) AS load, min(disk) FILTER (WHERE {_HOT}) AS hot, min(disk) FILTER (WHERE {_BUSY}) AS warm,
 count(*) FILTER (WHERE {_BUSY}) AS busy, count(*) FILTER (WHERE NOT {_HOT} AND inflight = 0 AND util_pct < 20) AS idle FROM disk_hours GROUP BY 1) g USING (ts)))"""


def _with_disks(hosts, disks):
    row = F.struct("disk", "util_pct", "mbps", "ceiling_mbps", "inflight")
    return hosts.join(disks.groupBy("ts").agg(F.array_sort(F.collect_list(row)).alias("disks")), "ts", "left")  # seven disks


@add("host_hours disk_hours", f"SELECT ts, verdict, CASE verdict WHEN 'vram_pressure' THEN 'vram' WHEN 'gpu_bound' THEN 'gpu' WHEN 'mem_pressure' THEN 'mem' WHEN 'disk_at_ceiling' THEN concat('disk:', hot) WHEN 'nas_single_spindle' THEN concat('disk:', warm) WHEN 'net_bound' THEN 'net' WHEN 'cpu_bound' THEN 'cpu' WHEN 'latency_bound' THEN 'latency' ELSE 'none' END AS resource, most AS max_pressure FROM ({_VERDICTS})")
def bottleneck(hosts, disks):
    return detect.bottleneck(_with_disks(hosts, disks))


@add("host_hours disk_hours", f"""SELECT v.ts, v.verdict, CAST(least(h.cpu_pct / 100, 1) AS DOUBLE) AS cpu, h.mem_used_gb / h.mem_total_gb AS mem, h.net_mbps / h.net_cap_mbps AS net, CASE WHEN h.vram_total_gb > 0 THEN h.vram_used_gb / h.vram_total_gb ELSE 0 END AS vram,
 d.n AS disks, d.p AS disk_pressure, v.verdict = 'healthy' AS no_hint, CASE v.verdict WHEN 'cpu_bound' THEN concat(CAST(round(h.cpu_pct) AS BIGINT), ' % of the CPU') WHEN 'mem_pressure' THEN concat(round(h.mem_used_gb, 1), ' of ', round(h.mem_total_gb, 1), ' GB of memory') WHEN 'healthy' THEN 'room everywhere' END AS detail
 FROM ({_VERDICTS}) v JOIN host_hours h ON h.ts = v.ts LEFT JOIN (SELECT ts, count(*) AS n, round(sum(least(greatest(mbps / ceiling_mbps, util_pct / 100), 1)), 9) AS p FROM disk_hours GROUP BY 1) d ON d.ts = v.ts""")
def bottleneck_report(hosts, disks):
    out = detect.bottleneck(_with_disks(hosts, disks), report=True)
    names = F.filter(F.map_keys("pressures"), lambda k: F.startswith(k, F.lit("disk:")))
    total = F.aggregate(F.sort_array(names), F.lit(0.0), lambda a, k: a + F.element_at("pressures", k))
    told = F.when(F.col("verdict").isin("cpu_bound", "mem_pressure", "healthy"), F.col("detail"))
    parts = [F.element_at("pressures", F.lit(c)).alias(c) for c in ("cpu", "mem", "net", "vram")]
    return out.select("ts", "verdict", *parts, F.nullif(F.size(names), F.lit(0)).cast("long").alias("disks"), F.when(F.size(names) > 0, F.round(total, 9)).alias("disk_pressure"), (F.col("hint") == "").alias("no_hint"), told.alias("detail"))


@add("host_hours disk_hours", f"SELECT arg_min(verdict, ts) AS verdict, min(ts) AS begin_ts, max(ts) AS end_ts, count(*) AS samples FROM (SELECT ts, verdict, sum(CASE WHEN verdict IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT ts, verdict, lag(verdict) OVER (ORDER BY ts) AS before FROM ({_VERDICTS}))) GROUP BY turn")
def detect_bottleneck(hosts, disks):
    return detect.newest_verdicts(detect.bottleneck(_with_disks(hosts, disks)).withColumn("host", F.lit("all")), ["host"]).drop("host")


@add("utils", "SELECT gate, min(ts) AS begin_ts, min(CASE WHEN ts - b >= 1800 THEN ts END) AS fire_ts, max(ts) AS end_ts, count(*) FILTER (WHERE ts - b >= 1800) AS firings FROM (SELECT *, min(ts) OVER (PARTITION BY gate, spell) AS b FROM (SELECT gate, ts, u <= 40 AS ok, sum(CASE WHEN u <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY gate ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM (SELECT concat('gate', CAST(CAST(substr(disk, 5) AS BIGINT) % 3 AS VARCHAR)) AS gate, ts, max(util_pct) AS u FROM utils GROUP BY 1, 2)) WHERE ok) GROUP BY gate, spell HAVING count(*) FILTER (WHERE ts - b >= 1800) > 0")
def idle_windows(s):
    return _idle_windows(s)


def _idle_windows(s, rows=None):
    gates = s.select("disk").distinct().withColumn("gate", F.concat(F.lit("gate"), (F.substring("disk", 5, 9).cast("long") % 3).cast("string")))
    return detect.idle_windows(s, gates, 40, rows=rows)


_CLASSED = "SELECT runner_id, ts, seq, CASE WHEN status <> 'error' OR lower(trim(error)) IN ('timeout', 'pool_reset') THEN 'ok' WHEN lower(error) LIKE '%nt_status_logon_failure%' OR lower(error) LIKE '%permissionerror%' THEN 'permanent' ELSE 'transient' END AS class, CASE WHEN lower(error) LIKE '%nt_status_logon_failure%' THEN 'nt_status_logon_failure' WHEN lower(error) LIKE '%permissionerror%' THEN 'permissionerror' ELSE error END AS sig, row_number() OVER (PARTITION BY runner_id ORDER BY ts, seq) AS n FROM (SELECT * FROM results WHERE status <> 'ok')"


@add("results", f", r AS ({_CLASSED}), w AS (SELECT a.runner_id, a.n, b.sig, count(*) FILTER (WHERE b.class <> 'ok') AS f, count(*) AS c, count(*) FILTER (WHERE b.n > a.n - 3 AND b.class = 'permanent') AS p FROM r a JOIN r b ON a.runner_id = b.runner_id AND b.n BETWEEN a.n - 19 AND a.n GROUP BY 1, 2, 3), g AS (SELECT runner_id, n, max(f) AS top, CAST(sum(f) AS BIGINT) AS failed, CAST(sum(c) AS BIGINT) AS seen, sum(p) AS hard FROM w GROUP BY 1, 2), t AS (SELECT *, CASE WHEN hard = 3 THEN 'permanent_run' WHEN seen >= 5 AND 2 * failed >= seen AND 5 * top >= 4 * failed THEN 'same_failure' END AS reason FROM g) SELECT runner_id, ts, seq, seen, failed, reason FROM t JOIN r USING (runner_id, n) WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY runner_id ORDER BY n) = 1")
def failure_storms(res):
    return detect.failure_storms(res.where("status <> 'ok'"))


@add("manifest", "SELECT u.\"check\", u.value, coalesce(u.ok, false) AS ok, CASE WHEN coalesce(u.ok, false) THEN '' ELSE u.issue END AS issue FROM (SELECT [{'check': 'format', 'value': matched / CAST(files AS DOUBLE), 'ok': matched >= 0.9 * files, 'issue': concat(CAST(floor(100 * matched / CAST(files AS DOUBLE)) AS BIGINT), ' % of the files match a rule')}, {'check': 'coverage', 'value': matched / CAST(files AS DOUBLE), 'ok': matched = files, 'issue': concat(files - matched, ' files match no rule')}, {'check': 'distribution', 'value': top, 'ok': disks > 1 AND top <= 0.6, 'issue': CASE WHEN disks > 1 THEN concat('one disk holds ', CAST(floor(100 * top) AS BIGINT), ' % of the bytes') ELSE concat(disks, ' disk in use') END}, {'check': 'balance', 'value': skew, 'ok': skew <= 3, 'issue': concat('the largest shard is ', CAST(floor(10 * skew) AS BIGINT), ' tenths of the smallest')}] AS l FROM (SELECT sum(n) AS files, sum(n) FILTER (WHERE disk IS NOT NULL) AS matched, count(disk) AS disks, max(b) FILTER (WHERE disk IS NOT NULL) / CAST(sum(b) FILTER (WHERE disk IS NOT NULL) AS DOUBLE) AS top FROM (SELECT CASE WHEN size % 11 <> 0 THEN size % 3 END AS disk, count(*) AS n, sum(size) AS b FROM manifest GROUP BY 1)) x, (SELECT max(b) / CAST(min(b) AS DOUBLE) AS skew FROM (SELECT split_part(rel_path, '/', 1) AS s, sum(size) AS b FROM manifest GROUP BY 1))) , unnest(l) AS t(u)")
def readiness(man):
    return detect.readiness(telemetry.assess_layout(man), man.withColumn("disk", F.when(F.col("size") % 11 != 0, F.col("size") % 3)))


_GREEDY = """, f AS (SELECT rel_path, coalesce(size, 0) AS size, row_number() OVER (ORDER BY coalesce(size, 0) DESC, rel_path) AS k FROM manifest),
 g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(0 AS BIGINT) AS shard
 UNION ALL SELECT f.k, list_transform(generate_series(1, 7), lambda i: g.loads[i] + CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN f.size ELSE 0 END), list_position(g.loads, list_min(g.loads)) FROM g JOIN f ON f.k = g.k + 1)"""


@add("manifest", f"{_GREEDY} SELECT rel_path, size, shard FROM g JOIN f USING (k)")
def shard_plan(man):
    return shards.shard_plan(man, 7)


@add("manifest", f"{_GREEDY} SELECT shard, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, 100.0 * sum(size) / sum(sum(size)) OVER () AS percent, max(sum(size)) OVER () / avg(sum(size)) OVER () AS skew FROM g JOIN f USING (k) GROUP BY shard")
def shard_summary(man):
    return shards.shard_summary(shards.shard_plan(man, 7))


_ARC = "acos(least(abs(dot), 1.0e0))"
_MIX = ", ".join(f"wa * q{c} + wb * p{c} AS m{c}" for c in "wxyz")
_NORM = "sqrt(mw * mw + mx * mx + my * my + mz * mz)"


@add("clip_frames", f""", f AS (SELECT *, min(t) OVER p AS t0, max(t) OVER p AS t1, count(*) OVER p AS frames, lead(t) OVER o AS nt, lead(qw) OVER o AS nw, lead(qx) OVER o AS nx, lead(qy) OVER o AS ny, lead(qz) OVER o AS nz, lead(valid) OVER o AS nv
 FROM clip_frames WINDOW p AS (PARTITION BY clip_id, joint), o AS (PARTITION BY clip_id, joint ORDER BY t)),
 g AS (SELECT clip_id, joint, fps, k, least(t0 + k / fps, t1) AS ts FROM (SELECT DISTINCT clip_id, joint, t0, t1, fps, unnest(range(CAST(greatest(1, floor((t1 - t0) * fps + 1e-9) + 1) AS BIGINT))) AS k FROM f, (VALUES (8.0e0), (12.0e0)) AS x(fps))),
 h AS (SELECT g.*, CASE WHEN nt - t > 1e-8 THEN (ts - t) / (nt - t) ELSE 0.0e0 END AS u, qw, qx, qy, qz, coalesce(nw, qw) AS pw, coalesce(nx, qx) AS px, coalesce(ny, qy) AS py, coalesce(nz, qz) AS pz, frames = 1 OR (valid AND coalesce(nv, valid)) AS valid
 FROM g JOIN f USING (clip_id, joint) WHERE ts >= t AND (nt IS NULL OR ts < nt)), d AS (SELECT *, qw * pw + qx * px + qy * py + qz * pz AS dot FROM h),
 e AS (SELECT *, CASE WHEN sin({_ARC}) < 1e-6 THEN 1 - u ELSE sin((1 - u) * {_ARC}) / sin({_ARC}) END AS wa, CASE WHEN dot < 0 THEN -1 ELSE 1 END * CASE WHEN sin({_ARC}) < 1e-6 THEN u ELSE sin(u * {_ARC}) / sin({_ARC}) END AS wb FROM d),
 m AS (SELECT *, {_MIX} FROM e) SELECT clip_id, joint, fps, k, round(ts, 6) AS t, {", ".join(f"round(CASE WHEN mw < 0 THEN -1 ELSE 1 END * m{c} / {_NORM}, 6) + 0.0e0 AS q{c}" for c in "wxyz")}, valid FROM m""")
def resample_slerp(frames):
    out = resample.resample_slerp(frames, [8.0, 12.0])
    return out.select("clip_id", "joint", "fps", "k", F.round("t", 6).alias("t"), *((F.round(c, 6) + 0.0).alias(c) for c in ("qw", "qx", "qy", "qz")), "valid")


def _at(df, ts="ts"):
    return df.withColumn("at", F.timestamp_seconds(ts))


@add("results", "SELECT ts - ts % 3600 AS begin_ts, host, count(*) AS n FROM results WHERE status = 'ok' GROUP BY 1, 2")
def stream_throughput(res):
    return flows.throughput(_at(res.where("status = 'ok'")), "1 hour", by=["host"])


@add("results", "SELECT ts - ts % 1800 - 1800 * k AS begin_ts, host, count(*) AS n FROM results, (VALUES (0), (1)) AS x(k) WHERE status = 'ok' GROUP BY 1, 2")
def stream_throughput_sliding(res):
    return flows.throughput(_at(res.where("status = 'ok'")), "1 hour", "30 minutes", ["host"])


@add("heartbeats", "SELECT runner_id, min(last_seen) AS begin_ts, max(last_seen) + 7200 AS end_ts, count(*) AS beats FROM (SELECT *, sum(fresh) OVER (PARTITION BY runner_id ORDER BY last_seen, seq ROWS UNBOUNDED PRECEDING) AS spell FROM (SELECT *, CASE WHEN last_seen - lag(last_seen) OVER (PARTITION BY runner_id ORDER BY last_seen, seq) <= 7200 THEN 0 ELSE 1 END AS fresh FROM heartbeats)) GROUP BY runner_id, spell")
def stream_runner_sessions(beats):
    return flows.runner_sessions(_at(beats, "last_seen"), "2 hours")


@add("runner_progress", f"SELECT *, coalesce(base > 0 AND coalesce(recent, 0) < 0.9 * base, false) AS plateau FROM (SELECT runner, {', '.join(f'(max(done) FILTER (WHERE {c}) - min(done) FILTER (WHERE {c})) / CAST(nullif(max(ts) FILTER (WHERE {c}) - min(ts) FILTER (WHERE {c}), 0) AS DOUBLE) AS {n}' for n, c in (('recent', f'{EVENTS_NOW} - ts <= {5 * DAY}'), ('base', f'{EVENTS_NOW} - ts BETWEEN {10 * DAY} AND {25 * DAY}')))} FROM runner_progress GROUP BY 1)")
def plateau(s):
    return telemetry.plateau(s, EVENTS_NOW, "runner", 5 * DAY, 10 * DAY, 25 * DAY, 0.9)


_BATCH = """, c AS (SELECT disk, sum(budget) AS cap FROM budgets GROUP BY 1), h AS (SELECT disk, count(*) AS inflight FROM ledger WHERE state = 'leased' GROUP BY 1), g AS (SELECT disk, cap, coalesce(inflight, 0) AS inflight, greatest(0, cap - coalesce(inflight, 0)) AS free FROM c LEFT JOIN h USING (disk)),
 p AS (SELECT item_id, l.disk, created_at, g.disk AS stream, free FROM ledger l LEFT JOIN g ON l.disk = g.disk WHERE state = 'pending'), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY created_at, item_id) AS turn FROM p), s AS (SELECT stream, created_at AS seen, item_id AS seen_id FROM r WHERE turn = 1),
 b AS (SELECT r.item_id, r.disk, turn FROM r JOIN s ON r.stream IS NOT DISTINCT FROM s.stream WHERE turn <= 500 AND (r.stream IS NULL OR turn <= free) ORDER BY turn, r.stream IS NULL, seen, seen_id LIMIT 500)"""


@add("ledger budgets", _BATCH + " SELECT * FROM b")
def balanced_batch(led, budgets):
    return joins.balanced_batch(led, budgets.groupBy("disk").agg(F.sum("budget").alias("cap")), 500)


@add("manifest", "SELECT shard, CAST(greatest(1, ceil(CAST(weight AS DOUBLE) * 100 / sum(weight) OVER ())) AS BIGINT) AS quota FROM (SELECT split_part(rel_path, '/', 1) AS shard, sum(size) AS weight FROM manifest GROUP BY 1)")
def proportional_quota(man):
    return joins.proportional_quota(telemetry.assess_layout(man).withColumnRenamed("bytes", "weight"), 100).select("shard", "quota")


@add("ledger jobs", ", l AS (SELECT item_id AS subjob_id, CASE WHEN attempts % 2 = 0 THEN job END AS job, disk, created_at FROM ledger) SELECT coalesce(l.job, regexp_extract(subjob_id, '^(.+)/[^/]*$', 1)) AS job, subjob_id, disk, created_at, label AS job_label FROM l LEFT JOIN jobs j ON coalesce(l.job, regexp_extract(subjob_id, '^(.+)/[^/]*$', 1)) = j.job")
def normalize_legacy(led, jobs):
    old = led.select(F.col("item_id").alias("job_id"), F.when(F.col("attempts") % 2 == 0, F.col("job")).alias("grp"), "disk", "created_at")
    return files.normalize_legacy(old, jobs.select(F.col("job").alias("grp"), "label", F.lit(0).alias("created_at")))


_CHAIN = "SELECT {k}, min(struct_pack(ts := ts, seq := seq)) AS x FROM {e} GROUP BY {k} UNION ALL SELECT {k}, min(struct_pack(ts := {e}.ts, seq := {e}.seq)) FROM c JOIN {e} USING ({k}) WHERE {e}.ts >= c.x.ts + 21600 GROUP BY {k}, c.x"


@add("results", f", e AS (SELECT * FROM results WHERE status = 'error'), c AS ({_CHAIN.format(k='host', e='e')}) SELECT host, x.ts AS ts, x.seq AS seq FROM c")
def throttle(res):
    return folds.throttle(res.where("status = 'error'"), "host", 21600)


@add("results", _FOLDED.format(start="0", lease="1"))
def stream_ledger(res):
    """Every result follows a lease; the state after the last event of each item."""
    leases = res.withColumns({"seq": F.col("seq") * 2, "status": F.lit("lease"), "error": F.lit(None).cast("string")})
    out = folds.stream_ledger(leases.unionByName(res.withColumn("seq", F.col("seq") * 2 + 1)))
    return out.groupBy("item_id").agg(F.max_by(F.struct("state", "attempts", "error"), F.struct("ts", "seq")).alias("x")).select("item_id", "x.*")


_CYCLES = f""", r AS ({_CLASSED.replace(" WHERE status <> 'ok'", "")}),
 c AS (SELECT DISTINCT runner_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS past, 0 AS hard, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS wait,
 CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS change, CAST(NULL AS VARCHAR) AS error FROM r
 UNION ALL SELECT runner_id, n, CASE WHEN change = 'closed' THEN [] ELSE past END, CASE WHEN change = 'closed' THEN 0 ELSE hard END, CASE WHEN change = 'closed' THEN NULL WHEN change IS NULL THEN opened ELSE ts END,
 CASE change WHEN 'closed' THEN NULL WHEN 'opened' THEN {DAY // 4} WHEN 'reopened' THEN least(2 * wait, {4 * DAY}) ELSE wait END, ts, seq, change, CASE WHEN change = 'reopened' OR change = 'opened' AND hard >= 3 THEN sig WHEN change = 'opened' THEN list_aggregate(bad, 'mode') END
 FROM (SELECT *, CASE WHEN opened IS NULL THEN CASE WHEN hard >= 3 OR len(past) >= 5 AND len(bad) > 0 AND 2 * len(bad) >= len(past) AND 5 * len(list_filter(bad, lambda x: x = list_aggregate(bad, 'mode'))) >= 4 * len(bad) THEN 'opened' END
 WHEN ts - opened >= wait THEN CASE WHEN class = 'ok' THEN 'closed' ELSE 'reopened' END END AS change FROM (SELECT *, list_filter(past, lambda x: x IS NOT NULL) AS bad FROM (
 SELECT r.runner_id, r.n, r.ts, r.seq, r.class, r.sig, c.opened, c.wait, list_append(CASE WHEN len(c.past) >= 20 THEN c.past[2:] ELSE c.past END, CASE WHEN r.class <> 'ok' THEN r.sig END) AS past,
 CASE WHEN r.class = 'permanent' THEN c.hard + 1 ELSE 0 END AS hard FROM c JOIN r ON r.runner_id = c.runner_id AND r.n = c.n + 1) a) b) d)"""


@add("results", f"{_CYCLES} SELECT runner_id, ts, seq, change, error, coalesce(wait, {DAY // 4}) AS cooldown_s FROM c WHERE change IS NOT NULL")
def storm_cycles(res):
    return folds.storm_cycles(res, cooldown_s=DAY // 4, longest_s=4 * DAY)


_SPELLS = "SELECT *, min(ts) FILTER (WHERE lit) OVER (PARTITION BY disk, spell) AS b FROM (SELECT disk, ts, util_pct >= 20 AS lit, sum(CASE WHEN util_pct >= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY disk ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM utils)"


@add("utils", f""", s AS ({_SPELLS}), f AS (SELECT disk, spell, ts FROM s WHERE lit AND ts - b >= 1800), c AS (SELECT disk, spell, min(ts) AS ts, 'fire' AS event FROM f GROUP BY 1, 2
 UNION ALL SELECT disk, spell, min(f.ts), 'refire' FROM c JOIN f USING (disk, spell) WHERE f.ts >= c.ts + 7200 GROUP BY disk, spell, c.ts)
 SELECT disk, ts, event FROM c UNION ALL SELECT s.disk, s.ts, 'resolve' FROM s JOIN (SELECT DISTINCT disk, spell + 1 AS spell FROM f) g USING (disk, spell) WHERE NOT s.lit""")
def alert_events(s):
    return folds.alert_events(s.withColumn("on", F.col("util_pct") >= 20), "disk", 1800, 7200)


def _done(up: str, down: str) -> str:
    return f"SELECT DISTINCT {_KEY} AS key FROM ledger WHERE job = 'seg/{up}' AND state = 'done' AND {_KEY} NOT IN (SELECT {_KEY} FROM ledger WHERE job = 'seg/{down}')"


@add("ledger manifest", f"""SELECT 'MACHINERY' AS stage, concat('seg/MACHINERY/', key, '.npz') AS item_id, concat('{{"src":"in/', key, '.npz","fps":30}}') AS spec FROM ({_done('BUILDING', 'MACHINERY')})
 UNION ALL SELECT 'HOUSEHOLD', concat('h-', key), '{{}}' FROM ({_done('FURNITURE', 'HOUSEHOLD')}) WHERE EXISTS (SELECT 1 FROM manifest WHERE rel_path = (SELECT min(rel_path) FROM manifest WHERE rel_path LIKE '%/doc_7.txt'))
 UNION ALL SELECT 'AUTOMOBILE', NULL, NULL FROM ledger WHERE job = 'seg/BUILDING' AND state = 'done' HAVING count(*) >= 20""")
def pipeline_tick(led, man):
    """Files are named by their base names: HOUSEHOLD waits for doc_7.txt, which exists, and FURNITURE for one that does not."""
    part = lambda name, *rest: stages.Stage(led.where(F.col("job") == f"seg/{name}"), *rest)
    all_ = {"BUILDING": part("BUILDING"), "MACHINERY": part("MACHINERY", "seg/MACHINERY/{clip}", {"src": "in/{clip}", "fps": 30}), "HOUSEHOLD": part("HOUSEHOLD", "h-{stem}"), "FURNITURE": part("FURNITURE", "f-{stem}"), "AUTOMOBILE": part("AUTOMOBILE")}
    edges = [
        stages.Edge("BUILDING", "MACHINERY", "each"), stages.Edge("FURNITURE", "HOUSEHOLD", "each"), stages.Edge("BUILDING", "HOUSEHOLD", "artifact", 0, ("doc_7.txt",)),
        stages.Edge("BUILDING", "FURNITURE", "each"), stages.Edge("BUILDING", "FURNITURE", "artifact", 0, ("doc_none.txt",)), stages.Edge("BUILDING", "AUTOMOBILE", "quorum", 20), stages.Edge("MACHINERY", "AUTOMOBILE", "all"),
    ]
    return stages.pipeline_tick(all_, edges, man.select(F.regexp_extract("rel_path", "([^/]*)$", 1).alias("rel_path")))


@add("firings resolves", """, f AS (SELECT *, coalesce(nullif(fingerprint, ''), concat(code, ':', coalesce(nullif(disk, ''), '*'))) AS fp, ts * 100000000 + seq AS o FROM firings),
 g AS (SELECT fp, arg_min_null(code, o) AS code, arg_min_null(disk, o) AS disk, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts, max(o) AS o, arg_max(severity, o) AS severity, arg_max(detail, o) AS detail, arg_max(action, o) AS action,
 arg_max(nullif(url, ''), o) AS url, arg_max(nullif(origins, ''), o) AS origins FROM f GROUP BY 1), r AS (SELECT fingerprint AS fp, max(ts * 100000000 + seq) AS e FROM resolves GROUP BY 1)
 SELECT fp AS fingerprint, code, disk, count, first_ts, last_ts, severity, detail, action, url, origins, coalesce(o > e, true) AS active FROM g LEFT JOIN r USING (fp) ORDER BY o DESC LIMIT 20""")
def dedup_alerts(firings, resolves):
    return advice.dedup_alerts(firings, resolves, 20)


@add("profiles", """SELECT item_id, round(avg(cpu_pct), 1) AS cpu_pct_mean, round(max(cpu_pct), 1) AS cpu_pct_peak, round(max(rss_bytes) / 1e6, 1) AS rss_peak_mb, round((arg_max(read_bytes, o) - arg_min(read_bytes, o)) / 1e6, 1) AS read_mb,
 round((arg_max(write_bytes, o) - arg_min(write_bytes, o)) / 1e6, 1) AS write_mb, max(ts) - min(ts) AS wall_s, count(*) AS samples FROM (SELECT *, ts * 100000000 + seq AS o FROM profiles) GROUP BY 1""")
def profile_fold(samples):
    return telemetry.profile_fold(samples)


@add("samples budgets", """, d AS (SELECT disk FROM samples UNION SELECT disk FROM budgets), s AS (SELECT disk, min(concurrency) FILTER (WHERE mbps >= 0.85 * peak) AS suggested, arg_max(concurrency, mbps) AS peak_concurrency, round(max(mbps), 6) AS peak
 FROM (SELECT *, max(mbps) OVER (PARTITION BY disk) AS peak FROM samples) GROUP BY 1) SELECT disk, coalesce(suggested, 4) AS suggested, peak, peak_concurrency FROM d LEFT JOIN s USING (disk)""")
def suggest_conservative(s, budgets):
    disks = s.select("disk").union(budgets.select("disk"))
    return telemetry.suggest_concurrency(s, "conservative", disks).withColumn("peak", F.round("peak", 6))


@add("diskstat_lines", """SELECT concat('sd', CAST(user_id % 7 AS VARCHAR)) AS device, CASE WHEN user_id % 7 < 3 THEN concat('disk', CAST(user_id % 7 AS VARCHAR)) ELSE concat('sd', CAST(user_id % 7 AS VARCHAR)) END AS disk,
 event_id * 3 AS read_sectors, event_id * 5 AS write_sectors, event_id * 7 AS io_ms FROM events WHERE event_id % 10 <> 0""")
def parse_diskstats(lines):
    devices = lines.sparkSession.range(3).select(F.concat(F.lit("sd"), "id").alias("device"), F.concat(F.lit("disk"), "id").alias("disk"))
    return telemetry.parse_diskstats(lines, devices)


@add("marks", f"""SELECT item_id, CAST(pid AS BIGINT) AS pid, {EVENTS_NOW} - CAST(started AS DOUBLE) AS elapsed_s FROM marks WHERE item_id <> '' AND started <> 'soon' AND pid <> 'x' AND {EVENTS_NOW} - CAST(started AS DOUBLE) > {10 * DAY}""")
def stuck_items(marks):
    return ledger.stuck_items(marks, EVENTS_NOW, 10 * DAY).select("item_id", "pid", "elapsed_s")


_DISKS = (advice.Disk("disk1", "shard_1", "hdd", "//nas1/disk1_direct", "//nas1/pool", "/mnt/disk1", True), advice.Disk("fast", "", "nvme", "", "//nas4/fast"))
_AT = "CASE WHEN item_id LIKE '%shard_1%' THEN 'disk1' WHEN {x} LIKE '//nas1/disk1_direct/%' OR {x} LIKE '//nas1/pool/%' OR {x} LIKE '/mnt/disk1/%' THEN 'disk1' WHEN {x} LIKE '//nas4/fast/%' THEN 'fast' END"
_TOKEN = f"CASE c {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in advice.BLOCKING.items())} END"


@add("io_items", f""", a AS (SELECT *, rtrim(lower(coalesce(read_root, '')), '/') AS r, lower(write_root) AS w FROM io_items), b AS (SELECT *, {_AT.format(x='r')} AS i, {_AT.format(x='w')} AS o, regexp_extract(r, '^//([^/]+)/', 1) AS rs, regexp_extract(w, '^//([^/]+)/', 1) AS ws FROM a),
 c AS (SELECT item_id, ack, list_filter([CASE WHEN rs = 'nas2' THEN 'smb.brokered' END, CASE WHEN rs NOT IN ('', 'nas1', 'nas2') THEN 'smb.no_creds' END, CASE WHEN ws = 'nas2' AND rs <> ws THEN 'smb.brokered' END, CASE WHEN ws NOT IN ('', 'nas1', 'nas2') AND rs <> ws THEN 'smb.no_creds' END,
 CASE WHEN i = 'disk1' THEN 'input.hdd' END, CASE WHEN i = 'fast' THEN 'input.nvme' END, CASE WHEN i = 'disk1' AND NOT (r LIKE '//nas1/disk1_direct/%' OR r LIKE '/mnt/disk1/%') AND (r LIKE '%/mnt/user%' OR r LIKE '//nas1/pool/%') THEN 'read.not_direct' END,
 CASE WHEN i IS NULL AND (rs <> '' OR sample_src IS NOT NULL) THEN 'input.unclassified_nas' END, CASE WHEN i IS NULL AND r <> '' AND rs = '' AND sample_src IS NULL THEN 'input.unknown' END, CASE WHEN o = 'disk1' THEN 'output.parity' END, CASE WHEN o = 'fast' THEN 'output.nvme' END,
 CASE WHEN o = 'disk1' AND w LIKE '/mnt/disk1/%' THEN 'output.direct_disk_write' END, CASE WHEN o IS NULL AND ws <> '' THEN 'output.unclassified_nas' END], lambda x: x IS NOT NULL) AS codes FROM b),
 g AS (SELECT *, list_filter(codes, lambda c: {_TOKEN} <> ack) AS reasons FROM c)
 SELECT item_id, array_to_string(codes, ',') AS codes, CASE WHEN len(list_filter(codes, lambda c: c IN ('smb.no_creds', 'input.hdd', 'read.not_direct', 'input.unclassified_nas', 'output.parity', 'output.direct_disk_write', 'output.unclassified_nas'))) > 0 THEN 'warn' ELSE 'ok' END AS severity,
 len(reasons) > 0 AS blocked, array_to_string(list_sort(list_distinct(list_transform(reasons, lambda c: {_TOKEN}))), ',') AS needed, len(reasons) < len(list_filter(codes, lambda c: {_TOKEN} IS NOT NULL)) AS used FROM g""")
def advise_io(items):
    servers = items.sparkSession.range(2).select(F.concat(F.lit("nas"), F.col("id") + 1).alias("server"), (F.col("id") == 0).alias("have_creds"), (F.col("id") == 1).alias("brokered"))
    out = advice.gate_io(advice.advise_io(items.withColumn("acks", F.array("ack")), _DISKS, servers), "acks")
    return out.select("item_id", F.array_join(F.transform("findings", lambda x: x["code"]), ",").alias("codes"), "severity", "blocked", F.array_join(F.sort_array("needed"), ",").alias("needed"), (F.size("acknowledged") > 0).alias("used"))


@add("ledger", "SELECT item_id, CASE WHEN disk IS NULL AND item_id LIKE '%BUILDING%' THEN 'disk2' ELSE disk END AS disk, CASE WHEN coalesce(disk, CASE WHEN item_id LIKE '%BUILDING%' THEN 'disk2' END) IN ('disk1', 'disk2') AND attempts <> 1 THEN concat('/r/', coalesce(disk, 'disk2')) WHEN attempts = 1 THEN '/own' END AS read_root, CASE WHEN coalesce(disk, CASE WHEN item_id LIKE '%BUILDING%' THEN 'disk2' END) IN ('disk1', 'disk2') THEN concat('/w/', coalesce(disk, 'disk2')) ELSE NULL END AS write_root FROM ledger")
def inject_roots(led):
    topology = led.sparkSession.range(2).select(F.concat(F.lit("disk"), F.col("id") + 1).alias("disk")).select("disk", F.concat(F.lit("/r/"), "disk").alias("read"), F.concat(F.lit("/w/"), "disk").alias("write"))
    items = led.select("item_id", "disk", F.when(F.col("attempts") == 1, "/own").alias("read_root"), F.lit("").alias("write_root"))
    return joins.inject_roots(items, topology, [("disk2", "BUILDING")])


@add("ledger jobs", ", n AS (SELECT min(job) AS job, 'fresh' AS label FROM ledger WHERE job = 'seg/BUILDING' HAVING count(DISTINCT job) = 1) SELECT coalesce(n.job, j.job) AS job, coalesce(n.label, j.label) AS label FROM jobs j FULL JOIN n ON n.job = j.job")
def job_label(led, jobs):
    return ledger.upsert_by_job(jobs, joins.job_label(led.where("job = 'seg/BUILDING'"), "fresh"), "label")


@add("ledger fleet_runners", "SELECT item_id, coalesce(launch_command, '') AS launch_command, coalesce(task, '') AS task FROM ledger LEFT JOIN fleet_runners USING (runner_id)")
def attach_runner(led, runners):
    return joins.attach_runner(led, runners).select("item_id", "launch_command", "task")


@add("ledger fleet_runners", "SELECT job, string_agg(launch_command, '|' ORDER BY first, launch_command) AS commands FROM (SELECT l.job, launch_command, min(runner_id) AS first FROM ledger l JOIN fleet_runners f USING (runner_id) WHERE launch_command <> '' GROUP BY 1, 2) GROUP BY 1")
def launch_commands(led, runners):
    return joins.launch_commands(led, runners).select("job", F.array_join("commands", "|").alias("commands"))


_ORIGINS = "SELECT DISTINCT job, CASE WHEN length(job) % 2 = 0 THEN 'agent' ELSE 'shell' END AS kind, concat('a', CAST(length(job) % 3 AS {s})) AS agent_id, concat('cb', CAST(length(job) % 3 AS {s})) AS callback FROM ledger"


@add("ledger firings", f", a AS (SELECT seq AS alert_id, disk FROM firings WHERE seq % 20 = 0), o AS ({_ORIGINS.format(s='VARCHAR')}), w AS (SELECT DISTINCT disk, kind, agent_id, callback FROM ledger JOIN o USING (job) WHERE state IN ('leased', 'pending')) SELECT DISTINCT alert_id, kind, agent_id, callback FROM a JOIN w ON a.disk IS NULL OR a.disk = w.disk")
def attribute_origins(led, firings):
    size = F.length("job")
    origins = led.select("job").distinct().select("job", F.when(size % 2 == 0, "agent").otherwise("shell").alias("kind"), F.concat(F.lit("a"), size % 3).alias("agent_id"), F.concat(F.lit("cb"), size % 3).alias("callback"))
    return joins.attribute_origins(firings.where("seq % 20 = 0").select(F.col("seq").alias("alert_id"), "disk"), led, origins)


@add("firings ledger", "SELECT seq, disk FROM firings WHERE disk IS NULL OR disk IN (SELECT disk FROM ledger WHERE state = 'leased')")
def scope_alerts(firings, led):
    return joins.scope_alerts(firings.select("seq", "disk"), led.where("state = 'leased'"))


@add("heartbeats", """, f AS (SELECT host, concat('repo', CAST(max(seq) % 4 AS VARCHAR)) AS repo, CASE WHEN max(seq) % 5 <> 0 THEN concat('s', CAST(max(seq) % 2 AS VARCHAR)) END AS sha, max(seq) % 3 = 0 AS dirty FROM heartbeats GROUP BY host), r AS (SELECT concat('repo', CAST(i AS VARCHAR)) AS repo, CASE WHEN i < 4 THEN 's0' END AS sha FROM range(5) t(i))
 SELECT f.host, coalesce(f.repo, r.repo) AS repo, CASE WHEN coalesce(f.sha, '') = '' OR coalesce(r.sha, '') = '' THEN 'unverifiable' WHEN f.sha <> r.sha THEN 'stale' WHEN dirty THEN 'in_sync_dirty' ELSE 'in_sync' END AS state FROM f FULL JOIN r ON f.repo = r.repo""")
def code_drift(beats):
    n = F.max("seq")
    prints = beats.groupBy("host").agg(F.concat(F.lit("repo"), n % 4).alias("repo"), F.when(n % 5 != 0, F.concat(F.lit("s"), n % 2)).alias("sha"), (n % 3 == 0).alias("dirty"))
    return joins.code_drift(prints, beats.sparkSession.range(5).select(F.concat(F.lit("repo"), "id").alias("repo"), F.when(F.col("id") < 4, "s0").alias("sha")))


_HEALTH = f"CASE WHEN leased <= 0 AND pending <= 0 THEN 'idle' WHEN leased > 0 AND recent <= 0 AND {LEDGER_NOW} - coalesce(last_completed, last_leased) >= 600 THEN 'stalled' WHEN leased > 0 AND recent > 0 THEN 'running' WHEN pending > 0 AND leased = 0 THEN 'queued' ELSE 'active' END"


@add("ledger jobs fleet_runners", f""", r AS ({_ROLL}), w AS (SELECT job, {_RECENT} AS recent FROM ledger GROUP BY 1), d AS (SELECT job, string_agg(concat(disk, ':', CAST(n AS VARCHAR)), ',' ORDER BY disk) AS disk_inflight FROM (SELECT job, coalesce(disk, '?') AS disk, count(*) AS n FROM ledger WHERE state = 'leased' GROUP BY 1, 2) GROUP BY 1),
 u AS (SELECT job, sum(workers) AS workers, sum(tree_rss_gb) AS tree_rss_gb, max(cpu_pct) AS cpu_pct, arg_min(task, runner_id) AS task FROM fleet_runners GROUP BY 1)
 SELECT r.job, CASE WHEN failed > 0 AND pending = 0 AND leased = 0 THEN 'failed' WHEN done >= total THEN 'complete' WHEN leased > 0 THEN 'running' ELSE 'queued' END AS badge, {LEDGER_NOW} + CASE WHEN recent > 0 THEN (pending + leased) / (recent / CAST({WEEKS} AS DOUBLE)) ELSE 300.0 END AS projected_end,
 coalesce(disk_inflight, '') AS disk_inflight, workers, tree_rss_gb, cpu_pct, concat_ws('; ', 'attach missing hosts: host77', CASE {_HEALTH} WHEN 'stalled' THEN 'stop the runners that hang, then give held items back' WHEN 'queued' THEN concat('start a runner for task ', coalesce(task, ''), ' of ', r.job) WHEN 'idle' THEN 'all is done: gather the outputs' END) AS hint
 FROM r JOIN w USING (job) LEFT JOIN d USING (job) LEFT JOIN u USING (job)""")
def status_board(led, jobs, runners):
    configured = runners.select("host").union(runners.sparkSession.range(1).select(F.lit("Host77")))
    out = ledger.status_view(led, jobs, LEDGER_NOW, WEEKS, runners, configured)
    held = F.array_join(F.transform(F.map_entries("disk_inflight"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return out.select("job", "badge", "projected_end", F.coalesce(held, F.lit("")).alias("disk_inflight"), "workers", "tree_rss_gb", "cpu_pct", "hint")


_RATE = "coalesce(greatest(0.0, (arg_max(done, ts) FILTER (WHERE {c}) - arg_min(done, ts) FILTER (WHERE {c})) / CAST(nullif(max(ts) FILTER (WHERE {c}) - min(ts) FILTER (WHERE {c}), 0) AS DOUBLE)), 0.0)"


@add("runner_progress", f""", k AS (SELECT runner, ts, done FROM runner_progress UNION ALL SELECT NULL, ts, sum(done) FROM runner_progress GROUP BY ts), g AS (SELECT runner, {_RATE.format(c=f'{EVENTS_NOW} - ts <= {5 * DAY}')} AS recent, {_RATE.format(c=f'{EVENTS_NOW} - ts BETWEEN {10 * DAY} AND {25 * DAY}')} AS base, max(done) AS done FROM k WHERE ts <= {EVENTS_NOW} GROUP BY 1),
 a AS (SELECT base AS all_base, done AS all_done FROM g WHERE runner IS NULL), s AS (SELECT *, CASE WHEN all_base > 0 THEN base / all_base WHEN base > 0 THEN 1.0 ELSE 0.0 END AS share FROM g, a WHERE all_done < 1000000000) SELECT runner, recent, base, share, base > 0 AND recent < 0.9 * base AND (runner IS NULL OR share >= 0.08) AS plateau FROM s""")
def plateau_report(s):
    return telemetry.plateau_report(s, EVENTS_NOW, 1_000_000_000, 5 * DAY, 10 * DAY, 25 * DAY, 0.9, 0.08)


@add("ledger budgets", _BATCH + """, n AS (SELECT disk, count(*) AS granted_here FROM b GROUP BY 1), t AS (SELECT (SELECT count(*) FROM b) AS granted, (SELECT count(*) FROM ledger WHERE state = 'pending') AS pending_total)
 SELECT g.disk, cap AS budget, inflight AS inflight_before, free, coalesce(granted_here, 0) AS granted_here, granted, pending_total, CASE WHEN pending_total = 0 THEN 'NO_PENDING' WHEN granted >= 900 THEN 'GRANTED_FULL' WHEN granted >= 500 THEN 'FAIR_SHARE_CAP' WHEN granted < pending_total THEN 'DISK_BUDGET_FULL' ELSE 'GRANTED_FULL' END AS reason
 FROM g LEFT JOIN n USING (disk), t""")
def batch_report(led, budgets):
    caps = budgets.groupBy("disk").agg(F.sum("budget").alias("cap"))
    return joins.batch_report(led, caps, joins.balanced_batch(led, caps, 500), 900, 500)


@add("utils", """, l AS (SELECT concat('gate', CAST(CAST(substr(disk, 5) AS BIGINT) % 3 AS VARCHAR)) AS gate, ts, max(CASE WHEN CAST(util_pct AS BIGINT) % 4 >= 2 THEN util_pct END) AS cur_util FROM utils GROUP BY 1, 2),
 s AS (SELECT *, count(*) FILTER (WHERE cur_util > 40) OVER (PARTITION BY gate ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM l), q AS (SELECT *, CASE WHEN cur_util <= 40 THEN ts - min(ts) FILTER (WHERE cur_util <= 40) OVER (PARTITION BY gate, spell ORDER BY ts ROWS UNBOUNDED PRECEDING) ELSE 0 END AS quiet_for_s FROM s)
 SELECT gate, ts, cur_util IS NULL OR (cur_util <= 40 AND quiet_for_s >= 1800) AS admit, CASE WHEN cur_util IS NULL THEN 'NO_TELEMETRY' WHEN cur_util <= 40 AND quiet_for_s >= 1800 THEN 'OPEN' ELSE 'WAIT' END AS reason, cur_util, quiet_for_s FROM q""")
def idle_gate(s):
    gates = s.select("disk").distinct().withColumn("gate", F.concat(F.lit("gate"), (F.substring("disk", 5, 9).cast("long") % 3).cast("string")))
    return detect.idle_gate(s.withColumn("samples", F.col("util_pct").cast("long") % 4), gates, 40, sustain_min=30)


@add("host_hours disk_hours", f""", v AS ({_VERDICTS}), t AS (SELECT ts, verdict, CASE verdict WHEN 'disk_at_ceiling' THEN hot WHEN 'nas_single_spindle' THEN warm END AS disk, sum(CASE WHEN verdict IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS turn FROM (SELECT *, lag(verdict) OVER (ORDER BY ts) AS before FROM v)),
 b AS (SELECT *, min(ts) OVER (PARTITION BY turn) AS begin_ts FROM t WHERE verdict <> 'healthy') SELECT 'all' AS host, min(verdict) AS verdict, CASE min(verdict) {' '.join(f"WHEN '{v}' THEN '{c}'" for v, (c, _) in detect.BOTTLENECKS.items())} END AS code, CASE min(verdict) {' '.join(f"WHEN '{v}' THEN '{x}'" for v, (_, x) in detect.BOTTLENECKS.items())} END AS severity,
 arg_max_null(disk, ts) AS disk, min(begin_ts) AS begin_ts, min(ts) FILTER (WHERE ts - begin_ts >= 21600) AS fire_ts, max(ts) AS end_ts, count(*) FILTER (WHERE ts - begin_ts >= 21600) AS firings FROM b GROUP BY turn HAVING count(*) FILTER (WHERE ts - begin_ts >= 21600) > 0""")
def bottleneck_alerts(hosts, disks):
    return detect.bottleneck_alerts(detect.bottleneck(_with_disks(hosts, disks)).withColumn("host", F.lit("all")), ["host"], 21600)


@add("runner_progress", """, d AS (SELECT runner, ts, CAST(done - lag(done) OVER (PARTITION BY runner ORDER BY ts) AS DOUBLE) AS n FROM runner_progress), r AS (SELECT *, CASE WHEN n % 3 > 0 THEN n END AS good FROM d), k AS (SELECT *, count(good) OVER (PARTITION BY runner ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i, max(good) OVER (PARTITION BY runner ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r)
 SELECT runner, ts, coalesce(first_value(good) OVER w, 0.0) AS observed, CASE WHEN i > 0 THEN coalesce(first_value(m) OVER w, first_value(good) OVER w) ELSE 0.0 END AS expected FROM k WINDOW w AS (PARTITION BY runner, i ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def expected_rate(s):
    n = F.col("done") - F.lag("done").over(Window.partitionBy("runner").orderBy("ts"))
    rates = s.withColumn("n", n.cast("double")).withColumn("rate", F.when(F.col("n") % 3 > 0, F.col("n")).otherwise(0.0))
    return detect.with_expected(rates, "rate", ["runner"]).select("runner", "ts", "observed", "expected")


@add("marks", f"SELECT item_id, min({EVENTS_NOW} - CAST(started AS DOUBLE)) AS elapsed_s FROM marks WHERE item_id <> '' AND started <> 'soon' AND {EVENTS_NOW} - CAST(started AS DOUBLE) <= {10 * DAY} GROUP BY 1")
def inflight_items(marks):
    return ledger.inflight_items(marks, EVENTS_NOW, 10 * DAY)


@add("fleet_runners", "SELECT runner_id, CASE WHEN launch_command = '' THEN '--token=***' ELSE concat(launch_command, ' --password *** --x') END AS command FROM fleet_runners")
def mask_flags(runners):
    raw = F.when(F.col("launch_command") == "", F.concat(F.lit("--token="), "runner_id")).otherwise(F.concat("launch_command", F.lit(" --password "), "host", F.lit(" --x")))
    return runners.select("runner_id", expr.mask_flags(raw).alias("command"))


@add("heartbeats", ", v AS (SELECT DISTINCT host, concat('pkg', CAST(workers % 4 AS VARCHAR)) AS package, CAST(workers % 3 AS VARCHAR) AS version FROM heartbeats), r AS (SELECT concat('pkg', CAST(i AS VARCHAR)) AS package, '1' AS wanted FROM range(2, 6) t(i)) SELECT host, package, version, wanted, coalesce(version = wanted, false) AS matches FROM v FULL JOIN r USING (package)")
def version_drift(beats):
    versions = beats.select("host", F.concat(F.lit("pkg"), F.col("workers") % 4).alias("package"), (F.col("workers") % 3).cast("string").alias("version")).distinct()
    return joins.version_drift(versions, beats.sparkSession.range(2, 6).select(F.concat(F.lit("pkg"), "id").alias("package"), F.lit("1").alias("version")))


# The same operators with keys of more than so many rows split into spans: the rows are those of the plain queries.
for _name, _views, _split in (
    ("rolling_io", "disk_samples", lambda s: telemetry.rolling_io(s, rows=500)), ("rate_series", "runner_progress", lambda s: telemetry.rate_series(s, "done", ["runner"], rows=50)),
    ("sustained", "disk_samples", lambda s: _sustained(s, 500)), ("idle_windows", "utils", lambda s: _idle_windows(s, 500)),
):
    add(_views, None, f"{_name}_by_spans")(_split)
    _SQL[f"{_name}_by_spans"] = _SQL[_name]


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
