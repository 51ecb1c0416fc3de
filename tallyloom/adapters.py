"""The driver's tables in the shapes the operators take. Each text is SQL for both engines but for {t:name} (a table),
{sec:x} (a timestamp as whole epoch seconds) and {at:x,i} (an array's element i, from 1); times are epoch seconds throughout."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.spans import Spans

LEDGER_NOW, EVENTS_NOW, DAY = 999302400, 1706659200, 86400  # 2001-09-01 and 2024-01-31, UTC

VIEWS = {
    "ledger": """SELECT concat('seg/', c_mktsegment, '/', CAST(o_orderkey AS STRING), '.npz') AS item_id,
 concat('seg/', c_mktsegment) AS job, CASE WHEN c_nationkey % 7 <> 6 THEN concat('disk', CAST(1 + c_nationkey % 7 AS STRING)) END AS disk,
 CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderkey % 2 = 0 THEN 'leased' ELSE 'failed' END AS state,
 CASE WHEN o_orderstatus <> 'O' THEN concat('host', CAST(o_custkey % 5 AS STRING)) END AS host,
 CASE WHEN o_orderstatus <> 'O' THEN concat('r', CAST(o_custkey % 11 AS STRING)) END AS runner_id,
 CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 + o_orderkey % 4 END AS attempts, {sec:o_orderdate} AS created_at,
 CASE WHEN o_orderstatus <> 'O' THEN {sec:o_orderdate} + 3600 END AS leased_at, CASE WHEN o_orderstatus <> 'O' THEN {sec:o_orderdate} + 3720 END AS lease_deadline,
 CASE WHEN o_orderstatus IN ('F') THEN {sec:o_orderdate} + 7200 + o_orderkey % 3600 END AS completed_at,
 CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 <> 0 THEN CASE o_orderkey % 5 WHEN 0 THEN 'NT_STATUS_LOGON_FAILURE' WHEN 1 THEN 'timeout' WHEN 2 THEN 'ConnectionResetError(104)' WHEN 3 THEN 'PermissionError: denied' ELSE 'pool_reset' END END AS error,
 concat('{{"bytes": ', CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS STRING), '}}') AS metrics
 FROM {t:orders} JOIN {t:customer} ON o_custkey = c_custkey""",
    "jobs": "SELECT DISTINCT concat('seg/', c_mktsegment) AS job, lower(c_mktsegment) AS label FROM {t:customer}",
    "results": """SELECT concat('u', CAST(user_id AS STRING)) AS item_id, concat('r', CAST(user_id % 11 AS STRING)) AS runner_id, concat('host', CAST(user_id % 5 AS STRING)) AS host,
 {sec:ts} AS ts, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'requeue' ELSE 'ok' END AS status,
 CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'NT_STATUS_LOGON_FAILURE' WHEN 1 THEN 'timeout' WHEN 2 THEN 'ConnectionResetError(104)' WHEN 3 THEN 'PermissionError: denied' ELSE 'pool_reset' END END AS error FROM {t:events}""",
    "disk_samples": """SELECT concat('disk', CAST(1 + user_id % 7 AS STRING)) AS disk, {sec:ts} AS ts, event_id AS seq,
 sum(CAST(floor(value * 100) AS BIGINT)) OVER w AS read_sectors, sum(event_id % 1000) OVER w AS write_sectors, sum(CAST(floor(value * 1000) AS BIGINT)) OVER w AS io_ms
 FROM {t:events} WINDOW w AS (PARTITION BY user_id % 7 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "progress": """SELECT job, ts, sum(d) OVER w AS done, sum(f) OVER w AS failed, 20000 - sum(d) OVER w AS pending FROM (
 SELECT concat('job', CAST(user_id % 3 AS STRING)) AS job, {sec:ts} - {sec:ts} % 3600 AS ts, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS f
 FROM {t:events} GROUP BY 1, 2) x WINDOW w AS (PARTITION BY job ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "runner_progress": """SELECT runner, ts, sum(n) OVER (PARTITION BY runner ORDER BY ts ROWS UNBOUNDED PRECEDING) AS done FROM (
 SELECT concat('r', CAST(user_id % 11 AS STRING)) AS runner, {sec:ts} - {sec:ts} % 21600 AS ts, count(*) AS n FROM {t:events} GROUP BY 1, 2) x""",
    "decisions": """SELECT concat('host', CAST(l_suppkey % 5 AS STRING)) AS host, {sec:l_shipdate} AS ts, CAST(l_quantity AS BIGINT) AS requested, CAST(floor(l_quantity * l_discount) AS BIGINT) AS granted,
 CASE l_returnflag WHEN 'A' THEN 'GRANTED_FULL' WHEN 'N' THEN 'FAIR_SHARE_CAP' ELSE 'NO_PENDING' END AS reason FROM {t:lineitem}""",
    "heartbeats": """SELECT concat('r', CAST(user_id % 37 AS STRING)) AS runner_id, concat('Host', CAST(user_id % 9 AS STRING)) AS host, {sec:ts} AS last_seen, event_id AS seq, 1 + user_id % 8 AS workers,
 concat('job', CAST(user_id % 3 AS STRING)) AS job, value AS cpu_pct, value / 10 AS mem_used_gb, CAST(64 AS DOUBLE) AS mem_total_gb, CAST(user_id % 13 AS DOUBLE) AS tree_rss_gb,
 CAST(user_id % 100 AS DOUBLE) AS gpu_util_pct, CAST(user_id % 24 AS DOUBLE) AS vram_used_gb, CAST(24 AS DOUBLE) AS vram_total_gb FROM {t:events}""",
    "fleet_runners": """SELECT concat('r', CAST(user_id AS STRING)) AS runner_id, concat('Host', CAST(user_id % 9 AS STRING)) AS host, concat('seg/', CASE user_id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END) AS job,
 CASE WHEN user_id % 4 <> 0 THEN concat('run --n ', CAST(user_id % 6 AS STRING)) ELSE '' END AS launch_command, concat('task', CAST(user_id % 3 AS STRING)) AS task, 1 + user_id % 8 AS workers, max({sec:ts}) AS last_seen,
 CAST(user_id * 7 % 101 AS DOUBLE) AS cpu_pct, CAST(user_id % 33 AS DOUBLE) AS mem_used_gb, CAST(64 AS DOUBLE) AS mem_total_gb, CAST(user_id % 13 AS DOUBLE) AS tree_rss_gb, CAST(user_id % 100 AS DOUBLE) AS gpu_util_pct,
 CAST(user_id % 24 AS DOUBLE) AS vram_used_gb, CAST(24 AS DOUBLE) AS vram_total_gb FROM {t:events} GROUP BY user_id""",
    "firings": """SELECT {sec:ts} AS ts, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' ELSE 'critical' END AS severity, concat('code', CAST(user_id % 5 AS STRING)) AS code,
 CASE WHEN user_id % 4 <> 0 THEN concat('disk', CAST(user_id % 7 AS STRING)) END AS disk, concat('value ', CAST(event_id % 97 AS STRING)) AS detail, concat('act ', CAST(event_id % 5 AS STRING)) AS action,
 CASE WHEN event_id % 6 = 0 THEN concat('/d/', CAST(event_id % 9 AS STRING)) ELSE '' END AS url, CASE WHEN event_id % 11 = 0 THEN concat('agent', CAST(event_id % 4 AS STRING)) END AS origins,
 CASE WHEN event_id % 50 = 0 THEN 'own' END AS fingerprint FROM {t:events} WHERE event_type <> 'view'""",
    "resolves": "SELECT {sec:ts} AS ts, event_id AS seq, concat('code', CAST(user_id % 5 AS STRING), ':disk', CAST(user_id % 7 AS STRING)) AS fingerprint FROM {t:events} WHERE event_type = 'view'",
    "profiles": """SELECT concat('u', CAST(user_id AS STRING)) AS item_id, {sec:ts} AS ts, event_id AS seq, CAST(event_id * 37 % 101 AS DOUBLE) AS cpu_pct, event_id * 7919 % 4096 * 1000000 AS rss_bytes,
 sum(event_id % 1000 * 10000) OVER w AS read_bytes, sum(event_id % 777 * 10000) OVER w AS write_bytes FROM {t:events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "diskstat_lines": """SELECT concat('   8 ', CAST(user_id % 7 AS STRING), ' sd', CAST(user_id % 7 AS STRING), ' 1 2 ', CAST(event_id * 3 AS STRING), ' 4  5 6 ', CAST(event_id * 5 AS STRING), ' 8 9 ', CAST(event_id * 7 AS STRING),
 CASE WHEN event_id % 10 <> 0 THEN ' 11' ELSE '' END) AS value FROM {t:events}""",
    "marks": """SELECT CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('e', CAST(event_id AS STRING)) END AS item_id, CASE WHEN event_id % 17 = 0 THEN 'soon' ELSE CAST({sec:ts} AS STRING) END AS started,
 CASE WHEN event_id % 19 = 0 THEN 'x' ELSE CAST(event_id % 30000 AS STRING) END AS pid FROM {t:events}""",
    "io_items": """SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'shard_1/' ELSE 'x/' END, CAST(doc_id AS STRING)) AS item_id, CASE doc_id % 7 WHEN 0 THEN '//nas1/disk1_direct/in' WHEN 1 THEN '//NAS1/pool/in/' WHEN 2 THEN '//nas3/q/in' WHEN 3 THEN '/mnt/user/in' WHEN 4 THEN '/data/in' WHEN 5 THEN '//nas4/fast/x' END AS read_root,
 CASE doc_id % 5 WHEN 0 THEN '//nas1/pool/out' WHEN 1 THEN '/mnt/disk1/out' WHEN 2 THEN '//nas4/fast/out' WHEN 3 THEN '/data/out' ELSE '//nas2/zz/out' END AS write_root, CASE WHEN doc_id % 11 = 0 THEN '//nas9/a/b' END AS sample_src, CAST(NULL AS STRING) AS sample_dst,
 CASE WHEN doc_id % 2 = 0 THEN 'parity_write' ELSE 'no_smb_creds' END AS ack FROM {t:documents}""",
    "manifest": "SELECT concat(source, '/', lang, '/doc_', CAST(doc_id AS STRING), '.txt') AS rel_path, n_chars AS size, 1704067200 + 60 * doc_id AS mtime FROM {t:documents}",
    # one rule for each supplier: a substring, a range of three, a glob with sets, or a share alone
    "topology": """SELECT s_suppkey AS place, concat('d', CAST(s_suppkey % 13 AS STRING)) AS disk, CASE s_suppkey % 5 WHEN 0 THEN concat('doc_', CAST(s_suppkey AS STRING), '.')
 WHEN 1 THEN concat('doc_', CAST(3 * s_suppkey AS STRING), '..', CAST(3 * s_suppkey + 2 AS STRING)) WHEN 2 THEN concat('src', CAST(s_suppkey % 20 AS STRING), '/[a-e]?/doc_*', CAST(s_suppkey % 10 AS STRING), '[!02468].txt') ELSE '' END AS match,
 CASE WHEN s_suppkey % 5 = 3 THEN concat('//nas', CAST(s_suppkey % 9 AS STRING), '/Share/') END AS read, CAST(NULL AS STRING) AS write, CASE WHEN s_suppkey % 5 = 4 THEN concat('//NAS', CAST(s_suppkey % 11 AS STRING), '/direct/in') END AS direct_path FROM {t:supplier}""",
    "samples": "SELECT concat('disk', CAST(l_suppkey % 7 AS STRING)) AS disk, l_linenumber AS concurrency, avg(l_extendedprice) AS mbps FROM {t:lineitem} GROUP BY 1, 2",
    "edges": "SELECT CAST(p_partkey AS STRING) AS src, CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS dst FROM {t:part} WHERE p_partkey > 1",
    "node_states": "SELECT CAST(p_partkey AS STRING) AS node, CASE WHEN p_size % 10 = 0 THEN 'dirty' ELSE 'clean' END AS state FROM {t:part}",
    "log_lines": "SELECT conv_id AS item_id, turn AS line_no, text AS line FROM {t:conversations}",
    "budgets": "SELECT concat('disk', CAST(1 + c_nationkey % 7 AS STRING)) AS disk, count(*) * (1 + c_nationkey % 7) AS budget, c_nationkey % 3 = 0 AS parity_protected FROM {t:customer} GROUP BY c_nationkey % 7, c_nationkey % 3 = 0",
    "utils": "SELECT concat('disk', CAST(1 + user_id % 7 AS STRING)) AS disk, {sec:ts} AS ts, CAST(max(event_id * 37 % 101) AS DOUBLE) AS util_pct FROM {t:events} GROUP BY 1, 2",
    "disk_hours": """SELECT {sec:ts} - {sec:ts} % 21600 AS ts, concat('disk', CAST(1 + user_id % 7 AS STRING)) AS disk, CAST(sum(event_id) % 97 AS DOUBLE) AS util_pct,
 CAST(sum(event_id * 7) % 131 AS DOUBLE) AS mbps, CAST(150 AS DOUBLE) AS ceiling_mbps, CAST(count(*) % 2 AS BIGINT) AS inflight FROM {t:events} GROUP BY 1, 2""",
    "host_hours": """SELECT {sec:ts} - {sec:ts} % 21600 AS ts, CAST(sum(event_id) % 103 AS DOUBLE) AS cpu_pct, CAST(sum(event_id) % 33 AS DOUBLE) AS mem_used_gb, CAST(32 AS DOUBLE) AS mem_total_gb,
 CAST(sum(event_id) % 127 AS DOUBLE) AS net_mbps, CAST(125 AS DOUBLE) AS net_cap_mbps, CAST(sum(event_id) % 100 AS DOUBLE) AS gpu_util_pct, CAST(sum(event_id) % 25 AS DOUBLE) AS vram_used_gb,
 CAST(sum(event_id) % 2 * 24 AS DOUBLE) AS vram_total_gb, CAST(count(*) AS DOUBLE) AS observed, CAST(16 AS DOUBLE) AS expected FROM {t:events} GROUP BY 1""",
    "clip_frames": """SELECT label AS clip_id, j AS joint, CAST(n - 1 AS DOUBLE) / 30 AS t, a / r AS qw, b / r AS qx, c / r AS qy, d / r AS qz, vec_id % 17 <> 0 AS valid FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS r FROM (
 SELECT label, vec_id, j, row_number() OVER (PARTITION BY label, j ORDER BY vec_id) AS n, CAST({at:embedding,4 * j + 1} AS DOUBLE) AS a, CAST({at:embedding,4 * j + 2} AS DOUBLE) AS b,
 CAST({at:embedding,4 * j + 3} AS DOUBLE) AS c, CAST({at:embedding,4 * j + 4} AS DOUBLE) AS d FROM {t:embeddings} JOIN (VALUES (0), (5), (10), (15)) AS k(j) ON true)) WHERE r > 0""",
    "series": "SELECT user_id AS key, {sec:ts} AS ts, avg(value) AS value FROM {t:events} GROUP BY 1, 2",
}


#: Views with running sums over few keys, as rows (key, at, ...), the order, and sums by name: the rows of the texts above, but
#: with a hot key split into spans of time, as its window would be one task's work.
RUNNING = {
    "disk_samples": ("""SELECT user_id % 7 AS key, CAST(ts AS TIMESTAMP) AS at, concat('disk', CAST(1 + user_id % 7 AS STRING)) AS disk, {sec:ts} AS ts, event_id AS seq,
 CAST(floor(value * 100) AS BIGINT) AS read_sectors, event_id % 1000 AS write_sectors, CAST(floor(value * 1000) AS BIGINT) AS io_ms FROM {t:events}""", ("at", "seq"), ("read_sectors", "write_sectors", "io_ms")),
}


def text(name: str, spark_dir: str | None) -> str:
    """The view's SQL: for Spark over the files of a folder, or for an engine with the tables as views."""
    return _filled(VIEWS[name], spark_dir)


def _filled(sql: str, spark_dir: str | None) -> str:
    sql = re.sub(r"\{t:(\w+)\}", (lambda m: f"parquet.`{spark_dir}/{m[1]}.parquet`") if spark_dir else r"\1", sql)
    sql = re.sub(r"\{sec:(\w+)\}", r"unix_seconds(CAST(\1 AS TIMESTAMP))" if spark_dir else r"(epoch_us(\1) // 1000000)", sql)
    sql = re.sub(r"\{at:(\w+),([^}]+)\}", r"element_at(\1, \2)" if spark_dir else r"\1[\2]", sql)
    return sql.replace("{{", "{").replace("}}", "}")


def view(spark: SparkSession, sf_dir: str, name: str, rows: int | None = None) -> DataFrame:
    """A view; where it sums along time, a key of more than `rows` rows is split into spans (see operators.spans)."""
    if name not in RUNNING:
        return spark.sql(text(name, sf_dir))
    sql, order, sums = RUNNING[name]
    given = spark.sql(_filled(sql, sf_dir))
    summed = Spans(given, ["key"], order, rows).running(**{f"_{c}": ("sum", F.col(c)) for c in sums}).rows()
    return summed.select(*(F.col(f"_{c}" if c in sums else c).alias(c) for c in given.columns if c not in ("key", "at")))


def sql_with(names: str, body: str) -> str:
    """The SQL of a query over views; a body that begins with a comma brings more of its own."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text(n, None)})" for n in names.split()) + " " + body
