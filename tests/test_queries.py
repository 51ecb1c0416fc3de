"""Every registered query against its SQL on the small tables, and the exact small cases of the operators."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import expr
from tallyloom.functions import items as mapped
from tallyloom.operators import detect, folds, joins, ledger, resample, shards, stages, telemetry
from tallyloom.plans import registry
from tallyloom.sources import files
from tallyloom.streaming import flows

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{float(v):.9g}") if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    q = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(q.columns)
    at = [list(q.columns).index(c) for c in df.columns]
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in q.fetchall())


def test_item_key_and_shard(spark):
    rows = spark.createDataFrame([("shard_03/a/b/CLIP.npz",), ("high-CLIP.npz",), ("V00_S0001-take2.npz",)], ["p"])
    got = rows.select(expr.item_key(F.col("p")), expr.shard_of(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("CLIP", "shard_03"), ("CLIP", "(root)"), ("V00_S0001-take2", "(root)")]


def test_knee(spark):
    rows = [("d", c, float(m)) for c, m in ((1, 50), (2, 95), (4, 140), (8, 150), (16, 130))]
    df = spark.createDataFrame(rows, "disk string, concurrency int, mbps double")
    assert telemetry.suggest_concurrency(df, 0.9).first()["suggested"] == 4
    assert telemetry.suggest_concurrency(df, 1.0).first()["suggested"] == 8


def test_rolling_io(spark):
    df = spark.createDataFrame([("d", 0, 1, 0, 0, 0), ("d", 1, 2, 200000, 0, 500)], "disk string, ts long, seq long, read_sectors long, write_sectors long, io_ms long")
    r = telemetry.rolling_io(df).where("seq = 2").first()
    assert r.read_mbps == pytest.approx(102.4) and r.util_pct == pytest.approx(50)


def test_two_timeouts_quarantine(spark):
    led = spark.createDataFrame([("a", "leased", 1, None), ("b", "leased", 1, None), ("c", "leased", 1, None)], "item_id string, state string, attempts int, error string")
    res = spark.createDataFrame([("a", 1, 1, "error", "timeout"), ("a", 2, 2, "error", "timeout"), ("b", 1, 3, "requeue", None), ("z", 1, 4, "ok", None)], "item_id string, ts long, seq long, status string, error string")
    got = {r.item_id: (r.state, r.attempts) for r in ledger.apply_results(led, res).collect()}
    assert got == {"a": ("failed", 1), "b": ("pending", 0), "c": ("leased", 1)}


def test_apply_results_equals_loop(spark):
    import random

    r = random.Random(6)
    led = [(f"i{k}", r.choice(["leased", "pending"]), r.choice([None, 0, 1, 3, 4, 5]), r.choice([None, "timeout", "x"])) for k in range(150)]
    res = [(f"i{r.randrange(140)}", r.randrange(30), k, r.choice(["error", "error", "error", None, "requeue", "ok", "skipped"]), r.choice(["timeout", "timeout", "timeout", None, "y" * 3000])) for k in range(700)]
    want = {i: (s, a, e) for i, s, a, e in led}
    for i, _, _, status, error in sorted(res, key=lambda x: x[1:3]):
        s, a, e = want[i] if i in want else (None, None, None)
        if status in ("ok", "skipped"):
            want[i] = ("done", a, None)
        elif status == "requeue":
            want[i] = ("pending", max((a or 0) - 1, 0), None)
        elif error == e == "timeout":
            want[i] = ("failed", a, "quarantined: second timeout")
        else:
            want[i] = ("failed" if a is not None and a > 3 else "pending", a, error and error[:2000])
    out = ledger.apply_results(spark.createDataFrame(led, "item_id string, state string, attempts int, error string"), spark.createDataFrame(res, "item_id string, ts long, seq long, status string, error string"))
    assert {x.item_id: (x.state, x.attempts, x.error) for x in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_barriers(spark):
    done = spark.range(4).select(F.lit("done").alias("state"))
    assert joins.edge_barrier(done, "quorum", 4).first()["open"] and not joins.edge_barrier(done, "quorum", 5).first()["open"]
    assert joins.edge_barrier(done, "all").first()["open"] and not joins.edge_barrier(done.limit(0), "all").first()["open"]
    with pytest.raises(ValueError):
        joins.edge_barrier(done, "some")


def test_balanced_batch_equals_loop(spark):
    items = [(f"i{k}", f"d{k % 3}" if k % 4 else None, "pending", k) for k in range(24)]
    caps = {"d0": 2, "d1": 0, "d2": 5}
    got = joins.balanced_batch(spark.createDataFrame(items, "item_id string, disk string, state string, created_at long"), spark.createDataFrame(list(caps.items()), "disk string, cap int"), 9)
    queues: dict = {}
    for i, d, _, _ in items:
        queues.setdefault(d, []).append(i)
    order, turn, want = sorted(queues, key=lambda d: (d is None, int(queues[d][0][1:]))), 0, []
    while len(want) < 9 and turn < 24:
        for d in order:
            if turn < len(queues[d]) and (d is None or turn < caps[d]) and len(want) < 9:
                want.append(queues[d][turn])
        turn += 1
    assert [r.item_id for r in got.collect()] == want


def test_rules(spark):
    df = spark.createDataFrame([("shard_01/a",), ("shard_09/a",), ("x/y.bin",)], ["p"])
    got = joins.assign_by_rules(df, [("e", ""), ("d1", "shard_01..08"), ("d2", "*.bin")], ["p"])
    assert [r.disk for r in got.collect()] == ["d1", None, "d2"]


def test_storm_of_three_logon_failures_and_none_of_mixed_ones(spark):
    rows = [("a", i, i, "error", "LogonFailure") for i in range(3)]
    rows += [("b", i, i, "error", f"odd fault {i}") for i in range(12)] + [("b", 12 + i, 12 + i, "ok", None) for i in range(8)] + [("c", i, i, "error", "timeout") for i in range(20)]
    got = detect.failure_storms(spark.createDataFrame(rows, "runner_id string, ts long, seq long, status string, error string")).collect()
    assert [(r.runner_id, r.seq, r.reason) for r in got] == [("a", 2, "permanent_run")]


def test_shard_plan_is_the_greedy_one_for_the_head_and_even_beyond(spark):
    few = spark.createDataFrame([("a", 9000), ("b", 1000), ("c", 1000), ("d", 1000)], "rel_path string, size long")
    assert [r.b for r in shards.shard_plan(few, 2).groupBy("shard").agg(F.sum("size").alias("b")).orderBy("shard").collect()] == [9000, 3000]
    many = spark.range(20_000).select(F.format_string("f%d", "id").alias("rel_path"), (F.col("id") * 7919 % 1000 + 1).alias("size"))
    plan = shards.shard_plan(many, 7)
    loads = [r.b for r in plan.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert plan.select("rel_path").distinct().count() == plan.count() == 20_000 and len(loads) == 7 and max(loads) - min(loads) <= 2000
    assert shards.shard_plan(few.limit(0), 3).count() == 0


@pytest.mark.parametrize("one_size", [True, False])
def test_shard_plan_equals_the_loop(spark, one_size):
    import heapq
    import random

    r = random.Random(1)
    rows = [(f"p{r.randrange(10**6)}-{i}", 5 if one_size else r.choice([None, 0, -3, 1, 2, 50, 51, r.randrange(10**6)])) for i in range(12_000)]
    loads, want = [(0, i) for i in range(1, 12)], {}
    for path, size in sorted(((p, max(s or 0, 0)) for p, s in rows), key=lambda x: (-x[1], x[0])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        want[path] = shard
    assert {x.rel_path: x.shard for x in shards.shard_plan(spark.createDataFrame(rows, "rel_path string, size long"), 11).collect()} == want


def test_slerp_halfway_and_single_frame(spark):
    r = 0.5**0.5
    rows = [("c", 0, 0.0, 1.0, 0.0, 0.0, 0.0, True), ("c", 0, 1.0, r, 0.0, 0.0, r, False), ("s", 0, 3.0, 1.0, 0.0, 0.0, 0.0, False)]
    got = resample.resample_slerp(spark.createDataFrame(rows, "clip_id string, joint int, t double, qw double, qx double, qy double, qz double, valid boolean"), [2.0]).orderBy("clip_id", "k").collect()
    assert [(x.clip_id, x.k, x.valid) for x in got] == [("c", 0, False), ("c", 1, False), ("c", 2, False), ("s", 0, True)]
    assert 2 * math.degrees(math.acos(got[1].qw)) == pytest.approx(45, abs=1e-3) and got[2].qz == pytest.approx(r)


def test_items_are_tried_again_unless_the_fault_is_permanent(spark):
    items = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"x": 2}'), ("c", '{"x": 3}'), ("d", None), ("e", "{broken")], "subjob_id string, spec string")

    def work(spec):
        if spec.get("x") == 2:
            raise PermissionError("access denied")
        return {"status": "error", "metrics": {"reason": "slow disk"}} if spec.get("x") == 3 else {"metrics": {"x": spec.get("x", 0)}}

    got = {r.subjob_id: r for r in mapped.map_items(items, work, retries=1, backoff=0.0).collect()}
    assert (got["a"].status, got["a"].metrics, got["a"].attempts) == ("ok", '{"x": 1}', 1)
    assert (got["b"].status, got["b"].attempts) == ("error", 1) and got["b"].error.startswith("PermissionError")
    assert (got["c"].error, got["c"].attempts) == ("slow disk", 2) and got["d"].status == got["e"].status == "ok"
    args = spark.createDataFrame([("k", 2), ("m", 0)], "clip string, n int")
    fan = mapped.enumerate_items(args, lambda r: [{"subjob_id": f"{r['clip']}{i}", "spec": {"fps": i}} for i in range(r["n"])])
    assert sorted(r.subjob_id for r in fan.collect()) == ["k0", "k1"]


def test_sources_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text('{"subjob_id": "p", "spec": "{}", "job": "j"}\n\n{"job_id": "q"}\n{"spec": "{\\"z\\": 1}"}\n')
    items = files.read_work_items(spark, str(src)).orderBy("subjob_id")
    rows = items.collect()
    assert len(rows) == 3 and {"p", "q"} < {r.subjob_id for r in rows} and all(r.spec for r in rows)
    files.write_work_items(items, str(tmp_path / "out"))
    assert sorted(r.subjob_id for r in files.read_work_items(spark, str(tmp_path / "out")).collect()) == sorted(r.subjob_id for r in rows)
    (src / "deep").mkdir()
    (src / "deep" / "b.npz").write_bytes(b"12345")
    assert [(r.rel_path, r["size"]) for r in files.scan_manifest(spark, str(src), "*.npz").collect()] == [("deep/b.npz", 5)]
    files.write_sharded(spark.range(10).withColumn("shard", F.col("id") % 3), str(tmp_path / "sharded"), files=2)
    assert sorted(p.name for p in (tmp_path / "sharded").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert spark.read.parquet(str(tmp_path / "sharded")).count() == 10
    hit = spark.sql("SELECT 'h' host, 'mem' rule, 's' signal, 'kill' action, 1.0D threshold, true succeeded, named_struct('pid', 7, 'name', 'w') kill_root, CAST(null AS DOUBLE) ts, 5.0D received_at")
    assert files.ingest_pressure_events(hit).first()["ts"] == 5.0 and files.ingest_pressure_events(hit).first()["kill_pid"] == 7


def test_streams_equal_their_static_twins(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "a.json").write_text("".join(f'{{"ts": {t}, "subjob_id": "i{t}", "event": "ok", "host": "h{t % 2}", "runner_id": "r"}}\n' for t in (10, 20, 3000, 3700, 900000)))
    at = lambda df: df.withColumn("at", F.timestamp_seconds("ts"))
    static = flows.throughput(at(files.read_event_log(spark, str(src))), "1 hour", by=["host"])
    stream = flows.throughput(at(files.read_event_log(spark, str(src), streaming=True)), "1 hour", by=["host"])
    flows.alert_sink(stream, str(tmp_path / "sunk"), str(tmp_path / "mark")).awaitTermination()
    sunk = [(r.begin_ts, r.host, r.n) for r in spark.read.parquet(str(tmp_path / "sunk")).collect()]
    assert sorted(sunk) == sorted((r.begin_ts, r.host, r.n) for r in static.collect() if r.begin_ts < 800000) and len(sunk) > 1


STORM = "runner_id string, ts long, seq long, status string, error string"


def test_storm_cycle_opens_probes_and_closes(spark):
    bad = [("a", t, t, "error", "LogonFailure") for t in (0, 1, 2, 50, 130, 200, 370)] + [("a", 620, 620, "ok", None), ("a", 900, 900, "ok", None), (None, 1, 1, "error", "x"), ("a", None, 5, "error", "x")]
    got = folds.storm_cycles(spark.createDataFrame(bad, STORM)).orderBy("ts").collect()
    assert [(r.ts, r.change, r.cooldown_s) for r in got] == [(2, "opened", 120), (130, "reopened", 240), (370, "reopened", 480), (900, "closed", 120)]
    assert folds.storm_cycles(spark.createDataFrame([], STORM)).count() == 0
    calm = [("b", i, i, "error", f"odd fault {i}") for i in range(12)] + [("c", i, i, "error", "timeout") for i in range(20)]
    assert folds.storm_cycles(spark.createDataFrame(calm, STORM)).count() == 0
    wide = [("d", i, i, "error" if i % 2 else "ok", "slow disk" if i % 2 else None) for i in range(8)]
    assert [(r.seq, r.error) for r in folds.storm_cycles(spark.createDataFrame(wide, STORM)).collect()] == [(5, "slow disk")]


def test_first_storm_agrees_with_the_window_form(spark):
    res = registry.view(spark, DIR, "results")
    first = detect.failure_storms(res).select("runner_id", "seq").collect()
    opened = folds.storm_cycles(res).where("change = 'opened'").groupBy("runner_id").agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq")).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, opened))


def test_throttle_counts_and_snoozes(spark):
    rows = [("a", 0, 1, 1, None), ("a", 100, 2, 2, None), ("a", 300, 3, 1, None), ("a", 400, 4, 2, None), ("a", 700, 5, 3, 800), ("a", 900, 6, 3, 800), ("b", 5, 7, None, None)]
    df = spark.createDataFrame(rows, "k string, ts long, seq long, n long, z long")
    assert sorted(r.seq for r in folds.throttle(df, "k", 300, "n", "z").collect()) == [1, 4, 6, 7]
    # a gap alone: without a count every event is a new one
    assert sorted(r.seq for r in folds.throttle(df, "k", 300).collect()) == [1, 3, 5, 7]


def test_alerts_fire_again_and_resolve_once_as_stream_and_table(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    (src / "a.json").write_text("".join(f'{{"k": "d", "ts": {t}, "on": {str(on).lower()}}}\n' for t, on in ((0, True), (50, True), (60, False), (70, True), (130, True), (200, True), (430, True), (440, False), (450, False))))
    want = [(130, "fire"), (430, "refire"), (440, "resolve")]
    kind = "k string, ts long, on boolean"
    got = folds.alert_events(spark.read.schema(kind).json(str(src)), "k", 60).orderBy("ts").collect()
    assert [(r.ts, r.event) for r in got] == want
    live = folds.alert_events(spark.readStream.schema(kind).json(str(src)), "k", 60)
    flows.alert_sink(live, str(tmp_path / "sunk"), str(tmp_path / "mark")).awaitTermination()
    assert sorted((r.ts, r.event) for r in spark.read.parquet(str(tmp_path / "sunk")).collect()) == want


def test_pipeline_tick_checks_edges_and_fires_barriers_once(spark):
    led = spark.createDataFrame([("a/x.npz", "done"), ("a/y.npz", "pending")], "item_id string, state string")
    files_ = spark.createDataFrame([("made",)], "rel_path string")
    both = {"a": stages.Stage(led), "b": stages.Stage(led.limit(0), "b/{clip}", {"n": 1}, ("made",)), "c": stages.Stage(led.limit(0))}
    edge = stages.Edge
    got = stages.pipeline_tick(both, [edge("a", "b", "each"), edge("a", "b", "each"), edge("a", "c", "quorum", 1), edge("a", "b", "quorum", 1)], files_)
    assert sorted((r.stage, r.item_id, r.spec) for r in got.collect()) == [("b", "b/x.npz", '{"n":1}'), ("c", None, None)]
    assert stages.pipeline_tick(both, [edge("a", "c", "quorum", 1)], files_, ["c"]).count() == stages.pipeline_tick(both, [edge("a", "c", "all")], files_).count() == 0
    with pytest.raises(ValueError):
        stages.pipeline_tick(both, [edge("a", "b", "quorum")], files_)
