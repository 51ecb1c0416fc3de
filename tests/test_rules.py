"""Small exact cases of alerts, advice, batches, gates, closures and profiles."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import expr
from tallyloom.operators import advice, detect, folds, graph, joins, ledger, shards, telemetry


def test_alerts_of_one_fingerprint_are_one(spark):
    schema = "ts long, seq long, severity string, code string, disk string, detail string, action string, url string, origins string, fingerprint string"
    rows = [(1, 1, "info", "c", None, "a", "x", "/u", "o", None), (5, 2, "warn", "c", "", "b", "y", "", None, None), (2, 3, "info", "c", "d1", "z", "x", None, None, ""), (9, 4, "info", "other", "d", "q", "x", None, None, "own")]
    resolved = spark.createDataFrame([(6, 5, "c:*"), (1, 0, "c:d1")], "ts long, seq long, fingerprint string")
    got = {r.fingerprint: r for r in advice.dedup_alerts(spark.createDataFrame(rows, schema), resolved).collect()}
    assert set(got) == {"c:*", "c:d1", "own"}
    a = got["c:*"]
    assert (a["count"], a.first_ts, a.last_ts, a.severity, a.detail, a.url, a.origins, a.active) == (2, 1, 5, "warn", "b", "/u", "o", False)
    assert got["c:d1"].active and got["own"].active
    assert [r.fingerprint for r in advice.dedup_alerts(spark.createDataFrame(rows, schema), keep=1).collect()] == ["own"]


def test_advice_and_gate(spark):
    disks = [advice.Disk("d1", "shard_1", "hdd", "//nas/d1", "//nas/pool", "/mnt/d1", True)]
    items = spark.createDataFrame(
        [("shard_1/a", "//nas/pool/in", "/mnt/d1/out", None, None, ["parity_write"]), ("x", "/local", None, None, None, None), ("y", None, None, "//other/q/a", None, None)],
        "item_id string, read_root string, write_root string, sample_src string, sample_dst string, acks array<string>")
    servers = spark.createDataFrame([("nas", True, False)], "server string, have_creds boolean, brokered boolean")
    got = {r.item_id: r for r in advice.gate_io(advice.advise_io(items, disks, servers), "acks").collect()}
    assert [f.code for f in got["shard_1/a"].findings] == ["input.hdd", "read.not_direct", "output.parity", "output.direct_disk_write"]
    assert got["shard_1/a"].blocked and got["shard_1/a"].needed == ["no_direct_share", "direct_disk_write"] and got["shard_1/a"].acknowledged == ["parity_write"]
    assert [f.code for f in got["x"].findings] == ["input.unknown"] and not got["x"].blocked and got["x"].severity == "ok"
    assert [f.code for f in got["y"].findings] == ["input.unclassified_nas"] and got["y"].blocked
    none = advice.advise_io(items, [], servers).where("item_id = 'x'").first()
    assert [f.code for f in none.findings] == ["topology.none", "input.unknown"]


def test_batch_respects_what_is_in_flight_and_says_why(spark):
    items = [(f"p{k}", "d0" if k % 2 else "unknown", "pending", k) for k in range(8)] + [(f"l{k}", "d0", "leased", k) for k in range(2)]
    led, caps = spark.createDataFrame(items, "item_id string, disk string, state string, created_at long"), spark.createDataFrame([("d0", 3), ("d9", 1)], "disk string, cap int")
    batch = joins.balanced_batch(led, caps, 10)
    assert [(r.item_id, r.turn) for r in batch.collect()] == [("p1", 1), ("p0", 1), ("p2", 2), ("p4", 3), ("p6", 4)]
    report = {r.disk: r for r in joins.batch_report(led, caps, batch, 10, 10).collect()}
    assert (report["d0"].inflight_before, report["d0"].free, report["d0"].granted_here, report["d9"].granted_here) == (2, 1, 1, 0)
    why = lambda *a, items=led, **k: joins.batch_report(items, caps, batch.limit(a[0]), *a[1:], **k).first().reason
    assert report["d0"].reason == "DISK_BUDGET_FULL" and why(4, 9, 4) == "FAIR_SHARE_CAP" and why(4, 4, 4) == "GRANTED_FULL"
    assert why(0, 4, 4, items=led.where("state = 'leased'")) == "NO_PENDING" and why(4, 4, 4, banned=True) == "HOST_BANNED"


def test_idle_gate_needs_two_samples_and_telemetry(spark):
    io = spark.createDataFrame([("d", 0, 5.0, 2), ("d", 600, 90.0, 1), ("d", 1200, 5.0, 2), ("d", 1800, 5.0, 9), ("d", 2400, 50.0, 9), ("d", 3000, 1.0, 9)], "disk string, ts long, util_pct double, samples int")
    gates = spark.createDataFrame([("g", "d")], "gate string, disk string")
    got = [(r.ts, r.admit, r.reason, r.quiet_for_s) for r in detect.idle_gate(io, gates).orderBy("ts").collect()]
    assert got == [(0, False, "WAIT", 0), (600, True, "NO_TELEMETRY", 0), (1200, False, "WAIT", 1200), (1800, True, "OPEN", 1800), (2400, False, "WAIT", 0), (3000, False, "WAIT", 0)]


def test_bottlenecks_fire_when_sustained_and_name_the_disk(spark):
    rows = [("h", t, "disk_at_ceiling" if t < 40 else "healthy", "disk:d3" if t < 40 else "none") for t in range(0, 60, 10)] + [("g", 0, "net_bound", "net")]
    got = detect.bottleneck_alerts(spark.createDataFrame(rows, "host string, ts long, verdict string, resource string"), ["host"], 20).collect()
    assert [(r.host, r.code, r.severity, r.disk, r.begin_ts, r.fire_ts, r.end_ts, r.firings) for r in got] == [("h", "disk.at_ceiling", "warn", "d3", 0, 20, 30, 2)]


def test_expected_rate_is_the_best_before_the_newest(spark):
    rates = [0.0, 4.0, 9.0, 3.0, 0.0, 5.0]
    got = detect.with_expected(spark.createDataFrame([("r", k, x) for k, x in enumerate(rates)], "runner string, ts long, rate double"), "rate", ["runner"]).orderBy("ts").collect()
    want = []
    for k in range(len(rates)):
        seen = [x for x in rates[: k + 1] if x > 0]
        want.append((seen[-1] if seen else 0.0, max(seen[:-1] or seen) if seen else 0.0))
    assert [(r.observed, r.expected) for r in got] == want


def test_collapse_counts_leased_work_and_needs_a_base(spark):
    done = [0, 10, 20, 30, 40, 50, 60, 60, 60, 60]
    rows = [("j", 10 * k, d, 0, 1) for k, d in enumerate(done)]
    s = spark.createDataFrame(rows, "job string, ts long, done long, pending long, leased long")
    assert telemetry.collapse(s).orderBy("ts").collect()[-1].collapsed
    assert not telemetry.collapse(s.drop("leased")).orderBy("ts").collect()[-1].collapsed
    assert not telemetry.collapse(s, least_base=2.0).where("collapsed").count()


def test_plateau_names_whom_and_waits_for_history(spark):
    rows = [(r, t, t if r == "fast" and t < 200 else 200 if r == "fast" else t // 2 if r == "steady" else t // 100) for r in ("fast", "steady", "tiny") for t in range(0, 241, 10)]
    s = spark.createDataFrame(rows, "runner string, ts long, done long")
    got = {r.runner: r.plateau for r in telemetry.plateau_report(s, 240, 1000).collect()}
    assert got == {None: False, "fast": True, "steady": False, "tiny": False}
    assert telemetry.plateau_report(s, 240, 320).count() == 0 and telemetry.plateau_report(s.where("ts <= 100"), 100, 1000).count() == 0


def test_item_states_along_a_stream_of_events(spark):
    r = random.Random(4)
    events = [(f"i{r.randrange(20)}", k // 3, k, r.choice(["lease", "lease", "error", "error", "requeue", "ok"]), r.choice(["timeout", "timeout", "x" * 3000])) for k in range(400)]
    want, state = {}, {}
    for item, _, _, status, error in events:
        n, e = state.get(item, (0, None))
        if status == "lease":
            new, n = "leased", n + 1
        elif status == "ok":
            new, e = "done", None
        elif status == "requeue":
            new, n, e = "pending", max(0, n - 1), None
        elif error == e == "timeout":
            new, e = "failed", "quarantined: second timeout"
        else:
            new, e = ("failed" if n > 3 else "pending"), error[:2000]
        state[item], want[item] = (n, e), (new, n, e)
    got = folds.stream_ledger(spark.createDataFrame(events, "item_id string, ts long, seq long, status string, error string"))
    last = got.groupBy("item_id").agg(F.max_by(F.struct("state", "attempts", "error"), F.struct("ts", "seq")).alias("x"))
    assert {x.item_id: tuple(x.x) for x in last.collect()} == want


def test_results_carry_metrics(spark):
    led = spark.createDataFrame([("a", "leased", 1, None, "old"), ("b", "leased", 1, None, "old")], "item_id string, state string, attempts int, error string, metrics string")
    res = spark.createDataFrame([("a", 1, 1, "ok", None, "m1"), ("a", 2, 2, "ok", None, "m2"), ("a", 3, 3, "error", "x", "bad"), ("b", 1, 4, "error", "x", "bad")], "item_id string, ts long, seq long, status string, error string, metrics string")
    assert {r.item_id: r.metrics for r in ledger.apply_results(led, res).collect()} == {"a": "m2", "b": "old"}


@pytest.mark.parametrize("compact", [2, 50])
def test_closure_equals_a_walk(spark, monkeypatch, compact):
    monkeypatch.setattr(graph, "COMPACT", compact)
    r = random.Random(9)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [(f"n{r.randrange(40)}", f"m{r.randrange(30)}") for _ in range(60)] + [(f"m{r.randrange(30)}", f"n{r.randrange(40)}") for _ in range(20)]

    def walk(start, banned=""):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen and not (banned and x.startswith(banned)):
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        return seen

    table, root = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n3",)], "node string")
    assert sorted(x.node for x in graph.dependency_closure(table, root).collect()) == sorted(walk("n3"))
    assert sorted(x.node for x in graph.dependency_closure(table, root, ["^m"]).collect()) == sorted(walk("n3", "m"))
    assert [x.node for x in graph.dependency_closure(table, spark.createDataFrame([("lost",)], "node string")).collect()] == ["lost"]


def test_suggestions_by_bias_and_without_samples(spark):
    s = spark.createDataFrame([("d", c, m) for c, m in ((1, 50.0), (2, 95.0), (4, 140.0), (8, 150.0), (16, 130.0))], "disk string, concurrency int, mbps double")
    got = [telemetry.suggest_concurrency(s, b).first().suggested for b in ("conservative", "balanced", "aggressive", "other")]
    assert got == [4, 4, 8, 8]
    both = spark.createDataFrame([("d",), ("new",)], "disk string")
    assert {r.disk: r.suggested for r in telemetry.suggest_concurrency(s, "balanced", both).collect()} == {"d": 4, "new": 4}


def test_labels_and_settings_are_upserted(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "job string, gate string")
    new = spark.createDataFrame([("a", None), ("b", "9"), ("d", "4")], "job string, gate string")
    assert {r.job: r.gate for r in ledger.upsert_by_job(old, new, "gate").collect()} == {"b": "9", "c": "3", "d": "4"}


def test_flags_and_shards(spark):
    one = spark.createDataFrame([("run --token abc --x 1 --password=p --tokens y",)], "c string")
    assert one.select(expr.mask_flags(F.col("c"))).first()[0] == "run --token *** --x 1 --password=*** --tokens y"
    plan = shards.shard_plan(spark.createDataFrame([("a", 6), ("b", 3), ("c", 3)], "rel_path string, size long"), 2)
    assert {(r.shard, r.files, r.bytes, r.percent, r.skew) for r in shards.shard_summary(plan).collect()} == {(1, 1, 6, 50.0, 1.0), (2, 2, 6, 50.0, 1.0)}


def test_demotion_templates(spark):
    files = spark.createDataFrame([("a/b.npz",)], "rel_path string")
    root = lambda to, **k: telemetry.demote_items(files, "/in", to, **k).first().write_root
    n = files.select(expr.hash_shard(F.col("rel_path"), 7).alias("n")).first().n
    assert root("/mnt/user/Word*/Set/") == f"/mnt/disk{n}/Word{n}/Set" and root("/x/Word*") == f"/x/Word{n}" and root("/m/disk{n}/y") == f"/m/disk{n}/y" and root("Word*/s") == f"Word{n}/s"
    assert root("/all/W*/s", union="/all") == f"/mnt/disk{n}/W{n}/s"
    for bad in ("/mnt/user/Set", "/mnt/user/*/Set", "/mnt/user/W*x/Set"):
        with pytest.raises(ValueError):
            root(bad)


def test_core_faults_stay_mended(spark):
    led = spark.createDataFrame([("a", None, "pending"), ("b", "j", "leased"), ("c", "j", "done"), ("d", "k", "pending")], "item_id string, job string, state string")
    assert sorted(x.item_id for x in ledger.cancel(led, "j").collect()) == ["a", "c", "d"] and sorted(x.item_id for x in ledger.cancel(led, "j", purge=True).collect()) == ["a", "d"]
    with pytest.raises(ValueError):
        ledger.cancel(led, "")
    full = led.withColumns({"attempts": F.lit(3), "error": F.lit("e"), "runner_id": F.lit("r"), "leased_at": F.lit(5)})
    assert [(x.item_id, x.state, x.attempts, x.error, x.runner_id, x.leased_at) for x in ledger.requeue(full, ("done", "nonsense"), True).where("error is null").collect()] == [("c", "pending", 0, None, None, None)]
    beats = spark.createDataFrame([("r", "h", 1, 1, "j", 4, 10.0, 1.0, 7), ("r", "?", 2, 2, None, None, None, None, None), ("r", None, 3, 3, None, None, None, 2.0, None)], "runner_id string, host string, last_seen long, seq long, job string, workers int, cpu_pct double, mem_used_gb double, in_flight int")
    x = ledger.latest_runners(beats, 10).first()
    assert (x.host, x.job, x.workers, x.cpu_pct, x.mem_used_gb, x.in_flight, x.last_seen) == ("h", "j", 4, None, 2.0, 7, 3)
