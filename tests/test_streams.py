"""Streams with timers: rows in any order and split over batches, with a restart, give what the table gives."""

import json
import random

import pytest

from tallyloom.operators import folds

RESULTS = "runner_id string, ts long, seq long, status string, error string"


@pytest.fixture
def timers(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, batches, schema, make):
    """The rows of a stream whose source gets one file for each batch; the query is started anew for every batch."""
    src, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip([c.split()[0] for c in schema.split(", ")], r, strict=True))) for r in rows))
        live = make(spark.readStream.schema(schema).json(str(src)))
        q = live.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(out))


def shuffled(rows, seed, n=3, near=50):
    """n batches whose rows come up to `near` seconds late."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[1] + r.random() * near)
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def both(df):
    return sorted(map(str, df.collect()))


def test_breaker_half_opens_by_a_timer(spark, tmp_path, timers):
    fail = lambda r, t, i: (r, t, i, "error", "PermissionError: denied")
    rows = [fail("a", 1000 + i, i) for i in range(3)] + [fail("a", 1200, 10), ("a", 1600, 11, "ok", None)]
    rows += [fail("quiet", 1000 + i, 20 + i) for i in range(3)]  # nothing follows: only a timer can open it by half
    rows += [("other", 1000 + 40 * i, 100 + i, "ok", None) for i in range(60)]  # moves the watermark on
    make = lambda d: folds.storm_cycles(d, cooldown_s=120, late="60 seconds", half_open=True)
    got = streamed(spark, tmp_path, shuffled(rows, 1), RESULTS, make)
    table = spark.createDataFrame(rows, RESULTS)
    assert both(got) == both(folds.storm_cycles(table, cooldown_s=120, until=3300, half_open=True))
    assert [(x.ts, x.seq, x.change) for x in got.where("runner_id = 'quiet'").orderBy("ts").collect()] == [(1002, 22, "opened"), (1122, None, "half_open")]
    assert [(x.ts, x.change, x.cooldown_s) for x in got.where("runner_id = 'a'").orderBy("ts").collect()] == [(1002, "opened", 120), (1122, "half_open", 120), (1200, "reopened", 240), (1440, "half_open", 240), (1600, "closed", 120)]


def test_ledger_leases_run_out_and_idle_items_are_forgotten(spark, tmp_path, timers):
    schema = "item_id string, ts long, seq long, status string, error string"
    r = random.Random(9)
    rows = [(f"i{r.randrange(12)}", 1000 + k * 5 + r.randrange(5), k, r.choice(["lease", "lease", "ok", "error", "requeue"]), r.choice([None, "timeout", "denied"])) for k in range(300)]
    rows += [("gone", 1000, 1000, "lease", None), ("gone", 1010, 1001, "error", "denied"), ("gone", 2300, 1002, "lease", None)]  # idle in between: attempts start anew
    rows.append(("clock", 2900, 2000, "ok", None))
    make = lambda d: folds.stream_ledger(d, lease_s=60, idle_s=500, late="60 seconds")
    got = streamed(spark, tmp_path, shuffled(rows, 2, 4), schema, make)
    want = folds.stream_ledger(spark.createDataFrame(rows, schema), lease_s=60, idle_s=500, until=2840)
    # the clock's own row is still waiting for the watermark
    assert both(got) == both(want.where("item_id <> 'clock'"))
    assert got.where("seq is null and state = 'pending'").count() > 5
    assert [(x.ts, x.attempts) for x in got.where("item_id = 'gone' and state = 'leased'").orderBy("ts").collect()] == [(1000, 1), (2300, 1)]


def test_alerts_of_silent_keys_resolve(spark, tmp_path, timers):
    schema = "k string, ts long, on boolean"
    r = random.Random(3)
    rows = [(f"k{i % 3}", 1000 + 10 * i, r.random() < 0.8) for i in range(120)] + [("silent", 1000 + 10 * i, True) for i in range(10)]
    rows += [("clock", 1000 + 100 * i, False) for i in range(25)]
    make = lambda d: folds.alert_events(d, "k", 30, 60, idle_s=200, late="60 seconds")
    got = streamed(spark, tmp_path, shuffled(rows, 5), schema, make)
    assert both(got) == both(folds.alert_events(spark.createDataFrame(rows, schema), "k", 30, 60, idle_s=200, until=3340))
    assert [(x.ts, x.event) for x in got.where("k = 'silent'").orderBy("ts").collect()] == [(1030, "fire"), (1090, "refire"), (1290, "resolve")]


def test_streams_say_which_store_they_need(spark, tmp_path):
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(RESULTS).json(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="providerClass"):
        folds.storm_cycles(live, late="1 hour")


def test_throttle_as_a_stream(spark, tmp_path, timers):
    r = random.Random(6)
    rows = [(f"k{r.randrange(3)}", 1000 + 3 * i, i) for i in range(200)] + [("clock", 5000, 1)]
    make = lambda d: folds.throttle(d, "k", 40, late="60 seconds")
    got = streamed(spark, tmp_path, shuffled(rows, 8), "k string, ts long, seq long", make)
    assert both(got) == both(folds.throttle(spark.createDataFrame(rows, "k string, ts long, seq long"), "k", 40).where("k <> 'clock'"))
