"""Windows and chains that split one hot key give the rows of the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import detect, folds, telemetry
from tallyloom.operators.spans import Spans


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def samples(spark):
    """Nine tenths of the rows are one disk's; ties in time, nulls, a null disk."""
    r = random.Random(4)
    out = []
    for i in range(900):
        disk = "hot" if r.random() < 0.9 else r.choice(["a", "b", None])
        # another seq for each row, so that the order is total
        out.append((disk, r.randrange(400), i, r.choice([None, 5.0, 20.0, 50.0, 80.0]), i * 7, i * 3, i * 11, r.choice(["healthy", "cpu_bound", "disk_bound:d1", "mem_bound", None])))
    return spark.createDataFrame(out, "disk string, ts long, seq long, util_pct double, read_sectors long, write_sectors long, io_ms long, verdict string").cache()


@pytest.mark.parametrize("rows", [7, 100])
def test_spans_equal_plain_windows(samples, rows):
    for by in (["disk"], []):
        plain, split = (
            Spans(samples, by, ["ts", "seq"], n).lag(was=F.col("util_pct"), one=F.lit(1))
            .running(total=("sum", F.col("util_pct")), n=("count", F.col("util_pct")), lo=("min", F.col("seq")), hi=("max", F.col("util_pct")), at=("last", F.col("util_pct")), start=("first", F.col("util_pct")))
            .running(before=True, sofar=("sum", F.col("seq")), old=("last", F.col("verdict"))).trailing_first(60, back=F.col("seq"), then=F.col("ts"))
            for n in (10**9, rows)
        )
        assert split.split and not plain.split
        assert split.df.select("_span").distinct().count() > (5 if rows == 100 else 50)
        assert rows_of(split.rows().select(plain.rows().columns)) == rows_of(plain.rows())


@pytest.mark.parametrize("rows", [7, 100])
def test_operators_on_a_hot_key(samples, rows):
    one = samples.dropDuplicates(["disk", "ts"]).cache()
    gates = one.select("disk", F.lit("g").alias("gate")).distinct()
    counted = one.withColumn("samples", F.lit(3))
    for f in (
        lambda n: telemetry.rate_series(one, "read_sectors", ["disk"], rows=n),
        lambda n: telemetry.rolling_io(one, 13, rows=n),
        lambda n: telemetry.sustained(one, "disk", F.col("util_pct") >= 20, 3, rows=n),
        lambda n: detect.idle_windows(one, gates, 60, 2, rows=n),
        lambda n: telemetry.failure_spike(one.selectExpr("disk AS job", "ts", "ts * 3 + seq % 7 AS failed", "ts * 4 AS done"), 5, rows=n),
        lambda n: detect.with_expected(one.withColumn("rate", F.col("util_pct") - 10), "rate", ["disk"], rows=n),
        lambda n: detect.idle_gate(counted, gates, 20, 4, rows=n),
        lambda n: detect.bottleneck_alerts(one.withColumnRenamed("disk", "host").withColumnRenamed("verdict", "resource").withColumn("verdict", F.when(F.col("resource") == "healthy", "healthy").when(F.col("util_pct") > 10, "latency_bound").otherwise("disk_bound")), ["host"], 2, rows=n),
    ):
        plain = f(None)
        assert rows_of(f(rows).select(plain.columns)) == rows_of(plain) and plain.count() > 0


def test_empty_tables(samples):
    none = samples.where("false")
    assert telemetry.rolling_io(none).count() == telemetry.rate_series(none, "io_ms", ["disk"]).count() == telemetry.sustained(none, "disk", F.lit(True), 1).count() == 0
    assert folds.throttle(none, "disk", 10).count() == 0


@pytest.mark.parametrize(("gap", "ranges"), [(1, 4096), (7, 4096), (40, 5), (1000, 4096), (0, 4096)])
def test_throttle_chain_equals_a_walk(samples, gap, ranges, monkeypatch):
    from tallyloom.operators import chains

    monkeypatch.setattr(chains.throttle_chain, "__defaults__", (ranges,))
    want, last = [], {}
    for x in sorted(samples.where("disk is not null").collect(), key=lambda x: (x.ts, x.seq)):
        if x.disk not in last or x.ts - last[x.disk] >= gap:
            last[x.disk] = x.ts
            want.append((x.disk, x.ts, x.seq))
    assert sorted(map(tuple, folds.throttle(samples, "disk", gap).collect())) == sorted(want)
