"""Connectors: folders, old ledger files, fan-outs in SQL, and alerts as a stream."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import items
from tallyloom.operators import advice
from tallyloom.sources import connect
from tallyloom.streaming import flows


def test_folders_are_listed_in_parts_and_what_may_not_be_read_is_named(spark, tmp_path, monkeypatch):
    want = {}
    for i in range(5):
        for j in range(4):
            d = tmp_path / f"a{i}" / f"b{j}" / "deep"
            d.mkdir(parents=True)
            for k in range(3):
                f = d / f"f{k}.{'bin' if k else 'txt'}"
                f.write_bytes(b"x" * (i + j + k))
                want[str(f.relative_to(tmp_path))] = i + j + k
    (tmp_path / "top.bin").write_bytes(b"12")
    (tmp_path / "dangling.bin").symlink_to(tmp_path / "nowhere")
    os.symlink(tmp_path, tmp_path / "loop")
    shut = tmp_path / "a0" / "shut"
    shut.mkdir()
    (shut / "hidden.bin").write_bytes(b"1")
    shut.chmod(0)
    monkeypatch.setattr(connect, "FOLDERS", 8)
    try:
        readable = os.access(shut, os.R_OK)
        files, unread = connect.scan_tree(spark, str(tmp_path), "*.bin")
        got = {r.rel_path: r.size for r in files.collect()}
        named = {r.rel_path: r.error for r in unread.collect()}
        assert len(connect.ManifestReader({"path": str(tmp_path)}).partitions()) == 8
    finally:
        shut.chmod(0o755)
    want = {k: v for k, v in want.items() if k.endswith(".bin")} | {"top.bin": 2}
    # root reads everything
    assert got == want | ({"a0/shut/hidden.bin": 1} if readable else {})
    assert set(named) == {"dangling.bin"} | (set() if readable else {"a0/shut"}) and all(named.values())
    assert {r.rel_path for r in connect.scan_tree(spark, str(tmp_path), recursive=False)[0].collect()} == {"top.bin"}
    gone = connect.scan_tree(spark, str(tmp_path / "missing"))
    assert gone[0].count() == 0 and [r.rel_path for r in gone[1].collect()] == ["."]


def test_unreadable_folders_by_a_failing_listing(tmp_path, monkeypatch):
    """As root nothing is unreadable, so the listing itself fails here."""
    for d in ("x", "y/z"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "f").write_text("1")
    real = os.scandir

    def scandir(path):
        if str(path).endswith("y"):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", scandir)
    reader = connect.ManifestReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted((r[0], r[3]) for r in rows) == [("x/f", None), ("y", "Permission denied")]


def test_old_ledger_files(spark, tmp_path, monkeypatch):
    new = sqlite3.connect(tmp_path / "a.db")
    new.execute("CREATE TABLE subjobs (subjob_id TEXT PRIMARY KEY, spec TEXT, job TEXT, disk TEXT, state TEXT, attempts INTEGER, leased_at REAL, metrics TEXT, created_at REAL)")
    new.executemany("INSERT INTO subjobs VALUES (?, ?, 'j', NULL, 'done', ?, ?, ?, 1700000000.25)", [(f"i{k}", json.dumps({"k": k}) if k % 3 else "{broken", k, None if k % 2 else 1.5, None if k % 5 else '{"bytes": 7}') for k in range(40)])
    new.execute("CREATE TABLE jobs (job TEXT, label TEXT, created_at REAL)")
    new.execute("INSERT INTO jobs VALUES ('j', 'Label', 1.0)")
    new.commit()
    old = sqlite3.connect(tmp_path / "b.sqlite")
    old.execute("CREATE TABLE jobs (job_id TEXT, spec TEXT, grp TEXT, state TEXT, created_at REAL)")
    old.execute("INSERT INTO jobs VALUES ('was', '{\"a\": 1}', 'g', 'pending', 5)")
    old.execute("CREATE TABLE campaigns (grp TEXT, label TEXT, created_at REAL)")
    old.execute("INSERT INTO campaigns VALUES ('g', 'Old', 2)")
    old.commit()
    sqlite3.connect(tmp_path / "empty.db").execute("CREATE TABLE subjobs (subjob_id TEXT)").connection.commit()
    monkeypatch.setattr(connect, "LEDGER_ROWS", 7)
    assert len(connect.LedgerReader({"path": str(tmp_path)}).partitions()) == 7
    rows = {r.subjob_id: r for r in connect.read_ledger(spark, str(tmp_path)).withColumn("at", F.unix_micros("created_at")).collect()}
    assert len(rows) == 41 and rows["i4"].at == 1_700_000_000_250_000 and rows["i4"].spec == {"k": "4"} and rows["i3"].spec == {} and rows["i10"].metrics == {"bytes": "7"} and rows["i4"].metrics == {}
    assert rows["i3"].leased_at is None and rows["i4"].attempts == 4 and rows["was"].job == "g" and rows["was"].spec == {"a": "1"} and rows["was"].host is None
    connect.register(spark)
    assert sorted((r.job, r.label) for r in spark.read.format("ledger").option("table", "jobs").load(str(tmp_path)).collect()) == [("g", "Old"), ("j", "Label")]
    connect.read_ledger(spark, str(tmp_path / "a.db")).write.parquet(str(tmp_path / "p"))
    again = connect.read_ledger(spark, str(tmp_path / "p").rstrip("/"))
    assert again.count() == 40 and again.schema["created_at"].dataType.typeName() == "timestamp"


def test_fan_out_as_a_table_function(spark):
    # workers get these by value, as tests are no module of theirs
    class Task:
        @staticmethod
        def enumerate_subjobs(args):
            for fps in args["rates"]:
                yield {"subjob_id": f"{args['clip']}@{fps}", "spec": {"fps": fps}}

    class OldTask:
        @staticmethod
        def enumerate_gigs(args):
            return [{"job_id": args["clip"]}]

    rows = spark.createDataFrame([("a", [30, 60]), ("b", []), ("c", [24])], "clip string, rates array<int>")
    rows.createOrReplaceTempView("clips")
    items.register_enumerator(spark, "fan_out", Task)
    got = spark.sql("SELECT c.clip, f.subjob_id, f.spec FROM clips c, LATERAL fan_out(to_json(named_struct('clip', c.clip, 'rates', c.rates))) f")
    assert sorted(map(tuple, got.collect())) == [("a", "a@30", '{"fps": 30}'), ("a", "a@60", '{"fps": 60}'), ("c", "c@24", '{"fps": 24}')]
    assert sorted(r.subjob_id for r in items.fan_out(rows, Task).collect()) == ["a@30", "a@60", "c@24"]
    assert sorted(r.subjob_id for r in items.fan_out(rows, OldTask).collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="enumerate"):
        items.fan_out(rows, object)


FIRINGS = "ts long, seq long, severity string, code string, disk string, detail string, action string, url string, origins string, fingerprint string"


def test_alert_list_as_a_stream(spark, tmp_path):
    import random

    r = random.Random(2)
    fire = [(1000 + i, i, r.choice(["warn", "info"]), f"code{r.randrange(4)}", r.choice([None, "d1", "d2"]), f"v{i}", "act", r.choice(["", "/u"]), r.choice([None, "me"]), r.choice([None, None, "own"])) for i in range(120)]
    end = [(1000 + i, 500 + i, r.choice(["code1:d1", "code2:*", "own"])) for i in range(0, 120, 9)]
    both = [{"kind": "fire", **dict(zip([c.split()[0] for c in FIRINGS.split(", ")], x, strict=True))} for x in fire] + [{"kind": "resolve", "ts": t, "seq": s, "fingerprint": f} for t, s, f in end]
    r.shuffle(both)
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, both[i::4])))
        live = spark.readStream.schema(f"kind string, {FIRINGS}").json(str(tmp_path / "in"))
        flows.alert_list(live, str(tmp_path / "list"), str(tmp_path / "log"), buckets=3).awaitTermination(120)
    want = advice.dedup_alerts(spark.createDataFrame(fire, FIRINGS), spark.createDataFrame(end, "ts long, seq long, fingerprint string"), 10**6)
    got = flows.read_alert_list(spark, str(tmp_path / "list"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # a batch that runs again changes nothing
    batch = spark.read.schema(f"kind string, {FIRINGS}").json(str(tmp_path / "in" / "3.json"))
    flows.upsert_alerts(batch, 3, str(tmp_path / "list"), 3)
    assert sorted(map(str, flows.read_alert_list(spark, str(tmp_path / "list")).select(want.columns).collect())) == sorted(map(str, want.collect()))
