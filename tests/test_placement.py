"""Placement by a table of rules against a loop."""

import fnmatch
import random
import re

from tallyloom.operators import joins, placement

SCHEMA = "item_id string, path string, read_root string, write_root string, disk string"
TOPOLOGY = "place long, disk string, match string, read string, write string, direct_path string"


def fits(text, match):
    if not match:
        return False
    if ".." in match:
        left, _, right = match.partition("..")
        m = re.match(r"^(.*?)(\d+)$", left)
        names = [match] if not m or not right.isdigit() else [m[1] + str(i).zfill(len(m[2])) for i in range(int(m[2]), int(right) + 1)]
        return any(n in text for n in names)
    return fnmatch.fnmatchcase(text, match) if any(c in match for c in "*?[") else match in text


def norm(path):
    return (path or "").replace("\\", "/").rstrip("/").lower()


def loop(items, topology):
    out = []
    for item, path, read, write, _ in items:
        text = " ".join(x for x in (item, path) if x is not None)
        disk = next((d for _, d, m, *_ in topology if fits(text, m)), None)
        for root in (norm(read), norm(write)):
            if disk is None and root:
                disk = next((d for _, d, _, *shares in topology for s in map(norm, shares) if s and (root == s or root.startswith(s + "/"))), None)
        out.append((item, path, disk))
    return sorted(out, key=str)


def test_table_of_rules(spark):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("ab01/_[]-.") for _ in range(n))
    match = lambda: r.choice([lambda: word(r.randrange(1, 7)), lambda: f"{word(2)}{r.randrange(3)}..{r.randrange(5)}", lambda: f"*{word(3)}*", lambda: f"{word(1)}?[a0-1]*", lambda: f"*[!ab]{word(2)}", lambda: "", lambda: None, lambda: "a0..", lambda: "[*"])()
    share = lambda: r.choice([None, "", f"//Nas{r.randrange(6)}/S{r.randrange(3)}/", f"\\\\nas{r.randrange(6)}\\s{r.randrange(3)}\\in"])
    topology = [(i, f"d{i}", match(), share(), share(), share()) for i in range(120)]
    items = [(word(r.randrange(1, 14)), r.choice([None, word(9)]), r.choice([None, f"//nas{r.randrange(7)}/S{r.randrange(4)}/IN/x", "//nas1"]), share(), "old") for _ in range(400)] + [("x\ny", "*", None, None, None)] * 2
    for some in (topology, [t for t in topology if t[2] and len(t[2]) > 4], topology[:1], []):
        got = placement.assign_by_topology(spark.createDataFrame(items, SCHEMA), spark.createDataFrame(some, TOPOLOGY), ["item_id", "path"])
        assert got.columns == ["item_id", "path", "read_root", "write_root", "disk"]
        assert sorted(((x.item_id, x.path, x.disk) for x in got.collect()), key=str) == loop(items, some)
    none = spark.createDataFrame([], SCHEMA)
    assert placement.assign_by_topology(none, spark.createDataFrame(topology, TOPOLOGY), ["item_id"]).count() == 0


def test_ten_thousand_rules(spark):
    rules = spark.range(10_000).selectExpr("id AS place", "concat('d', id) AS disk", "concat('shard_', lpad(id, 5, '0')) AS match")
    items = spark.range(3000).selectExpr("concat('x/shard_', lpad(id * 3 + 2000, 5, '0'), '/clip.npz') AS item_id", "id")
    got = placement.assign_by_topology(items, rules)
    assert got.where("disk = concat('d', id * 3 + 2000)").count() == got.where("id * 3 + 2000 < 10000").count() == 2667 and got.where("disk is null").count() == 333


def test_short_lists_mean_the_same(spark):
    rules = [("d0", ""), ("d1", "shard_01..08"), ("d2", "shard_0[1-4]*"), ("d3", "*.b[!i-j]n"), ("d4", "a..b"), ("d5", "note")]
    texts = ["shard_03/clip.npz", "shard_09/clip.npz", "x.ban", "x.bin", "xa..b", "notes.txt", "", "shard_1"]
    items = spark.createDataFrame([(t,) for t in texts], "item_id string")
    topology = spark.createDataFrame([(i, d, m) for i, (d, m) in enumerate(rules)], "place long, disk string, match string")
    want = {t: next((d for d, m in rules if fits(t, m)), None) for t in texts}
    assert want["shard_03/clip.npz"] == "d1" and want["x.ban"] == "d3"
    assert {x.item_id: x.disk for x in joins.assign_by_rules(items, rules, ["item_id"]).collect()} == want
    assert {x.item_id: x.disk for x in placement.assign_by_topology(items, topology).collect()} == want


def test_repeated_rules_count_once(spark):
    rules = spark.range(900).selectExpr("900 - id AS place", "concat('d', 900 - id) AS disk", "element_at(array('x/*_[!02].npz', 'c1..2', 'c2'), CAST(1 + id % 3 AS INT)) AS match")
    assert sorted((x.literal, x.place, x.disk) for x in placement.distinct_rules(rules).collect()) == [(".npz", 3, "d3"), ("c1", 2, "d2"), ("c2", 1, "d1")]
    items = spark.createDataFrame([("x/a_1.npz",), ("x/c1_0.npz",), ("c2",), ("c3",)], "item_id string")
    assert {x.item_id: x.disk for x in placement.assign_by_topology(items, rules).collect()} == {"x/a_1.npz": "d3", "x/c1_0.npz": "d2", "c2": "d1", "c3": None}
