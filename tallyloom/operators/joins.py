"""Joins between a ledger and what surrounds it: placement rules, resumes, stage dependencies, suppressions and drift."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import item_key, job_of


def range_members(rule: str) -> list[str] | None:
    """shard_01..03 as shard_01, shard_02, shard_03; None for what has no dots, the text itself for dots that make no range."""
    left, dots, right = rule.partition("..")
    if not dots:
        return None
    m = re.fullmatch(r"(?s)(.*?)([0-9]+)", left)
    if not m or not re.fullmatch(r"[0-9]+", right):
        return [rule]
    return [f"{m[1]}{i:0{len(m[2])}d}" for i in range(int(m[2]), int(right) + 1)]


def glob_regex(glob: str) -> str:
    """A shell pattern over a whole text as a regular expression: *, ?, sets [a-c], and sets of what is not meant [!a-c]."""
    out, i = [], 0
    while i < len(glob):
        c, i = glob[i], i + 1
        # a set's first character may be its end's mark
        end = glob.find("]", i + 1 + (glob[i : i + 1] == "!")) if c == "[" else -1
        if end > 0:
            inside, i = glob[i:end], end + 1
            no = inside[0] == "!"
            members, k = "", int(no)
            while k < len(inside):
                ranged = inside[k + 1 : k + 2] == "-" and k + 2 < len(inside)
                if not ranged:
                    members += re.escape(inside[k])
                elif inside[k] <= inside[k + 2]:  # a range the wrong way round has no members
                    members += f"{re.escape(inside[k])}-{re.escape(inside[k + 2])}"
                k += 3 if ranged else 1
            out.append(f"[{'^' * no}{members}]" if members else "." if no else "(?!)")
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
    return f"^(?s:{''.join(out)})\\z"


def rule_matches(text: Column, rule: str) -> Column:
    """A range `shard_01..08` or a substring anywhere in the text, a glob over all of it; an empty rule matches nothing."""
    if not rule:
        return F.lit(False)
    if (members := range_members(rule)) is not None:
        return F.coalesce(*(F.when(F.contains(text, F.lit(x)), True) for x in members), F.lit(False))
    if re.search(r"[*?\[]", rule):
        return text.rlike(glob_regex(rule))
    return F.contains(text, F.lit(rule))


def assign_by_rules(items: DataFrame, rules: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """The first rule (id, pattern) that the row's joined texts match, else null. Rules are a short configured list."""
    text = F.concat_ws(" ", *columns)
    return items.withColumn("disk", F.coalesce(*(F.when(rule_matches(text, p), name) for name, p in rules), F.lit(None).cast("string")))


def inject_roots(items: DataFrame, topology: DataFrame, rules: Sequence[tuple[str, str]] = (), columns: Sequence[str] = ("item_id",)) -> DataFrame:
    """read_root and write_root of the item's disk, where they are blank; an item without a disk gets that of the first rule it matches."""
    if rules:
        items = assign_by_rules(items.withColumnRenamed("disk", "own_disk"), rules, columns).withColumn("disk", F.coalesce("own_disk", "disk")).drop("own_disk")
    joined = items.join(topology.select("disk", "read", "write"), "disk", "left")
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(d))
    return joined.withColumn("read_root", fill("read_root", "read")).withColumn("write_root", fill("write_root", "write")).drop("read", "write")


def seed_new(batch: DataFrame, ledger: DataFrame, order: Sequence[str], job: str | None = None) -> DataFrame:
    """Items of the batch that the ledger lacks, the first of each id; job: the item's, else the batch's, else from the id."""
    first = batch.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where("place = 1").drop("place")
    own = F.coalesce(F.col("job"), F.lit(job), job_of(F.col("item_id"))) if "job" in batch.columns else F.coalesce(F.lit(job), job_of(F.col("item_id")))
    return first.join(ledger.select("item_id"), "item_id", "left_anti").withColumn("job", own).withColumn("state", F.lit("pending"))


def job_label(batch: DataFrame, label: str, job: str | None = None) -> DataFrame:
    """The label's job: the batch's, else the only one its items have; a mixed batch labels nothing."""
    if job is not None:
        return batch.limit(1).select(F.lit(job).alias("job"), F.lit(label).alias("label"))
    return batch.agg(F.min("job").alias("job"), F.count_distinct("job").alias("n")).where("n = 1").select("job", F.lit(label).alias("label"))


def skip_existing(targets: DataFrame, outputs: DataFrame, match: str = "path") -> DataFrame:
    """Targets whose output does not exist yet (`path`), or not in the same size (`path_size`)."""
    return targets.join(outputs, ["rel_path"] if match == "path" else ["rel_path", "size"], "left_anti")


def edge_each(up: DataFrame, down: DataFrame) -> DataFrame:
    """Keys done upstream that are absent downstream in any state."""
    keys = up.where("state = 'done'").select(item_key(F.col("item_id")).alias("key")).distinct()
    return keys.join(down.select(item_key(F.col("item_id")).alias("key")), "key", "left_anti")


def edge_barrier(up: DataFrame, kind: str, k: int = 0) -> DataFrame:
    """Is the barrier open? quorum: at least k done; all: some items, and every one done."""
    if kind not in ("quorum", "all"):
        raise ValueError(f"unknown barrier {kind!r}")
    one = up.agg(F.count("*").alias("total"), F.count_if(F.col("state") == "done").alias("done"))
    return one.select("total", "done", ((F.col("done") >= k) if kind == "quorum" else (F.col("total") > 0) & (F.col("done") >= F.col("total"))).alias("open"))


def edge_artifact(required: DataFrame, manifest: DataFrame) -> DataFrame:
    """Open if paths are required and all exist."""
    there = manifest.select("rel_path", F.lit(True).alias("there")).distinct()
    return required.join(there, "rel_path", "left").agg(F.count("*").alias("required"), F.count("there").alias("present")).select("required", "present", ((F.col("required") > 0) & (F.col("required") == F.col("present"))).alias("open"))


def cooldown_exclude(pairs: DataFrame, blocked: DataFrame, recent: DataFrame, now: int, cooldown_s: int = 30) -> DataFrame:
    """(host, item) pairs without banned hosts, and without items the same host gave back within the cooldown."""
    held = recent.where(F.col("ts") + cooldown_s > now).select("host", "item_id")
    return pairs.join(blocked.select("host"), "host", "left_anti").join(held, ["host", "item_id"], "left_anti")


def attach_runner(ledger: DataFrame, runners: DataFrame) -> DataFrame:
    """Launch command and task of each item's runner, blank if it is unknown."""
    out = ledger.join(runners.select("runner_id", "launch_command", "task"), "runner_id", "left")
    return out.fillna("", ["launch_command", "task"])


def launch_commands(ledger: DataFrame, runners: DataFrame) -> DataFrame:
    """Per job the distinct launch commands of its runners, blank ones left out, in the order of the first runner of each."""
    used = ledger.where("runner_id is not null").select("job", "runner_id").distinct().join(runners.where("launch_command <> ''").select("runner_id", "launch_command"), "runner_id")
    first = used.groupBy("job", "launch_command").agg(F.min("runner_id").alias("first"))
    return first.groupBy("job").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "launch_command"))), lambda x: x["launch_command"]).alias("commands"))  # as many as runners differ


def missing_hosts(configured: DataFrame, runners: DataFrame, now: int, stale_s: int = 120) -> DataFrame:
    """Configured hosts, in lower case, without a runner seen lately."""
    live = runners.where((F.lit(now) - F.col("last_seen") <= stale_s) & ~F.col("host").isin("", "?")).select(F.lower("host").alias("host"))
    return configured.select(F.lower("host").alias("host")).distinct().join(live, "host", "left_anti")


def attribute_origins(alerts: DataFrame, ledger: DataFrame, origins: DataFrame) -> DataFrame:
    """Who owns open work on an alert's disk, or on any disk where the alert names none, with the callback they left.

    Owners stand under their disk and once more under `all`, so that this is one equi-join.
    """
    who = ("kind", "agent_id", "callback")
    work = ledger.where(F.col("state").isin("leased", "pending")).select("job", "disk").distinct().join(origins, "job")
    scope = F.explode(F.array(F.struct(F.col("disk").alias("disk"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("disk"), F.lit(True).alias("all"))))
    owners = work.select(scope.alias("at"), *who).select("at.disk", "at.all", *who).distinct()
    asked = alerts.select("alert_id", F.col("disk").alias("on"), F.col("disk").isNull().alias("every"))
    return asked.join(owners, (F.col("every") == F.col("all")) & F.col("on").eqNullSafe(F.col("disk"))).select("alert_id", *who).distinct()


def scope_alerts(alerts: DataFrame, disks: DataFrame) -> DataFrame:
    return alerts.where("disk is null").unionByName(alerts.where("disk is not null").join(disks.select("disk").distinct(), "disk", "left_semi").select(alerts.columns))


def code_drift(fingerprints: DataFrame, reference: DataFrame) -> DataFrame:
    """Per host and repository: in_sync, in_sync_dirty, stale, or unverifiable where a revision is missing."""
    f, r = fingerprints.alias("f"), reference.alias("r")
    sha, ref = F.coalesce(F.col("f.sha"), F.lit("")), F.coalesce(F.col("r.sha"), F.lit(""))
    state = F.when((sha == "") | (ref == ""), "unverifiable").when(sha != ref, "stale").when(F.coalesce(F.col("f.dirty"), F.lit(False)) | (F.coalesce(F.col("r.dirty"), F.lit(False)) if "dirty" in reference.columns else F.lit(False)), "in_sync_dirty").otherwise("in_sync")
    return f.join(r, F.col("f.repo") == F.col("r.repo"), "full_outer").select("f.host", F.coalesce("f.repo", "r.repo").alias("repo"), state.alias("state"))


def version_drift(versions: DataFrame, reference: DataFrame) -> DataFrame:
    """Per host and package it reports (the interpreter is the package `python`): the version wanted and whether it is that.

    Advice only. A package that the reference lacks doesn't match, and one that no host reports stands without a host.
    """
    wanted = reference.select("package", F.col("version").alias("wanted"))
    both = versions.select("host", "package", "version").join(wanted, "package", "full_outer")
    return both.select("host", "package", "version", "wanted", F.coalesce(F.col("version") == F.col("wanted"), F.lit(False)).alias("matches"))


def proportional_quota(groups: DataFrame, budget: int) -> DataFrame:
    """Each group's share of a budget by weight, one at least; null where there is nothing to share."""
    total = groups.agg(F.sum("weight").alias("_total"))
    share = F.when((F.col("_total") > 0) & F.lit(budget > 0), F.greatest(F.lit(1), F.ceil(F.col("weight") * budget / F.col("_total"))))
    return groups.join(F.broadcast(total)).withColumn("quota", share).drop("_total")  # one row


def _budgets(items: DataFrame, caps: DataFrame) -> DataFrame:
    """Per disk of the budget table: its cap, what is in flight on it, and what is free."""
    held = items.where("state = 'leased'").groupBy("disk").agg(F.count("*").alias("inflight"))
    out = caps.select("disk", "cap").join(held, "disk", "left").withColumn("inflight", F.coalesce("inflight", F.lit(0)))
    return out.withColumn("free", F.greatest(F.lit(0), F.col("cap") - F.col("inflight")))


def balanced_batch(items: DataFrame, caps: DataFrame, capacity: int) -> DataFrame:
    """Capped round-robin: each disk gives its oldest items, up to its cap less what is in flight on it, in turns; items
    without a disk, or on a disk without a cap, are one more stream, which comes last in a turn."""
    pending = items.where("state = 'pending'").select("item_id", "disk", "created_at").join(_budgets(items, caps).select("disk", F.col("free").alias("free"), F.lit(True).alias("capped")), "disk", "left")
    pending = pending.withColumn("stream", F.when(F.col("capped"), F.col("disk")))
    order = Window.partitionBy("stream").orderBy("created_at", "item_id")
    ranked = pending.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= capacity)
    first = ranked.where("turn = 1").select(F.col("stream").alias("s"), F.col("created_at").alias("seen"), F.col("item_id").alias("seen_id"))
    out = ranked.where("stream is null or turn <= free").join(first, F.col("stream").eqNullSafe(F.col("s")))
    return out.orderBy("turn", F.col("stream").isNull(), "seen", "seen_id").limit(capacity).select("item_id", "disk", "turn")


def batch_report(items: DataFrame, caps: DataFrame, batch: DataFrame, requested: int, capacity: int, banned: bool = False) -> DataFrame:
    """Why a batch is as large as it is: one row per disk of the budget table (one with a null disk where it is empty), with
    its budget, what was in flight and free on it, what it gave, the batch's size, all that was pending, and the reason.

    requested: what the host asked for; capacity: that, cut to the host's fair share. Reasons, the first that holds:
    HOST_BANNED; NO_PENDING; GRANTED_FULL, all that was asked for; FAIR_SHARE_CAP; DISK_BUDGET_FULL, items were left;
    GRANTED_FULL, as nothing was left.
    """
    one = items.agg(F.count_if(F.col("state") == "pending").alias("pending_total")).join(batch.agg(F.count("*").alias("granted")))  # one row each
    reason = (
        F.when(F.lit(banned), "HOST_BANNED").when(F.col("pending_total") == 0, "NO_PENDING").when(F.col("granted") >= requested, "GRANTED_FULL")
        .when(F.lit(capacity < requested) & (F.col("granted") >= capacity), "FAIR_SHARE_CAP").when(F.col("granted") < F.col("pending_total"), "DISK_BUDGET_FULL").otherwise("GRANTED_FULL")
    )
    gave = batch.groupBy("disk").agg(F.count("*").alias("granted_here"))
    disks = _budgets(items, caps).join(gave, "disk", "left").select("disk", F.col("cap").alias("budget"), F.col("inflight").alias("inflight_before"), "free", F.coalesce("granted_here", F.lit(0)).alias("granted_here"))
    return F.broadcast(one.withColumn("reason", reason)).join(disks, how="left").select("disk", "budget", "inflight_before", "free", "granted_here", "granted", "pending_total", "reason")
