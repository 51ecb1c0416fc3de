"""Advice on the paths that items read and write, its gate, and the list of alerts that detectors raise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import rule_matches

# Findings that block an item, and the token that acknowledges each.
BLOCKING = {
    "smb.no_creds": "no_smb_creds",
    "read.not_direct": "no_direct_share",
    "output.parity": "parity_write",
    "output.direct_disk_write": "direct_disk_write",
    "input.unclassified_nas": "unclassified_nas",
    "output.unclassified_nas": "unclassified_nas",
}


@dataclass(frozen=True)
class Disk:
    """A configured disk: its id, the rule that assigns items to it, what it is, and the shares that lead to it."""

    disk: str
    match: str = ""
    kind: str = ""
    read: str = ""
    write: str = ""
    direct: str = ""
    parity: bool = False


def _norm(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "/+$", ""))


def _plain(path: str) -> str:
    return path.replace("\\", "/").rstrip("/").lower()


def _under(path: Column, share: str) -> Column:
    """Is a normal path the share or inside it? Nothing is inside a blank one."""
    s = _plain(share)
    return ((path == s) | F.startswith(path, F.lit(s + "/"))) if s else F.lit(False)


def _server(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "^//([^/]+)/", 1), F.lit(""))


def _pick(at: Column, disks: Sequence[Disk], what) -> Column:
    """A property, given as a column for each disk, of the disk at a place of the list; null without one."""
    return F.coalesce(*(F.when(at == i, what(d)) for i, d in enumerate(disks)), F.lit(None))


def advise_io(items: DataFrame, disks: Sequence[Disk], servers: DataFrame) -> DataFrame:
    """items with `findings`, an array of (level, code, message), and `severity`: warn if any finding warns, else ok.

    items: item_id, read_root, write_root, sample_src, sample_dst. disks: the configured topology, a short list. servers:
    one row each, with have_creds and brokered; a server without a row has neither. An item belongs to the first disk
    whose rule its id and paths match, else to the first that has a share around its root. No path is changed.
    """
    r, w, src, dst = (_norm(F.col(c)) for c in ("read_root", "write_root", "sample_src", "sample_dst"))
    rows = items.withColumns({"_r": r, "_w": w, "_src": src, "_dst": dst, "_rs": _server(r), "_ws": _server(w)})
    r, w = F.col("_r"), F.col("_w")
    for side in ("r", "w"):  # servers are few, and no one-sided hint is needed
        known = servers.select(F.lower("server").alias(f"_{side}s"), F.col("have_creds").alias(f"_{side}c"), F.col("brokered").alias(f"_{side}b"))
        rows = rows.join(known, f"_{side}s", "left")

    def by_share(root: Column) -> Column:
        return F.coalesce(*(F.when(_under(root, d.read) | _under(root, d.write) | _under(root, d.direct), i) for i, d in enumerate(disks)), F.lit(None).cast("int"))

    def disk_of(root: str, sample: str, path: Column) -> Column:
        text = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("item_id", root, sample)))
        return F.coalesce(*(F.when(rule_matches(text, d.match), i) for i, d in enumerate(disks)), by_share(path))

    rows = rows.withColumns({"_in": disk_of("read_root", "sample_src", r), "_out": disk_of("write_root", "sample_dst", w), "_share": by_share(r)})
    there, gone = F.col("_in"), F.col("_out")
    nas = lambda root, sample: F.col(f"_{root}s").isNotNull() | _server(F.col(sample)).isNotNull()
    given = lambda *cs: F.coalesce(*(F.when(F.col(c) != "", True) for c in cs), F.lit(False))
    kind = lambda at: F.lower(_pick(at, disks, lambda d: F.lit(d.kind)))
    fast = lambda at, name: kind(at) == name
    slow = _pick(there, disks, lambda d: (F.lit(bool(_plain(d.read))) & ~(_under(r, d.read) | _under(r, d.direct))))
    raw = _pick(gone, disks, lambda d: _under(w, d.direct) | (F.lit(bool(_plain(d.read) and _plain(d.write) and _plain(d.read) != _plain(d.write))) & _under(w, d.read)))
    slow, raw = (F.coalesce(c.cast("boolean"), F.lit(False)) for c in (slow, raw))
    parity = F.coalesce(_pick(gone, disks, lambda d: F.lit(d.parity)), F.lit(False))
    creds = lambda side: F.coalesce(F.col(f"_{side}c"), F.lit(False))
    broker = lambda side: F.coalesce(F.col(f"_{side}b"), F.lit(False))
    second = F.col("_ws").isNotNull() & ~F.col("_ws").eqNullSafe(F.col("_rs"))
    checks = [
        ("ok", "topology.none", F.lit(not disks), "no disks are configured, so storage is not considered"),
        *((level, code, cond & ~creds(side) & (broker(side) if code == "smb.brokered" else ~broker(side)), text)
          for side, cond in (("r", F.col("_rs").isNotNull()), ("w", second))
          for level, code, text in (("ok", "smb.brokered", "credentials for the server are handed out when a runner starts"), ("warn", "smb.no_creds", "no credentials for the server: the slow way through the system is taken"))),
        ("warn", "input.hdd", fast(there, "hdd"), "inputs lie on a spinning disk: keep few readers on it"),
        ("ok", "input.nvme", fast(there, "nvme"), "inputs lie on flash: many readers are fine"),
        ("ok", "input.ssd", fast(there, "ssd"), "inputs lie on flash: many readers are fine"),
        ("warn", "read.not_direct", slow & (F.contains(r, F.lit("/mnt/user")) | F.col("_share").eqNullSafe(there)), "a direct share of the disk is faster than the pooled root"),
        ("warn", "input.unclassified_nas", there.isNull() & given("_r", "_src") & nas("r", "_src"), "inputs on a network share that no disk rule matches"),
        ("ok", "input.unknown", there.isNull() & given("_r", "_src") & ~nas("r", "_src"), "inputs match no configured disk"),
        ("warn", "output.parity", parity, "every write to a parity array costs a read, a change and two writes"),
        ("ok", "output.nvme", ~parity & fast(gone, "nvme"), "outputs go to flash"),
        ("ok", "output.ssd", ~parity & fast(gone, "ssd"), "outputs go to flash"),
        ("warn", "output.direct_disk_write", raw, "writes past the pooled share can leave two files of one name"),
        ("warn", "output.unclassified_nas", gone.isNull() & nas("w", "_dst"), "outputs on a network share that no disk rule matches"),
    ]
    finding = lambda level, code, text: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(text).alias("message"))
    found = F.filter(F.array(*(F.when(cond, finding(level, code, text)) for level, code, cond, text in checks)), lambda x: x.isNotNull())
    rows = rows.select(*items.columns, found.alias("findings"))
    return rows.withColumn("severity", F.when(F.exists("findings", lambda x: x["level"] == "warn"), "warn").otherwise("ok"))


def gate_io(advised: DataFrame, acks: str | None = None) -> DataFrame:
    """advise_io()'s rows with `blocked`, the blocking codes without an acknowledgement, the tokens still needed and those used.

    acks: an array column of tokens that the item's creator gave; null is none.
    """
    tokens = F.create_map(*(F.lit(x) for pair in BLOCKING.items() for x in pair))
    have = F.coalesce(F.col(acks), F.expr("cast(array() as array<string>)")) if acks else F.expr("cast(array() as array<string>)")
    blocking = F.filter(F.transform("findings", lambda x: x["code"]), lambda c: c.isin(*BLOCKING))
    rows = advised.withColumn("_codes", blocking).withColumn("reasons", F.filter("_codes", lambda c: ~F.array_contains(have, tokens[c])))
    needed = F.array_distinct(F.transform("reasons", lambda c: tokens[c]))
    used = F.sort_array(F.array_distinct(F.filter(F.transform("_codes", lambda c: tokens[c]), lambda t: F.array_contains(have, t))))
    return rows.withColumns({"blocked": F.size("reasons") > 0, "needed": needed, "acknowledged": used}).drop("_codes")


def blank_as_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def alert_name() -> Column:
    """An alert's fingerprint: its own, else code:disk, or code:* without a disk."""
    return F.coalesce(blank_as_null("fingerprint"), F.concat("code", F.lit(":"), F.coalesce(blank_as_null("disk"), F.lit("*"))))


def dedup_alerts(firings: DataFrame, resolves: DataFrame | None = None, keep: int = 500) -> DataFrame:
    """One row per alert: how often it fired, from when to when, what it said last, and whether it is active.

    firings: ts, seq, severity, code, disk, detail, action, url, origins, fingerprint. Alerts of one fingerprint, by
    default code:disk (code:* without a disk), are one; url and origins keep their last value that isn't blank. An alert
    is active unless it was resolved (ts, seq, fingerprint) after it last fired. The `keep` alerts that fired last stay.
    """
    filled = blank_as_null
    rows = firings.withColumn("fingerprint", alert_name()).withColumn("at", F.struct("ts", "seq"))
    by = rows.groupBy("fingerprint").agg(
        F.min_by("code", "at").alias("code"), F.min_by("disk", "at").alias("disk"), F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("at").alias("at"),
        *(F.max_by(c, "at").alias(c) for c in ("severity", "detail", "action")), *(F.max_by(filled(c), F.when(filled(c).isNotNull(), F.col("at"))).alias(c) for c in ("url", "origins")))
    by = by.withColumn("last_ts", F.col("at.ts")).withColumn("last_seq", F.col("at.seq"))
    active = F.lit(True)
    if resolves is not None:
        by = by.join(resolves.groupBy("fingerprint").agg(F.max(F.struct("ts", "seq")).alias("ended")), "fingerprint", "left")
        active = F.coalesce(F.col("at") > F.col("ended"), F.lit(True))
    out = by.withColumn("active", active).orderBy(F.desc("last_ts"), F.desc("last_seq"), "fingerprint").limit(keep)
    return out.select("fingerprint", "code", "disk", "count", "first_ts", "last_ts", "severity", "detail", "action", "url", "origins", "active")
