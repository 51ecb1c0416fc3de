"""Scalar expressions over work items, results and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error texts that no retry can mend, in order of precedence, and local faults matched whole.
PERMANENT = (
    "nt_status_logon_failure", "logonfailure", "0xc000006d", "nt_status_access_denied", "access_denied",
    "accessdenied", "0xc0000022", "permissionerror", "no_smb_creds", "unclassified_nas",
)
LOCAL_FAULTS = ("timeout", "pool_reset")


def error_signature(error: Column) -> Column:
    """The first permanent token in the text, else its first 40 characters with white space collapsed, `<none>` if empty."""
    low = F.lower(error)
    found = F.coalesce(*(F.when(F.contains(low, F.lit(t)), t) for t in PERMANENT))
    flat = F.substring(F.trim(F.regexp_replace(error, r"\s+", " ")), 1, 40)
    return F.coalesce(found, F.when(flat != "", flat), F.lit("<none>"))


def classify_result(status: Column, error: Column) -> Column:
    """ok, permanent or transient."""
    fine = status.isin("ok", "skipped", "requeue") | F.coalesce(F.lower(F.trim(error)).isin(*LOCAL_FAULTS), F.lit(False))
    hard = F.coalesce(*(F.when(F.contains(F.lower(error), F.lit(t)), True) for t in PERMANENT), F.lit(False))
    return F.when(fine, "ok").when(hard, "permanent").otherwise("transient")


def job_of(item_id: Column) -> Column:
    """What precedes the last slash, `(ungrouped)` if nothing does."""
    head = F.regexp_extract(item_id, r"^(.+)/[^/]*$", 1)
    return F.when(head != "", head).otherwise("(ungrouped)")


def item_key(path: Column) -> Column:
    """File name without `.npz` and without a short alphanumeric prefix before a dash."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.npz$", "")
    return F.regexp_replace(name, r"^[A-Za-z0-9]{1,8}-", "")


def shard_of(path: Column, depth: int = 1) -> Column:
    """The first folders of a path, `(root)` if it has none."""
    folders = F.slice(F.split(path, "/"), 1, F.least(F.lit(depth), F.size(F.split(path, "/")) - 1))
    return F.when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise("(root)")


def hash_shard(path: Column, n: int) -> Column:
    """Stable bin 1 to n from the first 32 bits of the path's SHA-1, with forward slashes."""
    first = F.conv(F.substring(F.sha1(F.translate(path, "\\", "/")), 1, 8), 16, 10).cast("long")
    return (1 + first % max(1, n)).cast("int")


def job_health(leased: Column, pending: Column, rate: Column, last_completed: Column, last_leased: Column, now: int, stall_s: int = 600) -> Column:
    """idle, stalled, running, queued or active: the first that fits."""
    seen = F.coalesce(F.when(last_completed != 0, last_completed), last_leased)
    return (
        F.when((leased <= 0) & (pending <= 0), "idle")
        .when((leased > 0) & (rate <= 0) & (F.lit(now) - seen >= stall_s), "stalled")
        .when((leased > 0) & (rate > 0), "running")
        .when((pending > 0) & (leased == 0), "queued")
        .otherwise("active")
    )


def render(template: str, stem: Column) -> Column:
    """A template with {stem} filled in, and {clip}, the stem's file."""
    return F.replace(F.replace(F.lit(template), F.lit("{stem}"), stem), F.lit("{clip}"), F.concat(stem, F.lit(".npz")))


# Command-line flags whose values are secret.
SECRET_FLAGS = ("--token", "--password")


def mask_flags(command: Column) -> Column:
    """A command line with the values of secret flags, after a blank or =, replaced by ***."""
    names = "|".join(SECRET_FLAGS)
    return F.regexp_replace(command, rf"(^|\s)({names})(=|\s+)(\S+)", "$1$2$3***")


def redact(text: Column, secrets: Sequence[str]) -> Column:
    """Each secret of six characters or more gives way to its first three and a mark, the longest first."""
    for s in sorted((s for s in secrets if len(s) >= 6), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit(f"{s[:3]}…REDACTED"))
    return text
