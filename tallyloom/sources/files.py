"""Reading and writing work items, manifests, event logs and shard plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENT_SCHEMA = "ts double, subjob_id string, event string, host string, runner_id string, status string, error string"


def read_work_items(spark: SparkSession, path: str) -> DataFrame:
    """Items (subjob_id, spec, job) of JSON lines: an old job_id is taken as the id, a missing spec is {}, and a missing id
    is the SHA-1 of the rest of the row, so that a task run again gives the same. Blank and broken lines are dropped."""
    rows = spark.read.schema("subjob_id string, job_id string, spec string, job string, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.where("_corrupt_record is null")
    spec = F.coalesce("spec", F.lit("{}"))
    return rows.select(F.coalesce("subjob_id", "job_id", F.sha1(F.concat_ws("\n", spec, F.coalesce("job", F.lit(""))))).alias("subjob_id"), spec.alias("spec"), "job")


def write_work_items(items: DataFrame, path: str) -> None:
    items.select("subjob_id", "spec", "job").write.mode("overwrite").json(path)


def scan_manifest(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """rel_path, size and mtime of the files under a root whose names fit a glob; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(root)
    bare = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = root.split(":", 1)[-1] if ":/" in root else root
    base = "/" + base.strip("/") + "/"
    return files.select(F.substring(bare, F.lit(len(base) + 1), F.length("path")).alias("rel_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def read_event_log(spark: SparkSession, path: str, streaming: bool = False, schema: str | StructType = EVENT_SCHEMA) -> DataFrame:
    """Lifecycle or decision records, one JSON object a line; with streaming, files are read as they arrive."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def ingest_pressure_events(events: DataFrame) -> DataFrame:
    """Pressure events as flat columns: the killed root's pid and name, success as 0 or 1, time of receipt where ts is null."""
    return events.select("host", "rule", "signal", "action", "threshold", F.coalesce("succeeded", F.lit(False)).cast("int").alias("succeeded"), F.col("kill_root.pid").alias("kill_pid"), F.col("kill_root.name").alias("kill_name"), F.coalesce("ts", "received_at").alias("ts"), "received_at")


def write_sharded(plan: DataFrame, path: str, column: str = "shard", files: int = 1) -> None:
    """One folder shard=N per shard, in `files` files each, so that a heavy shard is not one task's work."""
    salt = F.pmod(F.xxhash64(*[c for c in plan.columns if c != column]), F.lit(files))
    plan.repartition(F.col(column), salt).write.mode("overwrite").partitionBy(column).parquet(path)


def normalize_legacy(items: DataFrame, campaigns: DataFrame | None = None) -> DataFrame:
    """Old column names as new ones (job_id to subjob_id, grp to job), absent disk and job as null, one row per id (the
    earliest created, then the smallest spec), a null job from the id's folder; labels of campaigns are joined on."""
    old = items
    for was, now in (("job_id", "subjob_id"), ("grp", "job")):
        if was in old.columns and now not in old.columns:
            old = old.withColumnRenamed(was, now)
    for c in ("disk", "job"):
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast("string"))
    order = [F.col(c) for c in ("created_at", "spec") if c in old.columns] or [F.lit(0)]
    cols = [c for c in old.columns if c != "subjob_id"]
    one = old.groupBy("subjob_id").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("subjob_id", "r.*")
    folder = F.regexp_extract("subjob_id", r"^(.+)/[^/]*$", 1)
    out = one.withColumn("job", F.coalesce("job", F.when(folder != "", folder), F.lit("(ungrouped)")))
    if campaigns is not None:
        labels = campaigns.groupBy("grp").agg(F.min_by("label", "created_at").alias("job_label"))
        out = out.join(labels.withColumnRenamed("grp", "job"), "job", "left")
    return out
