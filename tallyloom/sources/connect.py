"""Data sources of Spark's Python API: folders listed in parallel, and the ledger files of an old coordinator.

Both read paths that executors see as files, such as mounted shares. Register them once with register(spark), then
spark.read.format("manifest") and spark.read.format("ledger") work like other formats.
"""

from __future__ import annotations

import fnmatch
import os
import sqlite3
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that listing is dealt into, at least where there are as many; rows of a ledger that one task reads.
FOLDERS, LEDGER_ROWS = 64, 50_000
_MANIFEST = "rel_path string, size bigint, mtime bigint, error string"
_ITEMS = "subjob_id string, spec string, job string, disk string, state string, lease_id string, runner_id string, host string, attempts int, leased_at double, lease_deadline double, completed_at double, error string, metrics string, created_at double"
_JOBS = "job string, label string, created_at double"


@dataclass
class Folders(InputPartition):
    """Folders to list, each with or without what lies under it, and what could not be read on the way to them."""

    paths: list[tuple[str, bool]]
    unread: list[tuple[str, str]]


def _list(path: str) -> tuple[list[os.DirEntry], str | None]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name), None
    except OSError as e:
        return [], e.strerror or type(e).__name__


class ManifestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = options["path"]
        self.root = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))
        self.pattern, self.deep = options.get("pattern", "*"), options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Goes down from the root, level by level, until there are enough folders to deal out; links are not followed."""
        done, level, unread = [], [self.root], []
        while self.deep and level and len(done) + len(level) < FOLDERS:
            below = []
            for path in level:
                entries, error = _list(path)
                if error:
                    unread.append((path, error))
                    continue
                done.append((path, False))
                below += [e.path for e in entries if e.is_dir(follow_symlinks=False)]
            level = below
        every = done + [(path, self.deep) for path in level]
        n = max(1, min(FOLDERS, len(every)))
        return [Folders(every[i::n], unread if i == 0 else []) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for path, error in partition.unread:
            yield self._rel(path), None, None, error
        todo = list(partition.paths)
        while todo:
            path, deep = todo.pop()
            entries, error = _list(path)
            if error:
                yield self._rel(path), None, None, error
            for e in entries:
                try:
                    if e.is_dir(follow_symlinks=False):
                        if deep:
                            todo.append((e.path, True))
                        continue
                    if fnmatch.fnmatchcase(e.name, self.pattern):
                        s = e.stat()
                        if stat.S_ISREG(s.st_mode):
                            yield self._rel(e.path), s.st_size, int(s.st_mtime), None
                except OSError as e2:
                    yield self._rel(e.path), None, None, e2.strerror or type(e2).__name__

    def _rel(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")


class ManifestSource(DataSource):
    """Files under `path` whose names fit the glob `pattern`, as rel_path, size and mtime; what may not be read is a row with
    its error. Options: path, pattern (*), recursive (true)."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return _MANIFEST

    def reader(self, schema) -> DataSourceReader:
        return ManifestReader(self.options)


@dataclass
class Rows(InputPartition):
    path: str
    table: str
    first: int
    last: int


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class LedgerReader(DataSourceReader):
    """Tables of one or more ledger files, by ranges of row numbers; columns that an old file lacks are null, and old names
    (jobs with a job_id, campaigns with a grp) are taken for the new ones."""

    def __init__(self, options: dict[str, str]):
        path = options["path"].removeprefix("file://").removeprefix("file:")
        self.paths = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".db", ".sqlite"))) if os.path.isdir(path) else [path]
        self.jobs = options.get("table", "subjobs") == "jobs"
        self.names = [c.split()[0] for c in (_JOBS if self.jobs else _ITEMS).split(", ")]

    def _columns(self, db: sqlite3.Connection, table: str) -> list[str]:
        return [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]

    def _table(self, db: sqlite3.Connection) -> str | None:
        tables = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        old = "jobs" in tables and "job_id" in self._columns(db, "jobs")
        if self.jobs:
            return "campaigns" if old and "campaigns" in tables else "jobs" if not old and "jobs" in tables else None
        return "subjobs" if "subjobs" in tables else "jobs" if old else None

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            with _open(path) as db:
                if table := self._table(db):
                    lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
                    found += [Rows(path, table, at, at + LEDGER_ROWS - 1) for at in range(lo, hi + 1, LEDGER_ROWS)] if lo is not None else []
        return found or [Rows("", "", 0, -1)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.path:
            return
        with _open(partition.path) as db:
            there = self._columns(db, partition.table)
            was = {"subjob_id": "job_id", "job": "grp"}
            # in an old table, job_id is the item's id and grp its job
            pick = [c if c in there else was.get(c) if was.get(c) in there else None for c in self.names]
            sql = ", ".join(f'"{c}"' if c else "NULL" for c in pick)
            kinds = [float if c in ("leased_at", "lease_deadline", "completed_at", "created_at") else int if c == "attempts" else str for c in self.names]
            for row in db.execute(f'SELECT {sql} FROM "{partition.table}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid', (partition.first, partition.last)):
                yield tuple(None if x is None else k(x) for x, k in zip(row, kinds, strict=True))


class LedgerSource(DataSource):
    """The items (table subjobs) or the labels (table jobs) of a coordinator's ledger file, or of all such files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return _JOBS if self.options.get("table", "subjobs") == "jobs" else _ITEMS

    def reader(self, schema) -> DataSourceReader:
        return LedgerReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ManifestSource)
    spark.dataSource.register(LedgerSource)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The items of a ledger: old coordinators' files (.db, .sqlite, or a folder of them), else Parquet. Epoch seconds become
    timestamps, to the microsecond; spec and metrics become maps of strings, empty where they are bad or missing JSON."""
    if path.endswith((".db", ".sqlite")) or (os.path.isdir(path) and any(f.endswith((".db", ".sqlite")) for f in os.listdir(path))):
        register(spark)
        rows = spark.read.format("ledger").load(path)
    else:
        rows = spark.read.parquet(path)
    times = [c for c in ("leased_at", "lease_deadline", "completed_at", "created_at") if c in rows.columns and rows.schema[c].dataType.typeName() != "timestamp"]
    empty = F.expr("cast(map() as map<string,string>)")
    rows = rows.withColumns({c: F.timestamp_micros(F.round(F.col(c).cast("double") * 1e6).cast("long")) for c in times})
    return rows.withColumns({c: F.coalesce(F.from_json(c, "map<string,string>"), empty) for c in ("spec", "metrics") if c in rows.columns and rows.schema[c].dataType.typeName() == "string"})


def scan_tree(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files: rel_path, size, mtime; unread: rel_path, error) under a root that all executors see. Folders are listed in
    parallel, and those that may not be read are passed over and named in the second table. No file is opened."""
    register(spark)
    rows = spark.read.format("manifest").options(pattern=pattern, recursive=str(recursive).lower()).load(root)
    return rows.where("error is null").select("rel_path", "size", "mtime"), rows.where("error is not null").select("rel_path", "error")
