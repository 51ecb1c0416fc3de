"""One step of a pipeline of stages: what every dependency between stages lets begin now."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import render
from .joins import edge_barrier, edge_each


class Stage(NamedTuple):
    """A stage's ledger, the templates of its items, and the files that show a command of it has run."""

    ledger: DataFrame
    id_template: str = ""
    spec_template: Mapping[str, Any] = {}
    produces: Sequence[str] = ()


class Edge(NamedTuple):
    """each: items done upstream begin downstream; quorum (k) and all: a barrier before a command; artifact: files that
    items of the downstream stage wait for."""

    up: str
    down: str
    kind: str
    k: int = 0
    artifact: Sequence[str] = ()


def _there(files: DataFrame, paths: Sequence[str]) -> DataFrame:
    """One row: do all the paths exist? Paths are a short configured list; none is not enough."""
    return files.where(F.col("rel_path").isin(list(paths))).agg(F.count_distinct("rel_path").alias("n")).select((F.lit(len(set(paths)) > 0) & (F.col("n") == len(set(paths)))).alias("there"))


def _spec(template: Mapping[str, Any], key: Column) -> Column:
    return F.to_json(F.struct(*((render(v, key) if isinstance(v, str) else F.lit(v)).alias(k) for k, v in template.items()))) if template else F.lit("{}")


def pipeline_tick(stages: Mapping[str, Stage], edges: Sequence[Edge], files: DataFrame, fired: Sequence[str] = ()) -> DataFrame:
    """(stage, item_id, spec): items to seed; a stage whose barrier has opened gives one row without item and spec.

    A barrier stays shut once its stage is in `fired` or the stage's products exist. Edges are checked before anything
    runs; each is planned by itself, so that an edge that is not ready does not hold back others. An item that several
    edges ask for comes once.
    """
    for e in edges:
        if e.kind not in ("each", "quorum", "all", "artifact") or (e.kind == "quorum" and e.k <= 0) or not {e.up, e.down} <= set(stages):
            raise ValueError(f"bad edge {e}")
    parts = []
    for e in edges:
        up, down = stages[e.up], stages[e.down]
        if e.kind == "each":
            keys = edge_each(up.ledger, down.ledger)
            for g in [x for x in edges if x.kind == "artifact" and x.down == e.down and x.artifact][:1]:
                keys = keys.join(F.broadcast(_there(files, g.artifact).where("there"))).drop("there")  # one row at most
            parts.append(keys.select(F.lit(e.down).alias("stage"), render(down.id_template, F.col("key")).alias("item_id"), _spec(down.spec_template, F.col("key")).alias("spec")))
        elif e.kind in ("quorum", "all") and e.down not in fired:
            ready = edge_barrier(up.ledger, e.kind, e.k).where("open").join(F.broadcast(_there(files, down.produces).where("not there")))  # one row each
            parts.append(ready.select(F.lit(e.down).alias("stage"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("spec")))
    if not parts:
        return files.limit(0).select(F.lit("").alias("stage"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("spec"))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["stage", "item_id"])
