"""Closures of a dependency table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Steps along edges that one job takes, and jobs after which what has been reached becomes one table again.
HOPS, COMPACT = 6, 8


def dependency_closure(edges: DataFrame, roots: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """Every node reachable from the roots, them included, until nothing new turns up, so cycles end.

    Frontier joins, a few steps to a job. Edges and what has been reached are kept in the shared folder, dealt by node, so
    a step shuffles the nodes it meets and nothing else. Nodes that match one of the patterns in `without` (vendored
    paths) are neither reported nor passed through.
    """
    for pattern in without:
        edges, roots = edges.where(~F.col("dst").rlike(pattern)), roots.where(~F.col("node").rlike(pattern))
    edges = cut(edges.where("src <> dst").select(F.col("src").alias("node"), "dst").distinct().repartition("node"))
    reached = [cut(roots.select("node", F.lit(True).alias("last")).distinct().repartition("node"))]
    while True:
        level, found = reached[-1].where("last").select("node"), None
        for hop in range(HOPS):
            level = level.join(edges, "node").select(F.col("dst").alias("node")).distinct()
            here = level.withColumn("last", F.lit(hop == HOPS - 1))
            found = here if found is None else found.unionByName(here)
        # a node met on an earlier step has been passed through already
        fresh = found.groupBy("node").agg(F.min("last").alias("last"))
        for earlier in reached:
            fresh = fresh.join(earlier.select("node"), "node", "left_anti")
        fresh = cut(fresh)
        reached.append(fresh)
        if not fresh.where("last").head(1):
            break
        if len(reached) > COMPACT:
            whole = reached[0]
            for part in reached[1:]:
                whole = whole.unionByName(part)
            # what has been passed through is one table again; only its last part is gone on from
            reached = [cut(whole.select("node", F.lit(False).alias("last")).join(fresh.where("last").select("node"), "node", "left_anti").repartition("node")), cut(fresh.where("last"))]
    whole = reached[0]
    for part in reached[1:]:
        whole = whole.unionByName(part)
    return whole.select("node")
