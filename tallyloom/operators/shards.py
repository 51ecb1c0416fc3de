"""Balanced shard plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

_TURNS = "size long, first long, turns array<struct<begin:bigint,shards:array<int>>>"


def shard_summary(plan: DataFrame) -> DataFrame:
    """Per shard of a plan its files, bytes and share of all bytes in percent, and the plan's skew: the largest over the mean."""
    by = plan.groupBy("shard").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    all_ = by.agg(F.sum("bytes").alias("all_bytes"), (F.max("bytes") / F.avg("bytes")).alias("skew"))
    return by.join(F.broadcast(all_)).select("shard", "files", "bytes", (100.0 * F.col("bytes") / F.nullif("all_bytes", F.lit(0))).alias("percent"), "skew")  # one row


def turns(loads: np.ndarray, size: int, count: int) -> list[tuple[int, list[int]]]:
    """Which shards get `count` files of one size, each going to the lightest shard (the lowest of several); adds to loads.

    As (place from which on, shards in turn): files level by level of `size` bytes, those shards that have been reached
    take one each, by what they hold beyond whole levels.
    """
    if size <= 0 or count == 1:
        i = int(np.argmin(loads))
        loads[i] += max(size, 0) * count
        return [(0, [i])]
    level, over = np.divmod(loads, size)
    order = np.lexsort((np.arange(len(loads)), over))
    out, at = [], 0
    reached = np.unique(level)
    for this, following in zip(reached, [*reached[1:], None], strict=True):
        shards = order[level[order] <= this]
        n = count - at if following is None else min(count - at, int(following - this) * len(shards))
        out.append((at, shards.tolist()))
        loads[shards] += n // len(shards) * size
        loads[shards[: n % len(shards)]] += size
        at += n
        if at == count:
            break
    return out


def shard_plan(manifest: DataFrame, n: int) -> DataFrame:
    """Shard 1 to n for each file: rel_path, size, shard. Files go one by one, the largest first (ties by path), to the
    lightest shard, the lowest on ties. A null or negative size counts as 0.

    Files of one size are placed as a run: one task walks the distinct sizes, with the n loads in hand, and says for each
    size which shards take turns; a file's place among those of its size gives its shard. Places come from one sort and
    the number of rows in each of its parts, so files go through neither the driver nor a single task.
    """
    files = manifest.select("rel_path", F.greatest(F.coalesce("size", F.lit(0)).cast("long"), F.lit(0).cast("long")).alias("size"))
    # the sort is kept, as its parts are counted and then numbered
    placed = cut(files.orderBy(F.desc("size"), "rel_path").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    begins = parts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))  # a row for each part

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads, first = np.zeros(n, np.int64), 0
        for batch in batches:
            found = []
            for size, count in zip(batch["size"].tolist(), batch["count"].tolist(), strict=True):
                found.append((size, first, [{"begin": at, "shards": [i + 1 for i in shards]} for at, shards in turns(loads, size, count)]))
                first += count
            yield pd.DataFrame(found, columns=["size", "first", "turns"])

    sizes = placed.groupBy("size").count().repartition(1).sortWithinPartitions(F.desc("size")).mapInPandas(walk, _TURNS)
    ranked = placed.withColumn("part", part).join(begins, "part").withColumn("rank", F.col("begin") + F.col("id").bitwiseAND((1 << 33) - 1))
    both = ranked.join(sizes, "size").withColumn("place", F.col("rank") - F.col("first"))
    turn = F.element_at(F.filter("turns", lambda t: t["begin"] <= F.col("place")), -1)
    shard = F.element_at(turn["shards"], (F.pmod(F.col("place") - turn["begin"], F.size(turn["shards"])) + 1).cast("int"))
    return both.select("rel_path", "size", shard.alias("shard"))
