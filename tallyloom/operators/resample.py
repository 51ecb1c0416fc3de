"""Rotations on an even grid of times: spherical interpolation without a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _unit(q: Sequence[Column]) -> list[Column]:
    norm = F.greatest(F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0])), F.lit(1e-8))
    return [c / norm for c in q]


def resample_slerp(frames: DataFrame, fps: Sequence[float]) -> DataFrame:
    """Each (clip, joint)'s rotations at k / fps seconds after its first frame, along the shorter arc, with qw >= 0.

    frames: clip_id, joint, t, qw, qx, qy, qz, valid. A clip has floor(duration * fps) + 1 targets, one at least. Each
    frame makes the targets up to the next frame, so nothing is joined. A target is valid if both its frames are; a clip
    of one frame gives that frame, valid. Rows with a null time or component take no part.
    """
    names = ["qw", "qx", "qy", "qz"]
    w = Window.partitionBy("clip_id", "joint").orderBy("t")
    whole = Window.partitionBy("clip_id", "joint")
    f = frames.dropna(subset=["t", *names]).select("clip_id", "joint", "t", *names, F.coalesce("valid", F.lit(False)).alias("valid"))
    ends = f.select("*", F.min("t").over(whole).alias("t_first"), F.max("t").over(whole).alias("t_last"), *(F.lead(c).over(w).alias(f"n_{c}") for c in ("t", *names, "valid")), F.lag("t").over(w).isNull().alias("alone"))
    last = F.col("n_t").isNull()
    each = ends.withColumn("fps", F.explode(F.array(*(F.lit(float(x)) for x in fps)))).withColumn("n_out", F.greatest(F.lit(1), F.floor((F.col("t_last") - F.col("t_first")) * F.col("fps") + 1e-9) + 1))
    at = lambda t: (t - F.col("t_first")) * F.col("fps")
    upto = F.when(last, F.col("n_out") - 1).otherwise(F.least(F.ceil(at(F.col("n_t"))) + 1, F.col("n_out") - 1))
    low = F.greatest(F.floor(at(F.col("t"))) - 1, F.lit(0))
    grid = each.where(upto >= low).withColumn("k", F.explode(F.sequence(low, upto))).withColumn("at", F.least(F.col("t_first") + F.col("k") / F.col("fps"), F.col("t_last")))
    grid = grid.where((F.col("at") >= F.col("t")) & (last | (F.col("at") < F.col("n_t"))))
    a, b = _unit([F.col(c) for c in names]), _unit([F.coalesce(f"n_{c}", c) for c in names])
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    gap = F.col("n_t") - F.col("t")
    grid = grid.select("clip_id", "joint", "fps", "k", "at", *(x.alias(f"a{i}") for i, x in enumerate(a)), *(x.alias(f"b{i}") for i, x in enumerate(b)), dot.alias("dot"), F.when(gap > 1e-8, (F.col("at") - F.col("t")) / gap).otherwise(0.0).alias("u"), F.when(last & F.col("alone"), True).otherwise(F.col("valid") & F.coalesce("n_valid", "valid")).alias("valid"))
    angle = F.acos(F.least(F.abs("dot"), F.lit(1.0)))
    grid = grid.withColumn("angle", angle).withColumn("sine", F.sin("angle"))
    flat, turn = F.col("sine") < 1e-6, F.when(F.col("dot") < 0, -1.0).otherwise(1.0)
    wa = F.when(flat, 1 - F.col("u")).otherwise(F.sin((1 - F.col("u")) * F.col("angle")) / F.col("sine"))
    wb = turn * F.when(flat, F.col("u")).otherwise(F.sin(F.col("u") * F.col("angle")) / F.col("sine"))
    mixed = grid.select("*", wa.alias("wa"), wb.alias("wb"))
    q = _unit([F.col("wa") * F.col(f"a{i}") + F.col("wb") * F.col(f"b{i}") for i in range(4)])
    side = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return mixed.select("clip_id", "joint", "fps", "k", F.col("at").alias("t"), *((side * c).alias(n) for n, c in zip(names, q, strict=True)), "valid")
