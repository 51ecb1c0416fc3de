"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt to shards of bounded size, of like direction. Each shard sorts its rows once along every dimension. An anchor
walks these lists from the end that its own sign makes good (sorted access), scores each row the first time any list
shows it (random access, in integers), and leaves a shard once the best score that an unseen row could have falls
strictly below the score of each window's k-th row found. What it found in its own shard goes along to all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, typed

#: Rows of a shard and anchors of a block, at most; the rows that the first step of sorted access reads from each list.
ROWS, ANCHORS, STEP = 32_768, 512, 16
#: Bytes of one shard's vectors, at most, but for a single longer one.
SHARD_BYTES = 16 << 20
_LEAST = -(1 << 63)

_SHARD = "shard long, ids binary, labels binary, chosen binary, width int, matrix binary"
_WANTED = "array<struct<at:int,slot:int,score:bigint>>"
_HAD = "array<struct<at:int,slot:int,score:bigint,vec_id:bigint>>"
_FOUND = "block long, at int, slot int, anchor_id long, score long, vec_id long"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, chosen, x) of a partition as shards, in their order; shorter vectors are filled up by zeros."""
    held: list[tuple[int, int, bool, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        width = max(len(h[3]) for h in held)
        matrix = np.zeros((len(held), width), "<i4")
        for row, h in zip(matrix, held, strict=True):
            row[: len(h[3])] = h[3]
        cols = [np.array([h[0] for h in held], "<i8").tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), np.array([h[2] for h in held], "u1").tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in cols), pa.array([width], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["ids", "labels", "chosen", "width", "matrix"])

    for batch in batches:
        for vec_id, label, chosen, x in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            x = x.values.to_numpy().astype("<i4")
            if held and (len(held) >= ROWS or size + 4 * len(x) > SHARD_BYTES):
                yield out()
                held, size = [], 0
            held.append((vec_id, label, chosen, x))
            size += 4 * len(x)
    if held:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each shard as blocks, which are shaped like shards."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels, matrix = (np.frombuffer(row[c], k) for c, k in (("ids", "<i8"), ("labels", "<i8"), ("matrix", "<i4")))
            at = np.flatnonzero(np.frombuffer(row["chosen"], "u1"))
            for some in (at[i : i + ANCHORS] for i in range(0, len(at), ANCHORS)):
                cols = [ids[some].tobytes(), labels[some].tobytes(), b"", row["width"], matrix.reshape(len(ids), -1)[some].tobytes() if row["width"] else b""]
                kinds = [pa.binary()] * 3 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int64()), *(pa.array([c], k) for c, k in zip(cols, kinds, strict=True))], [c.split()[0] for c in _SHARD.split(", ")])


class Lists:
    """One shard: its rows, and along every dimension their order by value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.order = np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(np.ascontiguousarray(matrix.T), self.order, 1)
        self.read = 0  # rows scored so far, for tests and figures
        self.largest = int(np.abs(matrix.astype(np.int64)).max(initial=0))

    def search(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[Best]) -> None:
        """Offers the windows every allowed row that can be among their best."""
        n, width = len(self.ids), min(len(anchor), self.matrix.shape[1])
        a = anchor[:width].astype(np.int64)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        a_up, a_down = a[up], a[down]
        # sums below 2**53 are exact in doubles, which are multiplied faster
        exact = np.float64 if int(np.abs(a).sum()) * self.largest < 1 << 53 else np.int64
        weights = a.astype(exact)
        seen = ~allowed
        depth, step = 0, STEP
        if not n:
            return
        if not len(up) and not len(down):  # all scores are 0, and no list says more about them
            rows = np.flatnonzero(allowed)
            for w in windows:
                w.offer(np.zeros(len(rows), np.int64), self.ids[rows])
            return
        limit = self._limit(up, down, a_up, a_down, 1)  # no row scores more
        while depth < n and (still := [w for w in windows if w.open(limit)]):
            to = min(n, depth + step)
            shown = np.zeros(n, bool)
            shown[self.order[up, n - to : n - depth]] = True
            shown[self.order[down, depth:to]] = True
            rows = np.flatnonzero(shown & ~seen)
            seen[rows] = True
            self.read += len(rows)
            if len(rows):
                scores = (self.matrix[rows, :width].astype(exact) @ weights).astype(np.int64)
                for w in still:
                    w.offer(scores, self.ids[rows])
            limit = self._limit(up, down, a_up, a_down, to)
            depth, step = to, step * 2

    def _limit(self, up: np.ndarray, down: np.ndarray, a_up: np.ndarray, a_down: np.ndarray, depth: int) -> int:
        n = len(self.ids)
        return int((a_up * self.values[up, n - depth]).sum() + (a_down * self.values[down, depth - 1]).sum())


class Best:
    """The k best rows found with scores from lo to hi, by falling score, then by id; rows known beforehand only set how
    good a row must be, and are not found again."""

    def __init__(self, k: int, lo: int = _LEAST, hi: int = -_LEAST - 1, known: list[int] | None = None):
        self.k, self.lo, self.hi = k, lo, hi
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if known and len(known) >= k:
            self.lo = max(lo, sorted(known)[-k])

    def open(self, limit: int) -> bool:
        """False once what is unseen scores strictly below the k-th row, or below the window."""
        return limit >= (self.scores[-1] if len(self.scores) >= self.k else self.lo) and self.lo <= self.hi

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        least = max(self.lo, int(self.scores[-1])) if len(self.scores) >= self.k else self.lo
        fit = (scores >= least) & (scores <= self.hi)
        if fit.any():
            scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
            keep = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[keep], ids[keep]


def _walk(k: int, low: int, high: int):
    """mapInArrow over rows sorted so that each shard comes before the blocks of anchors that search it.

    Without `wanted`, an anchor's best rows of its own label are sought; with it, rows of other labels, for each wanted
    (anchor, slot, positive score) those that score from low to high hundredths of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, name = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                matrix = np.frombuffer(row["matrix"], "<i4").reshape(len(ids), row["width"])
                if row["block"] is None:
                    lists, name = Lists(ids, labels, matrix), row["shard"]
                    continue
                assert lists is not None and name == row["shard"]
                had: dict[tuple[int, int], list[int]] = {}
                for x in row["had"] or []:
                    had.setdefault((x["at"], x["slot"]), []).append(x["score"])
                asked: dict[int, list[tuple[int, Best]]] = {}
                if row["wanted"] is None:
                    asked = {at: [(0, Best(k, known=had.get((at, 0))))] for at in range(len(ids))}
                else:
                    for x in row["wanted"]:
                        lo, hi = -((-low * x["score"]) // 100), high * x["score"] // 100
                        if lo <= hi:
                            asked.setdefault(x["at"], []).append((x["slot"], Best(k, lo, hi, had.get((x["at"], x["slot"])))))
                found: list[tuple] = []
                for at, windows in asked.items():
                    same = lists.labels == labels[at]
                    allowed = same & (lists.ids != ids[at]) if row["wanted"] is None else ~same
                    lists.search(matrix[at], allowed, [w for _, w in windows])
                    for slot, w in windows:
                        found += [(row["block"], at, slot, int(ids[at]), s, v) for s, v in zip(w.scores.tolist(), w.ids.tolist(), strict=True)]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot, with their rank; Spark drops all others before it shuffles."""
    by = Window.partitionBy("block", "at", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _listed(rows: DataFrame, *fields: str) -> DataFrame:
    """Rows as one list per block of anchors; a block has a bounded number of anchors, and each a bounded number of rows."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("list"))


def mine(vectors: DataFrame, anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Per anchor and positive, the first `negatives` rows of other labels that score from `low` to `high` hundredths of
    the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors(vec_id, label, embedding); `anchor` and `label` are expressions over vec_id and label. Components become
    floor(scale * x); scores are integer inner products; higher ones come first, ties by smaller vec_id. An anchor's
    positives are its first rows of the same label with another vec_id. Exact, whatever the data: only how much is read
    depends on them.

    Rows whose vec_id, label or vector is null, or that hold a null or non-finite component, take no part. Vectors of
    several lengths meet as if the shorter were filled up by zeros. Components beyond 2**30, or beyond the root of 2**62
    divided by the vector's length, count as that bound, so that no score overflows. A repeated vec_id counts once for
    each of its rows, as a candidate and as an anchor. An anchor without positives, and a positive below 0 or
    without rows in its window, give no rows; so does an empty table.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    base = typed(vectors, vec_id="long", label="long", embedding="array<double>")
    base = base.select("vec_id", label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("chosen"), "embedding").where("vec_id is not null and label is not null")
    base = base.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    bound = F.least(F.lit(2.0**30), F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size("embedding"), F.lit(1)))).cast("double"))
    whole = base.select("vec_id", "label", "chosen", F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), bound), -bound).cast("int")).alias("x"))
    # like directions come together: the strongest component with its sign, then the label
    size = F.transform("x", F.abs)
    place = F.array_position(size, F.array_max(size)).cast("int")
    lead = F.when(F.size("x") > 0, place * F.signum(F.try_element_at("x", F.greatest(place, F.lit(1)))).cast("int")).otherwise(0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // ROWS))
    order = ["lead", "label", "vec_id"]
    dealt = whole.withColumn("lead", lead).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "chosen", "x")
    shards = scratch.save(dealt.mapInArrow(_pack, "ids binary, labels binary, chosen binary, width int, matrix binary").select(F.monotonically_increasing_id().alias("shard"), "*"), "shards")
    blocks = scratch.save(shards.mapInArrow(_cut, _SHARD).select(F.monotonically_increasing_id().alias("block"), F.col("shard").alias("home"), "ids", "labels", "width", "matrix"), "blocks")

    def searched(callers: DataFrame, k: int) -> DataFrame:
        """callers(shard, block, ..., wanted, had): each block searches the shard it names."""
        columns = "shard", "block", "ids", "labels", "width", "matrix", "wanted", "had"
        own = shards.select("shard", F.lit(None).cast("long").alias("block"), "ids", "labels", "width", "matrix", F.lit(None).cast(_WANTED).alias("wanted"), F.lit(None).cast(_HAD).alias("had"))
        both = own.select(*columns).unionByName(callers.select(*columns))
        return both.repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("block")).mapInArrow(_walk(k, low, high), _FOUND)

    names = shards.select(F.col("shard").alias("to"))

    def best(callers: DataFrame, k: int, name: str) -> DataFrame:
        """The anchors' own shards first, then all others, where what was found at home must be reached."""
        home = scratch.save(searched(callers.select(F.col("home").alias("shard"), "*", F.lit(None).cast(_HAD).alias("had")), k), f"{name}-home")
        known = callers.join(_listed(_best(home, k), "at", "slot", "score", "vec_id").withColumnRenamed("list", "had"), "block", "left")
        # a stated set of queries against all rows: every block of anchors goes to every shard, by the list of shards
        every = names.agg(F.collect_list("to").alias("all"))  # 8 bytes for each shard of up to ROWS rows
        away = known.join(F.broadcast(every)).select("*", F.explode("all").alias("shard")).where("shard <> home")
        rest = scratch.save(searched(away, k), f"{name}-rest")
        out = scratch.save(_best(home.unionByName(rest), k), name)
        scratch.drop(f"{name}-home", f"{name}-rest")
        return out

    first = best(blocks.withColumn("wanted", F.lit(None).cast(_WANTED)), positives, "positives")
    chosen = first.select("block", "at", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    asked = _listed(chosen.select("block", "at", "slot", F.col("positive_score").alias("score")), "at", "slot", "score").withColumnRenamed("list", "wanted")
    second = best(blocks.join(asked, "block"), negatives, "negatives")
    out = second.join(chosen, ["block", "at", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return scratch.only(out)
