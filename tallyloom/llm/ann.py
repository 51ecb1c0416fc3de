"""Nearest neighbours by largest inner product: NN-descent (Dong et al., 2011) builds a neighbour graph with Spark joins,
and queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Neighbours a node keeps, rows compared at once when the graph starts and when it improves, and new neighbours that one comparison may give a node.
K, START_BLOCK, JOIN_BLOCK, GIVEN = 24, 256, 96, 10
#: The descent ends with the first round that changes less than this share of all edges.
STILL = 0.05
#: Every query is compared with this many longest vectors at first, and may start from the best of them.
LONGEST, ENTRIES = 512, 40
#: Queries that look at one node in one row of a hop, about; a node may be asked by all of them.
ASKED = 2048


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, similarity) of the `most` best columns of each row that are above -inf."""
    top = np.argpartition(-sims, min(most, sims.shape[1] - 1), axis=1)[:, :most]
    value = np.take_along_axis(sims, top, 1)
    good = value > -np.inf
    return np.repeat(ids, good.sum(1)), ids[top[good]], value[good]


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nearest rows among START_BLOCK that lie next to each other along a random direction."""
    for batch in batches:
        for at in range(0, batch.num_rows, START_BLOCK):
            part = batch.slice(at, START_BLOCK)
            ids, rows = part.column(0).to_numpy(), _rows(part.column(1))
            sims = rows @ rows.T
            np.fill_diagonal(sims, -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(ids, sims, K)], ["a", "b", "sim"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal leading key columns, from sorted rows; a run may cross batches."""
    held, last = [], None
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if b > a:
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node meet: pairs that are nearer than what one of them keeps as its last."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for run in _runs(batches, 2):
        ids, rows, least = run.column(2).to_numpy(), _rows(run.column(3).combine_chunks()), run.column(4).to_numpy()
        for at in range(0, len(ids), JOIN_BLOCK):
            part = slice(at, at + JOIN_BLOCK)
            sims = rows[part] @ rows[part].T
            sims[sims <= least[part][:, None]] = -np.inf
            np.fill_diagonal(sims, -np.inf)
            out.append(_best(ids[part], sims, GIVEN))
            size += len(out[-1][0])
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "sim"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "sim"])


def _keep(edges: DataFrame, most: int) -> DataFrame:
    """The `most` nearest distinct neighbours of each node; `old` tells the edges that were there before."""
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    best = edges.repartition("a").groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def build_graph(nodes: DataFrame, scratch: Scratch, starts: int = 3, dims: int = 64) -> DataFrame:
    """Edges (a, b, sim, old, place) of nodes(id, row, floats): K neighbours each.

    The first come from blocks along `starts` random directions, which a range partitioning sorts; then in every round
    the neighbours of each node, both ways, are compared with each other, so that neighbours of neighbours meet. A node
    with many of them deals them out anew in every round. Rounds go on until few edges change; as a list of neighbours only
    ever gets nearer, that comes to an end.
    """
    draw = np.random.default_rng(17).normal(size=(starts, dims))
    first = None
    for k in range(starts):
        line = F.aggregate(F.zip_with("floats", F.array(*map(F.lit, map(float, draw[k]))), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        some = nodes.withColumn("at", line).repartitionByRange(F.col("at"), F.col("id")).sortWithinPartitions("at", "id").select("id", "row").mapInArrow(_start, "a long, b long, sim float")
        first = some if first is None else first.unionByName(some)
    graph = scratch.save(_keep(first.withColumn("old", F.lit(False)), K), "graph0")
    edges = graph.count()
    for r in count():
        ways = graph.select(F.col("a").alias("to"), F.col("b").alias("id")).union(graph.select(F.col("b").alias("to"), F.col("a").alias("id"))).distinct()
        parts = ways.groupBy("to").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))  # a node that many have as neighbour is dealt out
        last = graph.groupBy("a").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select(F.col("a").alias("id"), F.when(F.col("n") < K, F.lit(-2.0)).otherwise(F.col("least")).cast("float").alias("least"))
        mix = F.xxhash64("id", F.lit(r))
        calls = ways.join(parts, "to").select("to", F.pmod(mix, "parts").cast("int").alias("part"), "id")
        calls = calls.join(nodes.select("id", "row").join(last, "id"), "id").select("to", "part", "id", "row", "least")
        met = calls.repartition("to", "part").sortWithinPartitions("to", "part", mix).mapInArrow(_introduce, "a long, b long, sim float")
        both = graph.select("a", "b", "sim", F.lit(True).alias("old")).unionByName(met.withColumn("old", F.lit(False)))
        graph = scratch.save(_keep(both, K), f"graph{r + 1}")
        scratch.drop(f"graph{r}")
        if graph.where(~F.col("old")).count() <= STILL * edges:
            return graph


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a node, their rows and their lengths, as three byte strings."""
    for batch in batches:
        ids, rows, sizes = (batch.column(i).to_pylist() for i in (1, 2, 3))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([np.asarray(x, np.int64).tobytes() for x in ids], pa.binary()), pa.array([b"".join(x) for x in rows], pa.binary()), pa.array([np.asarray(x).tobytes() for x in sizes], pa.binary())],
            ["a", "ids", "rows", "sizes"],
        )


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of a node that are nearer to a query at it than the last of the query's pool."""
    for batch in batches:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for ids, rows, sizes, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            rows = np.frombuffer(rows.as_buffer(), np.float16).reshape(len(ids), -1).astype(np.float32)
            q, least = (np.asarray(asked.values.field(i)) for i in (0, 2))
            sims = (_rows(asked.values.field(1)) @ rows.T) * np.frombuffer(sizes.as_buffer(), np.float64)
            i, j = np.nonzero(sims > least[:, None])
            found.append((q[i], ids[j], sims[i, j]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "id", "sim"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [float(np.dot(np.asarray(x.values, np.float64), np.asarray(y.values, np.float64))) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64())], ["q", "id", "score"])


def around_name(scratch: Scratch) -> str:
    return "around_" + scratch.root.rpartition("-")[2]


def _adjacency(graph: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, ids, rows, sizes): neighbours both ways with their rows and lengths, up to about 64 in a row of the table, bucketed by node, so
    that no hop has to move it."""
    spark = graph.sparkSession
    ways = scratch.save(graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    parts = ways.groupBy("a").agg(F.ceil(F.count("*") / 64).cast("int").alias("parts"))
    ways = ways.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b").join(nodes.select(F.col("id").alias("b"), "row", "length"), "b")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = ways.repartition(n, "a").groupBy("a", "part").agg(F.collect_list(F.struct("b", "row", "length")).alias("all")).select("a", "all.b", "all.row", "all.length")
    table = lists.mapInArrow(_lay_out, "a long, ids binary, rows binary, sizes binary").repartition(n, "a").sortWithinPartitions("a")
    table.write.bucketBy(n, "a").sortBy("a").option("path", f"{scratch.root}/around").saveAsTable(around_name(scratch))
    return spark.table(around_name(scratch))


def _enter(longest: list[tuple[int, bytes, float]]):
    """Compares queries with a few given nodes: the best of them for each query."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.array([i for i, _, _ in longest], np.int64), np.array([x for _, _, x in longest])
        rows = _rows(pa.array([bytes(x) for _, x, _ in longest], pa.binary()))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sims = (_rows(part.column(1)) @ rows.T) * sizes
                top = np.argsort(-sims, axis=1, kind="stable")[:, :ENTRIES]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel())], ["q", "id", "sim"])

    return compare


def _walk(asked: DataFrame, nodes: DataFrame, around: DataFrame, scratch: Scratch, width: int, reach: int, ef: int) -> DataFrame:
    """Greedy search: the `ef` best nodes (q, id, sim, seen, place) of every query of asked(q, query)."""
    # its own node comes before anything else of a query
    own = asked.select("q", F.col("q").alias("id"), F.lit(2.0).alias("sim"))
    entries = [(r["id"], r["row"], r["length"]) for r in nodes.orderBy(F.desc("log_length"), "id").limit(LONGEST).select("id", "row", "length").collect()]
    if entries:
        own = own.unionByName(asked.mapInArrow(_enter(entries), "q long, id long, sim double").where("q <> id"))
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    pool = scratch.save(own.withColumn("seen", F.lit(False)).withColumn("place", F.row_number().over(order)), "pool0")
    deals = max(16, -(-asked.count() // ASKED))
    for h in count():
        open_ = pool.where(~F.col("seen") & (F.col("place") <= reach)).select("q").distinct()
        if open_.isEmpty():
            break
        least = pool.groupBy("q").agg(F.min("sim").alias("least"), F.count("*").alias("n")).select("q", F.when(F.col("n") < ef, F.lit(-2.0)).otherwise(F.col("least")).alias("least"))
        pool = pool.withColumn("turn", F.row_number().over(Window.partitionBy("q", "seen").orderBy("place")))
        turn = pool.where(~F.col("seen") & (F.col("turn") <= width)).join(open_, "q").join(asked, "q").join(least, "q").select(F.col("id").alias("a"), "q", "query", "least")
        # many queries at one node are dealt out, so that no row of a hop grows with the number of queries
        turn = turn.repartition("a").groupBy("a", F.pmod("q", F.lit(deals)).alias("deal")).agg(F.collect_list(F.struct("q", "query", "least")).alias("asked"))
        fresh = around.join(turn.hint("shuffle_hash"), "a").select("ids", "rows", "sizes", "asked").mapInArrow(_look, "q long, id long, sim double").withColumn("seen", F.lit(False))
        done = pool.select("q", "id", "sim", (F.col("seen") | (F.col("turn") <= width)).alias("seen"))
        both = done.unionByName(fresh).repartition("q").groupBy("q", "id").agg(F.max("sim").alias("sim"), F.max("seen").alias("seen"))
        pool = scratch.save(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ef), f"pool{h + 1}")
        scratch.drop(f"pool{h}")
    return pool


def nearest(vectors: DataFrame, is_query, top: int = 20, width: int = 80, reach: int = 160, ef: int = 480) -> DataFrame:
    """The `top` nearest other rows of every query row, by inner product of the original vectors in double precision.

    Vectors that are null, empty, all zero, or hold null or non-finite components, and rows with a null vec_id, take no
    part, nor do vectors of another length than most. Equal vectors are one node of the graph; afterwards a node stands
    for its rows with the smallest vec_ids, as many as a result can need. Rows repeating vec_id and vector count once.
    Ties go to the smaller vec_id; with fewer candidates than `top`, all are found; an empty table gives no rows.
    Every row is indexed. The graph joins near directions, in half precision; lengths are kept apart from them, in double
    precision, so a very long vector takes nothing from the others. A query starts at its own node and at the best of the
    LONGEST vectors, and keeps the `ef` best nodes met, by inner product. In each hop it looks at the neighbours, both ways, of
    its `width` best nodes not yet looked at; it goes on until it has looked at all its `reach` best ones, however large
    the table is. Exact scores come last.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    base = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("v"))
    good = base.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = good.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1)
    dims = (sizes.first() or [1])[0]
    good = good.where(F.size("v") == dims).withColumn("kind", F.xxhash64("v"))
    order = Window.partitionBy("kind").orderBy("vec_id")
    rows = good.select("vec_id", "kind").distinct()
    members = scratch.save(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1).select("kind", "vec_id"), "members")
    kinds = scratch.save(good.groupBy("kind").agg(F.first("v").alias("v")), "kinds")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).values).reshape(batch.num_rows, -1) if batch.num_rows else np.ones((0, dims))
            most = np.abs(v).max(1, initial=0)
            v = v / most[:, None]  # squares neither overflow nor vanish
            size = np.sqrt((v * v).sum(1))
            v = v / size[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary()), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())), pa.array(np.log(most) + np.log(size))], ["id", "row", "floats", "log_length"])

    nodes = scratch.save(kinds.mapInArrow(split, "id long, row binary, floats array<float>, log_length double"), "nodes")
    longest = nodes.agg(F.max("log_length")).first()[0] or 0.0
    nodes = nodes.withColumn("length", F.exp(F.col("log_length") - longest))
    graph = build_graph(nodes, scratch, dims=dims)
    queries = scratch.save(good.where(is_query).select("vec_id", "kind").distinct(), "queries")
    asked = queries.select(F.col("kind").alias("q")).distinct()
    asked = scratch.save(asked.join(nodes.select(F.col("id").alias("q"), F.col("row").alias("query")), "q"), "asked")
    try:
        pool = _walk(asked, nodes, _adjacency(graph, nodes, scratch), scratch, width, reach, ef)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {around_name(scratch)}")
    best = pool.where(F.col("place") <= 4 * top)  # half precision may have changed their order
    exact = best.select("q", "id").join(kinds.select(F.col("kind").alias("id"), F.col("v").alias("x")), "id").join(kinds.select(F.col("kind").alias("q"), F.col("v").alias("y")), "q")
    exact = exact.select("q", "id", "y", "x").mapInArrow(_exact, "q long, id long, score double")
    # no query needs more than top + 1 rows of its kind's results, its own row among them
    found = exact.join(members.withColumnRenamed("kind", "id"), "id").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= top + 1)
    pairs = queries.select(F.col("vec_id").alias("query_id"), F.col("kind").alias("q")).join(found.select("q", "vec_id", "score"), "q").where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
