"""Near-duplicate documents by min-max hashing, banding, exact checks and connected components.

Each permutation gives two signature values, the minimum and the maximum of the permuted shingle hashes (Ji et al., 2013),
so 64 permutations give 128 values: 32 bands of 4, each of four different permutations. A pair at the threshold shares
no band with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced, typed

WORDS, PERCENT, PERMUTATIONS, ROWS = 5, 75, 64, 4
#: A pair is only dropped unchecked if fewer than this share of its 128 values agree; at the threshold that is 6.5 standard
#: deviations off (4.6, or 2 pairs of a million, if the two values of every permutation always went together).
LEAST_AGREEMENT = 0.5
_DRAW = np.random.default_rng(11)
_ODD = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _DRAW.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; hashes of words are kept up to a bound."""

    def __init__(self, words: int = WORDS, cache: int = 300_000):
        self.words, self.cache, self.known = words, cache, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.cache:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : len(h) - k + 1 + i] * _PLACE[i]
        return np.unique(_mix(total))


def kind_of(shingles: np.ndarray) -> bytes:
    """A 128-bit name of the whole set: documents with equal sets are of one kind. Two of 1e11 sets share a name with probability 1e-17."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, cut to 32 bits; the maxima are turned by 16 places, so that the values
    j, j + 32, j + 64 and j + 96 of a band j come from four permutations."""
    lo, hi = np.full(PERMUTATIONS, np.iinfo(np.uint64).max), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        moved = _ODD[:, None] * shingles[None, at : at + 2048] + _ADD[:, None]
        lo, hi = np.minimum(lo, moved.min(1)), np.maximum(hi, moved.max(1))
    return (_mix(np.concatenate([lo, np.roll(hi, PERMUTATIONS // 4) ^ np.uint64(1)])) >> np.uint64(32)).astype("<u4")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in sliced(batches):
        n, kinds, sign = [], [], []
        for text in batch.column(1):
            s = shingle(text.as_py())
            n.append(len(s))
            kinds.append(kind_of(s) if len(s) else None)
            sign.append(signature(s).astype("<u2").tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(kinds, pa.binary()), pa.array(sign, pa.binary())], ["doc_id", "n_shingles", "kind", "sign"])


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def band_keys(sign: np.ndarray) -> np.ndarray:
    """The keys of each signature's bands; the last six bits are the band's number."""
    parts = sign.astype(np.uint64).reshape(len(sign), ROWS, -1)
    number = np.arange(parts.shape[2], dtype=np.uint64)
    key = np.broadcast_to(number, (len(sign), parts.shape[2]))
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i, :] + np.uint64(1))
    return (key << np.uint64(6) | number).view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band key, node, doc_id, n)."""
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_signs(batch.column(3)))
            each = [pa.array(np.repeat(batch.column(i).to_numpy(), keys.shape[1])) for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *each], ["band", "node", "doc_id", "n"])


_PAIR = ("a", "b", "a_doc", "b_doc")
_PAIR_SCHEMA = ", ".join(f"{c} long" for c in _PAIR)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            batch = batch.filter(pa.array((_signs(batch.column(4)) == _signs(batch.column(5))).mean(1) >= LEAST_AGREEMENT))
        yield pa.RecordBatch.from_arrays(batch.columns[:4], _PAIR)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (node, kind, text) whose text is of that kind."""
    shingle = Shingler()
    for batch in sliced(batches):
        found = [(node, s.tobytes()) for node, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if len(s := shingle(text)) and kind_of(s) == kind]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["node", "shingles"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs are merged
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= PERCENT * (len(x) + len(y) - n)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets reach the similarity."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            keep[i] = _similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], _PAIR)


class _Part:
    """One part of a bucket: its members' columns."""

    def __init__(self, members: pa.StructArray):
        self.node, self.doc, self.comp, self.roams = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "doc_id", "comp", "roams"))
        self.sign = _signs(members.field("sign"))
        self.sets = [np.frombuffer(x, np.uint64) for x in members.field("shingles").to_pylist() if x is not None]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a straggler of one part of a bucket and a member of another part (or the same) that are of different components.

    Rows are (band, i, j, members of part i, members of part j or null where i = j). A pair is looked at in the first
    band it shares only, and two stragglers from the side of the lower part only. With shingle sets in the members, pairs
    are confirmed here, and those that links found here already connect are skipped; without, pairs whose signatures
    agree enough are returned.
    """
    for batch in batches:
        band, i_part, j_part = (batch.column(k).to_numpy() for k in range(3))
        found: list[tuple[int, int, int, int]] = []
        for row in range(batch.num_rows):
            left = _Part(batch.column(3)[row].values)
            right = _Part(batch.column(4)[row].values) if i_part[row] != j_part[row] else left
            at, root = int(band[row]) & 63, {c: c for c in {*left.comp.tolist(), *right.comp.tolist()}}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for i in np.flatnonzero(left.roams):
                other = right.comp != left.comp[i]
                if i_part[row] > j_part[row]:
                    other &= ~right.roams
                elif right is left:
                    other[:i] &= ~right.roams[:i]
                other = np.flatnonzero(other)
                if not len(other):
                    continue
                same = right.sign[other] == left.sign[i]
                shared = same.reshape(len(other), ROWS, -1).all(1).argmax(1)
                for j in other[(shared == at) & (same.mean(1) >= LEAST_AGREEMENT)]:
                    if not left.sets:
                        found.append((left.node[i], right.node[j], left.doc[i], right.doc[j]))
                    elif (x := find(int(left.comp[i]))) != (y := find(int(right.comp[j]))) and _similar(left.sets[i], right.sets[j]):
                        root[x] = y
                        found.append((left.node[i], right.node[j], left.doc[i], right.doc[j]))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], _PAIR)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b), the root being the smallest node: alternating large-star and
    small-star steps (Kiveris et al., 2014)."""
    step, last = 0, None
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step += 1
        edges = scratch.save(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


#: Members of a bucket up to which signatures alone are compared in it; beyond, shingle sets travel too, in parts of so many members.
SMALL, PART = 64, 512
#: Bytes of shingle sets that a part holds, but for a single longer one.
PART_BYTES = 4 << 20


def _filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    sign = nodes.select(F.col("node").alias("b"), F.col("sign").alias("sb"))
    other = nodes.select(F.col("node").alias("a"), F.col("sign").alias("sa"))
    return pairs.join(sign, "b").join(other, "a").select(*_PAIR, "sa", "sb").mapInArrow(_agree, _PAIR_SCHEMA)


def _sets_of(wanted: DataFrame, base: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the text of one document of each."""
    asked = nodes.select("node", "kind", "doc_id").join(wanted.distinct(), "node")
    rows = base.join(asked, "doc_id").groupBy("doc_id", "node", F.xxhash64("text").alias("h"), F.crc32(F.encode("text", "UTF-8")).alias("c")).agg(F.first("kind").alias("kind"), F.first("text").alias("text"))
    return rows.select("node", "kind", "text").mapInArrow(_sets, "node long, shingles binary")


def _confirmed(pairs: DataFrame, base: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b), smallest doc_ids, of the pairs whose full sets reach the similarity."""
    sets = scratch.save(_sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), base, nodes), f"{name}-sets")
    links = scratch.save(
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .select(*_PAIR, "sa", "sb").mapInArrow(_confirm, _PAIR_SCHEMA).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")), name)
    scratch.drop(f"{name}-sets")
    return links


def _parts(members: DataFrame) -> DataFrame:
    """Members (band, blocks, part, node, ...) as rows (band, i, j, members of part i, those of part j): every part of a
    bucket that holds a straggler meets every part of it, by a join on (band, part); the parts hold bounded numbers."""
    packed = members.groupBy("band", "part", "blocks").agg(F.collect_list(F.struct("node", "doc_id", "comp", "roams", "sign", "shingles")).alias("members"), F.bool_or("roams").alias("roams"))
    calls = packed.where("roams").select("band", F.col("part").alias("i"), "members", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    own = calls.where("i = j").select("band", "i", "j", "members", F.lit(None).cast(packed.schema["members"].dataType).alias("others"))
    rest = packed.where("blocks > 1").select("band", F.col("part").alias("j"), F.col("members").alias("others"))
    return own.unionByName(calls.where("i <> j").join(rest, ["band", "j"]).select("band", "i", "j", "members", "others"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: the size of its shingle set, the component it belongs to and whether it is the one kept.

    A component's id is its smallest doc_id. Documents without words or with null text have no shingles and are linked
    with nothing; one with fewer than 5 words has its whole sequence as one shingle; rows that repeat a doc_id belong to
    one component; a row with a null doc_id is linked with nothing, has a null component and is kept; an empty table
    gives no rows.

    Documents with equal sets are one node, called by its smallest doc_id in the graph of links. In every bucket of equal
    band keys, members are first compared with the bucket's first member alone, that of the smallest doc_id, as an
    original comes before its copies. Where a bucket then still holds several components, the members outside its first
    member's component (stragglers) are compared with the bucket's other members, part by part: members are dealt to
    parts of bounded size, and a part that holds stragglers meets every other part of its bucket once, so no task holds a
    whole bucket and no pairs are written out.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    base = typed(docs, doc_id="long", text="string")
    signed = scratch.save(base.mapInArrow(_sign, "doc_id long, n_shingles long, kind binary, sign binary"), "signed")
    full = signed.where("doc_id is not null and kind is not null")
    kinds = full.groupBy("kind").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"))
    nodes = scratch.save(kinds.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", "doc_id", "n", "sign").mapInArrow(_bands, "band long, node long, doc_id long, n long")
    shared = banded.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min(F.struct("doc_id", "node", "n")).alias("rep")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / PART), F.ceil(8 * F.col("total") / PART_BYTES)).cast("int")
    buckets = scratch.save(banded.join(shared, "band").select("band", "node", "doc_id", "n", "size", blocks.alias("blocks"), F.col("rep.node").alias("rep"), F.col("rep.doc_id").alias("rep_doc"), F.col("rep.n").alias("rep_n")), "buckets")

    star = buckets.where(f"node <> rep and 100 * least(n, rep_n) >= {PERCENT} * greatest(n, rep_n)").select(F.col("rep").alias("a"), F.col("node").alias("b"), F.col("rep_doc").alias("a_doc"), F.col("doc_id").alias("b_doc")).distinct()
    near = scratch.save(_filtered(star, nodes), "near")
    comps = components(_confirmed(near, base, nodes, scratch, "links"), scratch, "star")
    scratch.drop("near", "links")

    tagged = buckets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")
    mixed = tagged.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("comp", F.when(F.col("node") == F.col("rep"), 0).otherwise(1)).alias("first_comp")).where("lo <> hi").select("band", "first_comp")
    mixed = tagged.join(mixed, "band").select("band", "node", "doc_id", "comp", "size", (F.col("comp") != F.col("first_comp")).alias("roams"), F.when(F.col("size") <= SMALL, 1).otherwise(F.col("blocks")).alias("blocks"))
    mixed = scratch.save(mixed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "mixed")
    signs = nodes.select("node", "sign")
    small = mixed.where(f"size <= {SMALL}").join(signs, "node").withColumn("shingles", F.lit(None).cast("binary"))
    maybe = scratch.save(_parts(small).mapInArrow(_meet, _PAIR_SCHEMA).distinct(), "maybe")
    few = _confirmed(maybe, base, nodes, scratch, "few")
    large = mixed.where(f"size > {SMALL}")
    sets = scratch.save(_sets_of(large.select("node"), base, nodes).join(signs, "node"), "large-sets")
    met = scratch.save(_parts(large.join(sets, "node")), "parts")
    many = scratch.save(met.repartition("band", "i", "j").mapInArrow(_meet, _PAIR_SCHEMA).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct(), "many")
    repeated = full.groupBy("doc_id").agg(F.min("kind").alias("k"), F.max("kind").alias("z")).where("k <> z").select("doc_id")
    repeated = full.join(repeated, "doc_id").select(F.col("doc_id").alias("b"), "kind").join(nodes.select("kind", F.col("doc_id").alias("a")), "kind").select("a", "b")
    edges = comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(few).union(many).union(repeated)
    roots = components(edges, scratch, "all")

    named = nodes.select("kind", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("kind", F.coalesce("root", "doc_id").alias("root"))
    out = signed.select("doc_id", "n_shingles", "kind").join(named, "kind", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return scratch.only(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns; of rows that repeat a doc_id, all of a kept one."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_doc_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_doc_id"], "left_anti")
