"""Alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token that overlaps it; following two
pointers at once, over and over, leads each token to the last one of its group, and tokens with the same end are a group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokencount import encoder

#: Bytes of texts whose links share one packed row, and of those that are encoded together, but for a single longer text.
CHUNK_BYTES, CODE_BYTES = 2 << 20, 128 << 10
#: Ids that are written at once.
_SLICE = 1 << 17
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
#: What follows an id: another of its side, the other side's, or the next group. Every id is written once with each.
_MARKS, _IDS = ",|;", 1 << 16
_WRITTEN = [f"{i}{m}".encode() for i in range(_IDS) for m in _MARKS]
_SIZES = np.array([len(w) for w in _WRITTEN])
_BEGINS, _DIGITS = np.cumsum(_SIZES) - _SIZES, np.frombuffer(b"".join(_WRITTEN), np.uint8)
del _WRITTEN


class Code:
    """A tokenizer: ids of texts, and the bytes of each id in one long array."""

    def __init__(self, encode: Callable[[list[str]], list], pieces: list[bytes]):
        if len(pieces) > _IDS:
            raise ValueError(f"a vocabulary of {len(pieces)} ids; {_IDS} at most")
        self.encode, self.size = encode, np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        size = self.size[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.bytes[at + np.arange(len(at))]


def byte_code(path: str, pattern: str) -> Code:
    """A byte-level vocabulary: a file of byte-pair ranks, and how its tokenizer splits text. Special tokens inside texts
    are plain text."""
    encode, pieces = encoder(path, pattern)
    return Code(lambda texts: [encode(t) for t in texts], pieces)


def piece_code(path: str) -> Code:
    """A sentencepiece vocabulary with bytes as a last resort."""
    import sentencepiece

    code = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [code.id_to_piece(i) for i in range(code.get_piece_size())]
    pieces = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
    return Code(lambda texts: code.encode(texts, num_threads=1), pieces)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of either side the last A token of its group, by pointer jumping. Both sides cut the same bytes.

    An A token that no overlapping token outruns points to itself; a B token that ends with an A token points to that one.
    """
    begins_a, begins_b = (np.concatenate([[0], e[:-1]]) for e in (ends_a, ends_b))
    farthest_b = np.searchsorted(begins_b, ends_a, "left") - 1
    farthest_a = np.searchsorted(begins_a, ends_b, "left") - 1
    n = len(ends_a)
    to = np.concatenate([np.where(ends_b[farthest_b] > ends_a, n + farthest_b, np.arange(n)), farthest_a])
    while not np.array_equal(on := to[to], to):
        to = on
    return to[:n], to[n:]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of overlapping tokens: every stretch between two neighbouring ends lies in one token of either side."""
    both = np.concatenate([ends_a, ends_b])
    both.sort(kind="stable")  # two sorted runs are merged
    ends = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return np.searchsorted(ends_a, ends, "left"), np.searchsorted(ends_b, ends, "left")


class Aligned:
    """The tokens of several texts, put one after another; texts that cannot be aligned have none."""

    def __init__(self, texts: list[bytes], a: Code, b: Code):
        spoken, self.at = [], []
        for i, raw in enumerate(texts):
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if text:
                spoken.append(text)
                self.at.append(i)
        ids_a = [np.array(x, np.int64) for x in a.encode([f" {t}" for t in spoken])]
        ids_b = [np.array(x, np.int64) for x in b.encode(spoken)]
        good = []
        for k, i in enumerate(self.at):
            want = np.frombuffer(b" " + texts[i], np.uint8)
            good.append(all(code.size[x].sum() == len(want) and (code.size[x] > 0).all() and np.array_equal(code.spell(x), want) for code, x in ((a, ids_a[k]), (b, ids_b[k]))))
        keep = np.flatnonzero(good)
        self.at = [self.at[k] for k in keep]
        ids_a, ids_b = [ids_a[k] for k in keep], [ids_b[k] for k in keep]
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        none = [np.zeros(0, np.int64)]
        self.a, self.b = np.concatenate(ids_a + none), np.concatenate(ids_b + none)
        self.ends_a, self.ends_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """The number of groups of each text, and their hashes. A text's last tokens end together, so no group leaves it.

        All groups are written at once: the ids of a group's A tokens, then of its B tokens, each with the mark after it.
        """
        if not len(self.at):
            return np.zeros(0, np.int64), []
        last_a, last_b = terminals(self.ends_a, self.ends_b)
        heads = np.flatnonzero(last_a == np.arange(len(last_a)))
        upto_a, upto_b = heads + 1, np.searchsorted(last_b, heads, "right")
        marked = np.zeros(len(self.a) + len(self.b), np.int64)
        place_a = np.arange(len(self.a)) + np.repeat(np.append(0, upto_b[:-1]), np.diff(upto_a, prepend=0))
        place_b = np.arange(len(self.b)) + np.repeat(upto_a, np.diff(upto_b, prepend=0))
        marked[place_a], marked[place_b] = self.a * len(_MARKS), self.b * len(_MARKS)
        marked[place_a[upto_a - 1]] += 1
        marked[place_b[upto_b - 1]] += 2
        hashes, k = [], 0
        for to in np.cumsum(self.n_a + self.n_b).tolist():
            text = hashlib.sha256()
            for at in range(k, to, _SLICE):
                some = marked[at : min(at + _SLICE, to)]
                size = _SIZES[some]
                upto = np.cumsum(size)
                written = _DIGITS[np.repeat(_BEGINS[some] - (upto - size), size) + np.arange(upto[-1])]
                text.update(written[: len(written) - (at + _SLICE >= to)])
            hashes.append(text.hexdigest())
            k = to
        return np.diff(np.searchsorted(heads, np.cumsum(self.n_a), "left"), prepend=0), hashes

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """For each link the text's place among those aligned, and the pair of ids as one number."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = links(self.ends_a, self.ends_b)
        return np.searchsorted(np.cumsum(self.n_a), i, "right"), self.a[i] << 32 | self.b[j]


_CHUNK = "docs binary, n_a binary, n_b binary, n_groups binary, n_links binary, nulls binary, hashes array<string>, pairs binary, held binary, distinct binary, pair binary, times binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(ids: list[int | None], texts: list[bytes], a: Code, b: Code) -> pa.RecordBatch:
    """A chunk as one row: its texts' figures, its distinct pairs with the number of texts that hold each, and text by
    text how many pairs it holds, which (by place), and how often each is linked there."""
    n, hashes, owners, linked, first = np.zeros((4, len(texts)), "<i8"), [""] * len(texts), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= CODE_BYTES:
            size += len(texts[last])
            last += 1
        found = Aligned(texts[first:last], a, b)
        at = first + np.asarray(found.at, np.int64)
        n[0, at], n[1, at] = found.n_a, found.n_b
        n[2, at], named = found.groups()
        for i, h in zip(at.tolist(), named, strict=True):
            hashes[i] = h
        owner, pair = found.linked()
        n[3, at] = np.bincount(owner, minlength=len(at))
        owners.append(at[owner])
        linked.append(pair)
        first = last
    pairs, place = np.unique(np.concatenate(linked), return_inverse=True)
    both, times = np.unique(np.concatenate(owners) * max(len(pairs), 1) + place, return_counts=True)
    owner, place = np.divmod(both, max(len(pairs), 1))
    held = np.bincount(place, minlength=len(pairs))
    cells = [np.array([i or 0 for i in ids], "<i8"), *n, np.array([i is None for i in ids], "u1")]
    distinct = np.bincount(owner, minlength=len(texts))
    last = [pairs.astype("<i8"), held.astype("<i8"), distinct.astype("<i4"), place.astype("<i4"), times.astype("<i4")]
    cols = [*(pa.array([c.tobytes()], pa.binary()) for c in cells), pa.array([hashes], pa.list_(pa.string())), *(pa.array([c.tobytes()], pa.binary()) for c in last)]
    return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _CHUNK.split(", ")])


def _chunks(first: str, pattern: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_code(first, pattern), piece_code(second)
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                if texts and size + len(raw) > CHUNK_BYTES:
                    yield _packed(ids, texts, a, b)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield _packed(ids, texts, a, b)

    return run


def _unpack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, held) of rows (chunk, pairs, held)."""
    for batch in batches:
        for chunk, pairs, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, held = np.frombuffer(pairs, "<i8"), np.frombuffer(held, "<i8")
            for at in range(0, len(pairs), 100_000):
                some = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[some]), chunk)), pa.array(pairs[some]), pa.array(held[some])], ["chunk", "pair", "held"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result's rows of packed chunks with `known`: the chunk's pairs with their counts over the corpus."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            get = lambda c, kind="<i8": np.frombuffer(row[c].as_buffer() or b"", kind)  # noqa: E731, B023
            docs, pairs = get("docs"), get("pairs")
            known = row["known"].values
            counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            if known is not None and len(known):
                at = np.searchsorted(pairs, known.field("pair").to_numpy())
                counts[at], best[at] = known.field("n").to_numpy(), known.field("best").to_numpy(zero_copy_only=False)
            place, times, until = get("pair", "<i4"), get("times", "<i4"), np.cumsum(get("distinct", "<i4"))
            n_best, total = (np.diff(np.append(0, np.cumsum(times * x[place]))[until], prepend=0) for x in (best.astype(np.int64), counts))
            cols = [pa.array(docs, mask=get("nulls", "u1").astype(bool)), *(pa.array(get(c)) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(total), row["hashes"].values]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _OUT.split(", ")])


def align(docs: DataFrame, first: str, pattern: str, second: str) -> DataFrame:
    """Per document: its tokens by both tokenizers, its groups, its links, and how common the linked pairs of ids are.

    first: a byte-level vocabulary's ranks (A), with the pattern that splits its text, a space and the text; second: a sentencepiece model (B), which adds
    that space itself. Groups end where tokens of both end. Links are all pairs of tokens that share bytes. A pair of ids
    counts once for each document of the corpus that holds it linked; n_best are the links whose pair is the most
    frequent of its A id, ties included, and count_sum adds up the counts of all links.

    Null or empty texts, and texts that a tokenizer changes (joined tokens differ from space and text), have no tokens:
    zeros, and an empty groups_sha256. Very long texts are encoded whole. Repeated rows count as documents of their own;
    a null doc_id stays null; an empty table gives no rows.

    Documents are packed by chunks of bounded size, and a chunk names each of its pairs once, so a pair that all documents
    hold has one row per chunk, not per document.
    """
    scratch = Scratch(docs.sparkSession, "crossalign")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    chunks = scratch.save(base.mapInArrow(_chunks(first, pattern, second), _CHUNK).select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")
    pairs = chunks.select("chunk", "pairs", "held").mapInArrow(_unpack_pairs, "chunk long, pair long, held long")
    counted = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    counted = scratch.save(counted, "counted")
    most = counted.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("n").alias("most"))
    judged = counted.withColumn("id", F.shiftright("pair", 32)).join(most, "id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = pairs.select("chunk", "pair").join(judged, "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "n", "best")).alias("known"))  # a chunk's pairs are bounded by its bytes
    names = [c.split()[0] for c in _CHUNK.split(", ") if c.split()[0] != "held"]
    out = chunks.join(known, "chunk", "left").select(*names, "known").mapInArrow(_sum_up, _OUT)
    return scratch.only(out)
