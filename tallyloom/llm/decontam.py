"""Benchmark decontamination with an FM-index per shard of the training text.

The symbols of an index are words. A shard's text is indexed only where a test phrase can lie: runs of words of the
tests at least as long as the shortest phrase (any other word, or a shorter run, ends every phrase, so this loses
nothing). Phrases are found by backward search with ranks from a wavelet matrix and located by sampled suffix positions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sliced, typed

WINDOW = 10
#: Bytes of test text that one pass over the documents searches for; a larger benchmark takes more passes.
BLOCK_BYTES = 16 << 20
#: Words of training text that one index holds at most, but for a single longer document.
SHARD_WORDS = 4_000_000
#: Bytes of documents whose texts a task holds as Python strings at a time; every slice is a shard, or some.
SLICE = 8 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(c if chr(c).isascii() and (chr(c).isdigit() or chr(c).islower()) or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WaveletMatrix:
    """rank(c, i): how often symbol c stands before place i."""

    def __init__(self, text: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = (text >> level & 1).astype(bool)
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, len(text) - int(ones[-1])))
            text = np.concatenate([text[~bit], text[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for level, ones, zeros in self.levels:
            one = (c >> level & 1).astype(bool)
            i = np.where(one, zeros + ones[i], i - ones[i])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return i - start


class FMIndex:
    """Of a text of positive symbols in runs that each end with a 0. Suffix places are kept for every `step`-th symbol of a run."""

    def __init__(self, text: np.ndarray, symbols: int, step: int = 8):
        n = len(text)
        gap = text == 0
        ends = np.flatnonzero(gap)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))  # each end differs, so sorting stops within a run
        width = 1
        while True:
            after = np.full(n, -1, np.int64)
            after[: max(0, n - width)] = rank[width:]
            key = rank * (n + symbols + 1) + after + 1
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
            rank, width = new, width * 2
            if rank[order[-1]] == n - 1:
                break
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        bwt = text[order - 1]
        self.bwt, self.matrix = bwt, WaveletMatrix(bwt, max(1, int(symbols - 1).bit_length()))
        heads = np.concatenate([[0], ends[:-1] + 1])
        place = np.arange(n) - np.repeat(heads, np.diff(np.concatenate([heads, [n]])))
        kept = (place % step == 0)[order]
        self.mark = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.places = kept, order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with each phrase (phrases of one length, one a row): from, and up to."""
        last = phrases[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, j]
            lo, hi = self.first[c] + self.matrix.rank(c, lo), self.first[c] + self.matrix.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the suffixes in these rows: steps back until a row whose place was kept."""
        out, live, row, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            there = self.kept[row]
            out[live[there]] = self.places[self.mark[row[there]]] + steps
            live, row = live[~there], row[~there]
            c = self.bwt[row]
            row, steps = self.first[c] + self.matrix.rank(c, row), steps + 1
        return out


class Phrases:
    """Windows of the test items as symbol rows by length; which items each distinct window belongs to."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.vocab: dict[bytes, int] = {}
        by: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1)) if ids else ():
                by.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.groups = []
        for size in sorted({len(k) for k in by}):
            keys = [k for k in by if len(k) == size]
            self.groups.append((size, np.asarray(keys, np.int64), [np.asarray(sorted(by[k]), np.int64) for k in keys]))
        self.shortest = min((size for size, _, _ in self.groups), default=0)


def hits_of(symbols: np.ndarray, heads: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Of documents laid end to end (symbols, 0 for other words; heads: where each begins): the words hit, and items by document."""
    n = len(symbols)
    hit, items = np.zeros(n, bool), {}
    if not phrases.groups or not n:
        return hit, items
    owner = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [n]])))
    known = symbols > 0
    starts = known.copy()
    starts[1:] &= ~known[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(starts)
    run = np.cumsum(starts) - 1
    length = np.bincount(run[known], minlength=len(begin)) if len(begin) else np.zeros(0, int)
    keep = length >= phrases.shortest
    begin, length = begin[keep], length[keep]
    if not len(begin):
        return hit, items
    # the runs in a row, a 0 after each
    base = np.concatenate([[0], np.cumsum(length + 1)])
    origin = np.repeat(begin - base[:-1], length + 1) + np.arange(base[-1])
    text = symbols[np.minimum(origin, n - 1)]
    text[base[1:] - 1] = 0
    index = FMIndex(text, len(phrases.vocab) + 1)
    mark = np.zeros(n + 1, np.int32)
    for size, rows, owners in phrases.groups:
        lo, hi = index.search(rows)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        count = (hi - lo)[found]
        which = np.repeat(found, count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = origin[index.locate(lo[which] + inside)]
        np.add.at(mark, place, 1)
        np.add.at(mark, place + size, -1)
        pairs = np.unique(np.stack([owner[place], which]), axis=1)
        for doc, w in pairs.T.tolist():
            items.setdefault(doc, set()).update(owners[w].tolist())
    return np.cumsum(mark[:-1]) > 0, items


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Merged spans of hit words, in code points: from the first hit word of a stretch to the end of its last."""
    data = text.encode()
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    where = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[where[a][0]]), "end": int(chars[where[b][1]])} for a, b in zip(begins, ends, strict=True)]


def _scan(texts: list[str | None], phrases: Phrases) -> Iterator[tuple[list[int], int, list[np.ndarray], dict[int, set[int]]]]:
    """The documents in shards of at most SHARD_WORDS words: counts, first document, hit words of each, items by document."""
    held: list[np.ndarray] = []
    first = total = 0

    def flush():
        sizes = [len(x) for x in held]
        heads = np.cumsum([0, *sizes[:-1]])
        hit, items = hits_of(np.concatenate(held), heads, phrases)
        return sizes, first, [hit[h : h + s] for h, s in zip(heads, sizes, strict=True)], items

    for text in texts:
        words = words_of(text)
        held.append(np.fromiter(map(phrases.vocab.get, words, repeat(0)), np.int64, len(words)))
        total += len(words)
        if total >= SHARD_WORDS:
            yield flush()
            first, total, held = first + len(held), 0, []
    if held:
        yield flush()


def blocks(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about BLOCK_BYTES the test items make, dealt by a hash of the text, and the blocks, each fetched when it is asked for."""
    items = typed(benchmark, item_id="long", text="string").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    return n, ([tuple(r) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()] for k in range(n))


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, those inside any occurrence of a test window, the items, and the merged spans to remove.

    Null and empty texts have no words and no hits; items with null id or text, or without words, match nothing; an item
    shorter than the window is one window; repeated rows are judged alike; empty tables give no rows, or no hits.
    """
    n, parts = blocks(benchmark)
    docs = typed(docs, doc_id="long", text="string")
    if n == 1:
        return docs.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(next(parts)), window), SCHEMA)
    scratch = Scratch(docs.sparkSession, "decontam")
    rows = scratch.save(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.join(_over_blocks(rows, parts, window, scratch), "row", "left").select("doc_id", "text", "places", "items").mapInArrow(_merge, SCHEMA)


def _over_blocks(rows: DataFrame, parts: Iterator[list[tuple[int, str]]], window: int, scratch: Scratch) -> DataFrame:
    """(row, places, items) of rows(doc_id, text, row): the words hit and the items, over all blocks."""
    all_found = None
    for k, part in enumerate(parts):
        items = rows.sparkSession.sparkContext.broadcast(part)
        found = scratch.save(rows.mapInArrow(_places(items, window), "row long, places array<long>, items array<long>"), f"block{k}")
        items.unpersist()
        all_found = found if all_found is None else all_found.unionByName(found)
    return all_found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _row(doc: int | None, text: str | None, size: int, hit: np.ndarray, items: set[int] | list[int]) -> dict:
    names = ",".join(sorted(map(str, items)))
    n = int(hit.sum())
    return {"doc_id": doc, "n_words": size, "n_hit": n, "n_items": len(items), "items_sha256": hashlib.sha256(names.encode()).hexdigest(), "contaminated": n > 0, "spans": spans_of(text, hit) if n else []}


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _judge(block, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for batch in sliced(batches, SLICE):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for sizes, first, hits, items in _scan(texts, phrases):
                rows = [_row(ids[first + k], texts[first + k], n, hits[k], items.get(k, ())) for k, n in enumerate(sizes)]
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _places(block, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for batch in batches:
            rows = batch.column(2).to_pylist()
            for _, first, hits, items in _scan(batch.column(1).to_pylist(), phrases):
                out = [(rows[first + k], np.flatnonzero(h).tolist(), sorted(items.get(k, ()))) for k, h in enumerate(hits) if k in items]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.list_(pa.int64())) for i in (1, 2))], ["row", "places", "items"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, places, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = len(words_of(text))
            hit = np.zeros(n, bool)
            hit[np.asarray(places or [], int)] = True
            rows.append(_row(doc, text, n, hit, items or ()))
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the spans of decontaminate() cut out of their texts and n_chars set anew; one left without words goes.

    All columns and clean rows stay as they are (null texts too). The benchmark is searched for in blocks, and every
    text is cut once, by the places of all blocks.
    """
    n, parts = blocks(benchmark)
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    if n == 1:
        return docs.mapInArrow(_cut(docs.sparkSession.sparkContext.broadcast(next(parts)), window, at, count), docs.schema)
    scratch = Scratch(docs.sparkSession, "passages")
    rows = scratch.save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = _over_blocks(rows.select(F.lit(None).cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), "row"), parts, window, scratch)
    return rows.join(found, "row", "left").select("doc.*", "places").mapInArrow(_cut_places(at, count), docs.schema)


def _without(text: str, hit: np.ndarray) -> str:
    left, end = [], 0
    for span in spans_of(text, hit):
        left.append(text[end : span["start"]])
        end = span["end"]
    return "".join([*left, text[end:]])


def _cut_places(at: int, count: int | None):
    """Cuts the words at `places`, the last column, out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, keep = list(batch.columns[:-1]), np.ones(batch.num_rows, bool)
            texts, sizes = cols[at].to_pylist(), None if count is None else cols[count].to_pylist()
            for k, places in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if places:
                    hit = np.zeros(len(words_of(texts[k])), bool)
                    hit[places] = True
                    texts[k] = _without(texts[k], hit)
                    keep[k] = bool(words_of(texts[k]))
                    if sizes is not None:
                        sizes[k] = len(texts[k])
            cols[at] = pa.array(texts, cols[at].type)
            if sizes is not None:
                cols[count] = pa.array(sizes, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def _cut(block, window: int, at: int, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(block.value, window)
        for batch in sliced(batches, SLICE):
            texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
            sizes = None if count is None else batch.column(count).to_pylist()
            for _, first, hits, items in _scan(list(texts), phrases):
                for k in items:
                    text = _without(texts[first + k], hits[k])
                    texts[first + k], keep[first + k] = text, bool(words_of(text))
                    if sizes is not None:
                        sizes[first + k] = len(text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.column(at).type)
            if sizes is not None:
                cols[count] = pa.array(sizes, batch.column(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep))

    return run
