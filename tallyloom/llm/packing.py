"""Packing by power-of-two decomposition: every piece of a document has a binary length, and sequences of equal length
share a bucket, so that no sequence crosses documents and none is padded."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import sliced, typed

#: Distinct units whose ids a task keeps; units beyond it are encoded anew in each block of text, with the same ids.
CACHE = 1_500_000
#: Bytes of text that are encoded at a time, and bytes of a unit up to which its ids are kept.
BLOCK, LONGEST = 1 << 19, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"

# Classes of bytes: small letters, digits, marks that only ever stand in a run of marks, gaps, and all others (0).
_LETTER, _DIGIT, _MARK, _GAP = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
for _of, _bytes in ((_LETTER, b"abcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_MARK, b".,;:!?|%*#&$()\"-"), (_GAP, b" \n")):
    _CLASS[list(_bytes)] = _of
#: Does a unit end between two classes? At every gap, around every digit, and between letters and marks.
_CUT = np.array([(a == _GAP) != (b == _GAP) or 0 < min(a, b) and max(a, b) < _GAP and (a != b or a == _DIGIT) for a in range(5) for b in range(5)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _eights(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number; data has eight bytes more than places."""
    return np.ndarray(len(data) - 8, "<u8", data, strides=(1,))


class WordIds:
    """Ids of whole texts from the tokenizer, each distinct unit of text being encoded once.

    This tokenizer drops white space, never joins across it, and begins anew between ASCII letters, digits and plain
    marks, so the ids of a text are those of its units in a row. Units of up to 7 bytes are told apart by their bytes
    and longer ones by a 64-bit hash, and each of these is compared with the kept bytes, so that no hash decides ids.
    Texts that may hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.keys, self.key_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows = {"ids": np.zeros(1 << 16, np.uint32), "bytes": np.zeros(1 << 16, np.uint8), "start": np.zeros(1 << 14, np.int64), "count": np.zeros(1 << 14, np.int64), "spell": np.zeros(1 << 14, np.int64), "size": np.zeros(1 << 14, np.int64)}
        self.used = dict.fromkeys(self.rows, 0)

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _put(self, name: str, values: np.ndarray) -> int:
        """Appends to a growing row and says where."""
        at, row = self.used[name], self.rows[name]
        if at + len(values) + 8 > len(row):
            row = self.rows[name] = np.concatenate([row, np.zeros(max(len(values) + 8, len(row) // 2), row.dtype)])
        row[at : at + len(values)] = values
        self.used[name] = at + len(values)
        return at

    def _add(self, units: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Encodes units and returns their places. plain: whether a unit is all letters, one digit, or all marks."""
        words = [u.decode() for u in units]
        for i in np.flatnonzero(~plain).tolist():
            # letters of any script, if they stay letters in the tokenizer's normal form
            plain[i] = unicodedata.normalize("NFC", words[i]).lower().isalpha()
        counts, ids = np.zeros(len(units), np.int64), np.zeros(0, np.uint32)
        together = np.flatnonzero(plain)
        if len(together):
            (one,) = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in together])], add_special_tokens=False)
            ids = np.asarray(one.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(together):
                counts[together] = np.diff(cuts, prepend=0)
            else:
                together, ids = together[:0], ids[:0]
        alone = np.setdiff1d(np.arange(len(units)), together, assume_unique=True)
        some = [self.direct(words[i]) for i in alone.tolist()]
        counts[alone] = [len(x) for x in some]
        order = np.concatenate([together, alone])
        start = np.empty(len(units), np.int64)
        start[order] = self._put("ids", np.concatenate([ids, *some])) + np.cumsum(counts[order]) - counts[order]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        spell = self._put("bytes", np.frombuffer(b"".join(units), np.uint8)) + np.cumsum(sizes) - sizes
        for name, values in (("start", start), ("count", counts), ("spell", spell), ("size", sizes)):
            at = self._put(name, values)
        return np.arange(at, at + len(units))

    def _keys(self, eights: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = eights[begin] & _MASK[np.minimum(size, 8)]
        keys = first | (size.astype(np.uint64) << np.uint64(56))
        live = np.flatnonzero(size > 7)
        h, k = _mix(first[live] + size[live].astype(np.uint64)), 8
        while len(live):
            keys[live] = h | np.uint64(1 << 63)
            more = size[live] > k
            live, h = live[more], h[more]
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + (eights[begin[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
            k += 8
        return keys

    def _unlike(self, eights: np.ndarray, begin: np.ndarray, size: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Units longer than 7 bytes whose bytes are not those kept at their place."""
        kept = _eights(self.rows["bytes"].data)
        live = np.flatnonzero(size > 7)
        bad = [live[self.rows["size"][where[live]] != size[live]]]
        live, k = live[self.rows["size"][where[live]] == size[live]], 0
        spell = self.rows["spell"]
        while len(live):
            same = ((eights[begin[live] + k] ^ kept[spell[where[live]] + k]) & _MASK[np.minimum(size[live] - k, 8)]) == 0
            bad.append(live[~same])
            k += 8
            live = live[same & (size[live] > k)]
        return np.concatenate(bad)

    def block(self, texts: list[str]) -> list[np.ndarray]:
        plain = [b"" if "<|" in t else t.encode() for t in texts]
        data = b"\n".join(plain).lower()
        heads = np.cumsum([0, *(len(x) + 1 for x in plain)])
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        starts = np.concatenate([[0], np.flatnonzero(_CUT[kind[:-1] * 5 + kind[1:]]) + 1]) if data else np.zeros(0, np.int64)
        ends = np.concatenate([starts[1:], [len(data)]])
        word = kind[starts] != _GAP
        begin, size = starts[word], (ends - starts)[word]
        if len(begin):
            kept = dict(self.used)
            eights = _eights(data + bytes(8))
            own = size > LONGEST
            keys = self._keys(eights, begin, np.where(own, 0, size))
            keys[own] = (np.uint64(1) << np.uint64(62)) + begin[own].astype(np.uint64)  # such a unit stands for itself
            codes, kinds = pd.factorize(keys)
            first = np.empty(len(kinds), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
            known = self.keys[at] == kinds if len(self.keys) else np.zeros(len(kinds), bool)
            places = np.full(len(kinds), -1, np.int64)
            places[known] = self.key_at[at[known]]
            new = np.flatnonzero(~known)
            odd = np.concatenate([[0], np.cumsum(kind == 0)])

            def add(which: np.ndarray) -> np.ndarray:
                a, z = begin[which], (begin + size)[which]
                return self._add([data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], odd[a] == odd[z])

            places[new] = add(first[new])
            where = places[codes]
            bad = self._unlike(eights, begin, np.where(own, 0, size), where)
            where[bad] = add(bad)
            sizes, from_ = self.rows["count"][where], self.rows["start"][where]
            until = np.cumsum(sizes)
            ids = self.rows["ids"][np.repeat(from_ - until + sizes, sizes) + np.arange(until[-1])]
            cuts = np.concatenate([[0], until])[np.searchsorted(begin, heads)]
            if kept["start"] + len(new) > CACHE or own.any() or len(bad):
                self.used = kept
            else:
                keys, key_at = np.concatenate([self.keys, kinds[new]]), np.concatenate([self.key_at, places[new]])
                order = np.argsort(keys, kind="stable")
                self.keys, self.key_at = keys[order], key_at[order]
        else:
            ids, cuts = np.zeros(0, np.uint32), np.zeros(len(heads), np.int64)
        return [self.direct(t) if "<|" in t else ids[cuts[i] : cuts[i + 1]] for i, t in enumerate(texts)]

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= BLOCK:
                yield from self.block(held)
                held, size = [], 0
        if held:
            yield from self.block(held)


def pieces(n: int, most: int) -> list[int]:
    """Lengths, longest first: as many of `most` as fit, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, most: int = 4096, end: int = 2) -> DataFrame:
    """Cuts every document's ids, with `end` after them, into pieces of binary length up to `most` (a power of two).

    Each piece is one sequence, at offset 0, in the bucket log2(length): nothing is padded and nothing crosses
    documents. Null or empty text is the end id alone; repeated rows are packed once each; a null doc_id stays null; an
    empty table gives no rows. No shuffle: ids come from the input partition and the place in it.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, sequence = WordIds(tokenizer), np.asarray([end], np.uint32), TaskContext.get().partitionId() << 40
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                data, at = np.concatenate([ids, last]).astype("<u4").tobytes(), 0
                n = len(data) // 4
                for length in pieces(n, most):
                    out.append((doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n, sequence, 0, length.bit_length() - 1))
                    at, sequence = at + length, sequence + 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return typed(docs, doc_id="long", text="string").mapInArrow(cut, SCHEMA)
