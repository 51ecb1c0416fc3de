"""Token counts of sections by offset-mapped attribution: a document is encoded once, as a whole, and its tokens' spans
are joined to the spans of its sections."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import typed

SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, doc_tokens long"


#: A run of white space so long that the tokenizer's pattern, which looks ahead behind such runs, is not tried on it.
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{64,}")
#: Rows that are put out at once.
_ROWS = 200_000


def encoder(ranks: str, pattern: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """The ids of a whole text, of any length, and the bytes of each id.

    The pattern must let no piece run from another character into white space, take a run of white space up to all but
    its last character as one piece, and the whole run where the text ends, as those of the public byte-level
    vocabularies do. So a long run is encoded as one piece by itself, and the text around it as it would be anyway.
    """
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(table.values()) + 1)
    for piece, i in table.items():
        pieces[i] = piece
    code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    whole: list[tiktoken.Encoding] = []

    def encode(text: str) -> np.ndarray:
        found, at = [], 0
        for run in _LONG_SPACE.finditer(text):
            if not whole:
                whole.append(tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={}))
            end = run.end() - (run.end() < len(text))
            found += [code.encode_to_numpy(text[at : run.start()]), whole[0].encode_to_numpy(text[run.start() : end])]
            at = end
        return np.concatenate([*found, code.encode_to_numpy(text[at:])]) if found else code.encode_to_numpy(text)

    return encode, pieces


def attribute(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each section. tokens: their ends, in bytes, one after another; bounds: where each section begins, and the end.

    A token goes to the section that holds most of its bytes, the first of several with as many; empty sections get none.
    """
    begins = np.concatenate([[0], tokens[:-1]]) if len(tokens) else tokens
    first = np.searchsorted(bounds, begins, "right") - 1
    last = np.searchsorted(bounds, tokens, "left") - 1
    for i in np.flatnonzero(first != last):
        inner = np.arange(first[i], last[i] + 1)
        first[i] += np.argmax(np.minimum(bounds[inner + 1], tokens[i]) - np.maximum(bounds[inner], begins[i]))
    return np.bincount(first, minlength=len(bounds) - 1)


def section_tokens(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """One row for each section (a line with its line break) of each document: its span in code points and its tokens.

    ranks: a file of byte-pair ranks, pattern: how its tokenizer splits text. The counts of a document add up to the
    tokens of its whole text. Null text counts as empty; an empty text is one empty section; very long texts, lines and
    runs of white space are encoded whole; repeated rows are counted once each; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pieces = encoder(ranks, pattern)
        size = np.array([len(p) for p in pieces])
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                raw = np.frombuffer(data, np.uint8)
                ends = np.cumsum(size[encode(text)]) if data else np.zeros(0, np.int64)
                breaks = np.flatnonzero(raw == 10) + 1
                bounds = np.unique(np.concatenate([[0], breaks, [len(raw)]])) if len(raw) else np.array([0, 0])
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                n = attribute(ends, bounds)
                for c, x in zip(cols, ([doc] * len(n), range(len(n)), chars[:-1], chars[1:], n, [len(ends)] * len(n)), strict=True):
                    c.extend(x)
                if len(cols[0]) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
                    cols = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return typed(docs, doc_id="long", text="string").mapInArrow(count, SCHEMA)
