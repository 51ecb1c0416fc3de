"""Alignment of two tokenizers against brute force over byte spans."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import crossalign, queries  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
BOTH = queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, B
SCHEMA = "doc_id long, text string, chunk string, pair string, pairs string, n string, best string, known string, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def spans(ids, spell):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spell(i)), i))
        at += len(spell(i))
    return out


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    # byte-level: printable bytes stand for themselves, the others in order for characters from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    spell_a = lambda i: bytes(level[c] for c in a.id_to_token(i))
    spell_b = spell_b_of(b)
    done, held = [], Counter()
    for doc, text in rows:
        x = y = []
        if text:
            x, y = spans(a.encode(" " + text, add_special_tokens=False).ids, spell_a), spans(b.encode(text), spell_b)
            want = (" " + text).encode()
            if b"".join(map(spell_a, (t[2] for t in x))) != want or b"".join(map(spell_b, (t[2] for t in y))) != want:
                x = y = []
        pairs = [(i, j) for s, e, i in x for u, v, j in y if s < v and u < e] if len(x) < 3000 else fast_pairs(x, y)
        held.update(set(pairs))
        cuts = sorted({t[1] for t in x} & {t[1] for t in y})
        groups, at = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for s, e, i in x if at < e <= c) + "|" + ",".join(str(i) for s, e, i in y if at < e <= c)) if len(x) < 3000 else None
            at = c
        done.append((doc, len(x), len(y), len(cuts), pairs, groups))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(doc, n, m, g, len(p), sum(held[q] == best[q[0]] for q in p), sum(held[q] for q in p), hashlib.sha256(";".join(names).encode()).hexdigest() if g else "") for doc, n, m, g, p, names in done]


def spell_b_of(b):
    def spell(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return spell


def fast_pairs(x, y):
    out, j = [], 0
    for s, e, i in x:
        while y[j][1] <= s:
            j += 1
        k = j
        while k < len(y) and y[k][0] < e:
            out.append((i, y[k][2]))
            k += 1
    return out


def test_brute_force(spark, monkeypatch):
    r = random.Random(4)
    letters = "abc the of ing 0123,.;é ü ß 漢字 🙂 ́ \t\n  "
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(1, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   two  spaces  "), (204, "a ▁ b"), (205, "<s> </s> <unk> <|endoftext|> <0x41>"), (206, "same text here"), (206, "same text here"), (None, "no id"), (207, "same text here"), (208, "\u0000 nul ﻿ bom"), (209, "ﬁ ligature ² Å")]
    rows += [(300 + i, "the cat sat on the mat, internationalization of tokenizers") for i in range(80)]  # a hot group
    monkeypatch.setattr(crossalign, "CHUNK_BYTES", 700)  # many chunks
    monkeypatch.setattr(crossalign, "CODE_BYTES", 300)
    monkeypatch.setattr(crossalign, "_SLICE", 7)
    got = crossalign.align(table(spark, rows), *BOTH)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    key = lambda t: (str(t[0]), t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    assert crossalign.align(table(spark, []), *BOTH).count() == 0


def test_long_texts(spark):
    r = random.Random(6)
    words = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(30_000))
    rows = [(1, words), (2, "x" * 100_000), (3, " " * 50_000), (4, "1" * 50_000), (5, words), (6, "a" + " " * 63 + "b" + " \n" * 40 + "c" + "\t" * 300 + "d" + " " * 99)]
    got = {x.doc_id: tuple(x)[1:7] for x in crossalign.align(table(spark, rows), *BOTH).collect()}
    assert all(got[i][0] > 0 and got[i][2] > 0 for i in (1, 2, 4, 6)) and got[1] == got[5]
    want = {x[0]: x for x in brute(rows)}
    assert got == {i: want[i][1:7] for i in got}


def test_pointers_meet_where_both_end():
    """A chain without a common end is one group, found in about log2 of its length steps."""
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a, b = (np.unique(np.append(r.integers(1, n + 1, r.integers(1, n + 1)), n)) for _ in "ab")
        last_a, last_b = crossalign.terminals(a, b)
        both = np.intersect1d(a, b)
        assert a[last_a].tolist() == both[np.searchsorted(both, a)].tolist() and a[last_b].tolist() == both[np.searchsorted(both, b)].tolist()
        i, j = crossalign.links(a, b)
        begins = lambda e: np.append(0, e[:-1])
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(len(a)) for y in range(len(b)) if begins(a)[x] < b[y] and begins(b)[y] < a[x]} and len(i) == len(np.union1d(a, b))
