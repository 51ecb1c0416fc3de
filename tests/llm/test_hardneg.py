"""Hard negatives against brute force in whole numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tallyloom.llm")
from tallyloom.llm import hardneg  # noqa: E402

SCHEMA = "vec_id long, label int, embedding array<double>, shard string, block string, ids string, x string, rank string, chosen string, lead string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def brute(rows, anchor, k=5, m=10, low=30, high=90):
    whole = []
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        bound = min(2**30, int((2**62 / max(len(x), 1)) ** 0.5))
        whole.append((vec_id, label, [max(-bound, min(bound, int(np.floor(256 * v)))) for v in x]))
    out = []
    for a, label, x in whole:
        if not anchor(a):
            continue
        score = [(-sum(p * q for p, q in zip(x, y)), v, lab) for v, lab, y in whole]
        for s, p, _ in sorted(t for t in score if t[1] != a and t[2] == label)[:k]:
            fit = sorted(t for t in score if t[2] != label and low * -s <= -100 * t[0] <= high * -s)[:m]
            out += [(a, p, r + 1, t[1], -s, -t[0]) for r, t in enumerate(fit)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(i, r.choice([0, 0, 0, 1, 2]), [r.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    out += [(400 + i, 7, [0.25] * 12) for i in range(60)] + [(500 + i, 8, [0.125] * 12) for i in range(60)]  # ties over a third of the rows
    out += [(20, 1, out[20][2]), (20, 1, out[20][2]), (30, 2, [1.0] * 12)]  # repeated ids, equal and not
    out += [(None, 1, [1.0] * 12), (610, None, [1.0] * 12), (620, 1, None), (630, 1, [None] * 12), (640, 1, [float("nan")] * 12), (650, 1, [float("inf")] * 12)]
    out += [(660, 1, []), (670, 1, [0.0] * 12), (680, 1, [0.5, -0.5, 0.25]), (690, 0, [1e30] * 12), (691, 0, [1e30] * 12), (692, 1, [-1e30] * 6 + [1e29] * 6), (700, 99, [1.0] * 12)]
    return out


def test_brute_force(spark, rows):
    want = brute(rows, lambda v: v % 10 == 0)
    assert len(want) > 500 and mined(table(spark, rows)) == want
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, 1, [1.0])])) == []
    assert hardneg.mine(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_one_label_holds_all(spark):
    assert mined(table(spark, [(i, 1, [1.0, float(i)]) for i in range(50)])) == []


def test_lists_stop_early():
    """A clear best direction is found without scoring all rows; a tie is read to its end."""
    r = np.random.default_rng(5)
    matrix = r.integers(-40, 40, (5000, 4)).astype(np.int32)
    matrix[:30] = [200, 200, 0, 0]
    lists = hardneg.Lists(np.arange(5000), np.zeros(5000, np.int64), matrix)
    best = hardneg.Best(10)
    lists.search(np.array([9, 9, 1, -1]), np.ones(5000, bool), [best])
    score = matrix.astype(np.int64) @ [9, 9, 1, -1]
    assert best.ids.tolist() == np.lexsort((np.arange(5000), -score))[:10].tolist() and lists.read < 1000
    shut = hardneg.Best(10, lo=10**6)
    lists.read = 0
    lists.search(np.array([9, 9, 1, -1]), np.ones(5000, bool), [shut])
    assert lists.read == 0 and not len(shut.ids)
