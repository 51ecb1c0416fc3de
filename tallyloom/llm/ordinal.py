"""Document quality by ordinal cumulative-link regression: hashed-text weights shared by all grades, ordered thresholds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, typed

BUCKETS = 1 << 18
#: Labelled documents that the fit reads at most: the first by a hash of doc_id.
SAMPLE = 8_000
#: A bucket takes part if this many labelled documents have it and their mean grade is this many standard errors off.
LEAST_DOCS, LEAST_Z = 8, 4.0
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\s]+")
_UPPER, _LETTER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Hasher:
    """Distinct buckets of a text: of its lower-case words, their beginnings of 4 to 6 letters, and its mark runs, and of
    classes of its share of capitals, marks, repeated lines and repeated neighbours.

    With `only`, buckets of weight 0 are left out as words come up, so that scoring touches little but what counts.
    """

    def __init__(self, only: np.ndarray | None = None, cache: int = 150_000):
        self.only, self.cache, self.known = only, cache, {}

    def _word(self, token: bytes) -> tuple[int, ...]:
        word = token.decode() if token[0] > 47 else ""
        found = [zlib.crc32(token) % BUCKETS, *(zlib.crc32(b"%d:" % n + word[:n].encode()) % BUCKETS for n in (4, 5, 6) if len(word) >= n)]
        return tuple(found) if self.only is None else tuple(b for b in found if self.only[b])

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode()
        size = max(1, len(data))
        letters = size - len(data.translate(None, _LETTER))
        lines, tokens = data.split(b"\n"), _TOKEN.findall(data.lower())
        shape = (
            b"\0upper%d" % (10 * (size - len(data.translate(None, _UPPER))) // max(1, letters)),
            b"\0marks%d" % min(9, 100 * (size - len(data.translate(None, b"|#$%&*!"))) // size),
            b"\0lines%d" % (10 * (len(lines) - len(set(lines))) // len(lines)),
            b"\0again%d" % (10 * sum(map(eq, tokens, tokens[1:])) // max(1, len(tokens))),
        )
        words = {*tokens, *shape}
        if len(self.known) > self.cache:
            self.known = {}
        for t in words.difference(self.known):
            self.known[t] = self._word(t)
        return np.unique(np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), np.int32))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - score), score = sum of the weights of a text's buckets."""

    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def grades(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)


def _cuts(p: np.ndarray, f: int) -> np.ndarray:
    """The cuts, from the first one and the logarithms of the steps between them, which come after f weights."""
    return p[f] + np.concatenate([[0], np.cumsum(np.exp(p[f + 1 :]))])


def loss(p: np.ndarray, f: int, at: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Negative logarithm of the likelihood, plus the ridge, and its gradient. p: f weights, the first cut, the steps' logarithms."""
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    s = np.bincount(at, p[cols], len(grades))
    edge = np.concatenate([[-np.inf], _cuts(p, f), [np.inf]])
    hi, lo = sig(edge[grades + 1] - s), sig(edge[grades] - s)
    hi, lo = np.where(grades == n_grades - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
    like = np.maximum(hi - lo, 1e-9)
    dhi, dlo = hi * (1 - hi) / like, lo * (1 - lo) / like
    g = np.empty_like(p)
    g[:f] = np.bincount(cols, (dhi - dlo)[at], f) + ridge * p[:f] * 10
    by_cut = np.array([-dhi[grades == k].sum() + dlo[grades == k + 1].sum() for k in range(n_grades - 1)])
    g[f] = by_cut.sum()
    for k in range(n_grades - 2):
        g[f + 1 + k] = by_cut[k + 1 :].sum() * np.exp(p[f + 1 + k])
    return float(-np.log(like).sum() + 5 * ridge * (p[:f] ** 2).sum()), g


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, ridge: float = 0.05, rounds: int = 300) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over the whole sample; cuts stay ordered as a first cut and positive steps."""
    n = len(grades)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows) if n else np.zeros(0, np.int32)
    df = np.bincount(flat, minlength=BUCKETS)
    mean, sd = (grades.mean(), max(grades.std(), 1e-9)) if n else (0.0, 1.0)
    total = np.bincount(flat, grades[at], BUCKETS)
    z = (total - df * mean) / (sd * np.sqrt(np.maximum(df, 1)))
    buckets = np.flatnonzero((df >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    name = np.full(BUCKETS, -1)
    name[buckets] = np.arange(len(buckets))
    cols = name[flat]
    at, cols = at[cols >= 0], cols[cols >= 0]
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (n + n_grades)
    cuts = np.log(share / (1 - share))
    f = len(buckets)
    p = np.concatenate([np.zeros(f), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1 if n else 1):
        g = loss(p, f, at, cols, grades, n_grades, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(buckets, p[:f], _cuts(p, f))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels(doc_id, quality, toxic): 0 toxic, 1 of low quality, 2 good; one per doc_id, the lowest of several."""
    t = typed(labels, doc_id="long", quality="int", toxic="int")
    grade = F.when(F.col("toxic") > 0, 0).otherwise(F.when(F.col("quality") > 0, 2).when(F.col("quality") == 0, 1))
    return t.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most `sample` labelled documents, whatever the order of rows: of rows that repeat an id the smallest text
    counts, and texts with equal features count once, with the lowest of their grades. Features are made in the tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], ["grade", "buckets"])

    # the sample has a fixed bound, so it is small enough to send to every task
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = typed(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))
    made = one.select("grade", "text").mapInArrow(make, "grade int, buckets array<int>")
    rows = made.groupBy("buckets").agg(F.min("grade").alias("grade")).toArrow()  # `sample` rows at most
    grades = rows.column("grade").to_numpy().astype(np.int64)
    lists = [x.values.to_numpy() for x in rows.column("buckets")]
    order = sorted(range(len(lists)), key=lambda i: lists[i].tobytes())
    return fit_ordinal([lists[i] for i in order], grades[order], 3)


SCHEMA = "doc_id long, expected_grade double, p_good double, keep boolean"


def _scores(texts: pa.Array, hashed: Hasher, model: OrdinalModel, weights: np.ndarray) -> np.ndarray:
    return model.grades(np.array([weights[hashed(t.as_py())].sum() for t in texts]))


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Per document: expected grade, P(grade is good) and whether that tail reaches `least`.

    Null and empty texts have the shape features of an empty text; equal texts get equal results; without labels nothing
    is known, so the model has no weights, and every document has the same grade. No prefix or cap on text length.
    """
    model = docs.sparkSession.sparkContext.broadcast(_plain(train(docs, labels, sample)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = _full(model.value)
        hashed = Hasher(weights != 0)
        for batch in sliced(batches):
            p = _scores(batch.column(1), hashed, own, weights)
            tail = p[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(p.shape[1])), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "p_good", "keep"])

    return typed(docs, doc_id="long", text="string").mapInArrow(judge, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that classify() keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(_plain(train(docs, labels, sample)))
    at = docs.columns.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = _full(model.value)
        hashed = Hasher(weights != 0)
        for batch in sliced(batches):
            yield batch.filter(pa.array(_scores(batch.column(at), hashed, own, weights)[:, -1] >= least))

    return docs.mapInArrow(drop, docs.schema)


def _plain(model: OrdinalModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return model.buckets, model.weights, model.cuts


def _full(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[OrdinalModel, np.ndarray]:
    model, weights = OrdinalModel(*parts), np.zeros(BUCKETS)
    weights[model.buckets] = model.weights
    return model, weights
