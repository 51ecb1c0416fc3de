"""The ordinal classifier: its gradient, its optimum, its sample; and the pipeline where it drops some, or has nothing."""

import random

import numpy as np
import pytest

pytest.importorskip("tallyloom.llm")
import corpus_pipeline  # noqa: E402
from tallyloom.llm import ordinal  # noqa: E402


def problem(seed, n=300, f=7, n_grades=3):
    r = np.random.default_rng(seed)
    at, cols = np.nonzero(r.random((n, f)) < 0.4)
    score = np.bincount(at, np.linspace(-2, 2, f)[cols], n)
    grades = np.digitize(score + r.logistic(size=n), np.linspace(-1, 1, n_grades - 1))
    return at, cols, grades


@pytest.mark.parametrize("n_grades", [2, 3, 5])
def test_gradient_equals_differences(n_grades):
    at, cols, grades = problem(1, n_grades=n_grades)
    p = np.random.default_rng(2).normal(0, 0.3, 7 + n_grades - 1)
    g = ordinal.loss(p, 7, at, cols, grades, n_grades, 0.05)[1]
    for i in range(len(p)):
        step = np.zeros_like(p)
        step[i] = 1e-6
        up, down = (ordinal.loss(p + s * step, 7, at, cols, grades, n_grades, 0.05)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-3 * max(1, abs(g[i]))


def test_fit_reaches_the_optimum_of_plain_descent(monkeypatch):
    at, cols, grades = problem(3)
    monkeypatch.setattr(ordinal, "LEAST_Z", 0.0)
    monkeypatch.setattr(ordinal, "LEAST_DOCS", 1)
    rows = [cols[at == i].astype(np.int32) for i in range(len(grades))]
    model = ordinal.fit_ordinal(rows, grades, 3, rounds=2000)
    p = np.concatenate([model.weights, model.cuts[:1], np.log(np.diff(model.cuts))])
    q = np.zeros(9)
    for _ in range(20_000):
        q -= 0.002 * ordinal.loss(q, 7, at, cols, grades, 3, 0.05)[1]
    got, want = (ordinal.loss(x, 7, at, cols, grades, 3, 0.05)[0] for x in (p, q))
    assert abs(got - want) < 0.01 and np.abs(p - q).max() < 0.05 and (np.diff(model.cuts) > 0).all()


def test_sample_does_not_depend_on_the_order_of_rows(spark):
    r = random.Random(5)
    say = lambda bad: " ".join(r.choice(["junk", "spam", "win"] if bad else ["river", "stone", "light"]) + r.choice(["", " ", f" n{r.randrange(400)}"]) for _ in range(12))
    rows = [(i, say(i % 3 == 0)) for i in range(600)]
    # equal texts of different grades: the lowest counts; an id with many texts: the smallest one
    rows += [(1500 + i, "the same text twice") for i in range(4)] + [(7, f"zz other text {i}") for i in range(200)] + [(8, None)]
    labels = [(i, int(i % 3 > 0), int(i % 6 == 0)) for i in range(600)] + [(1500 + i, i % 2, int(i == 3)) for i in range(4)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = []
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        models.append(ordinal.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), table))
    assert all(np.array_equal(getattr(models[0], c), getattr(models[1], c)) for c in ("buckets", "weights", "cuts"))
    assert len(models[0].buckets) > 0


def written(spark, tmp_path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [], [])).count() == 0


def test_pipeline_in_which_the_classifier_drops_some(spark, tmp_path):
    r = random.Random(6)
    say = lambda bad: " ".join(r.choice("junk spam win casino click".split() if bad else "river stone light winter garden".split()) + str(r.randrange(3)) for _ in range(30))
    docs = [(i, say(i % 4 == 0), "en", "s", 1) for i in range(200)]
    labels = [(i, int(i % 4 > 0), int(i % 8 == 0)) for i in range(160)]
    where = written(spark, tmp_path, docs, labels, [(1, "ten words of a benchmark item that no document holds here")])
    kept = {x.doc_id for x in ordinal.classify(spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")).where("keep").collect()}
    good = {i for i in range(200) if i % 4}
    assert len(kept & good) >= 0.95 * len(good) and len(kept - good) <= 2
    assert {x.doc_id for x in corpus_pipeline.run(spark, where).select("doc_id").distinct().collect()} == kept
