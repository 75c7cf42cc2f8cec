import math
import random

import numpy as np
import pyarrow as pa

from tallyframe.llm.quality import accepted, features, fit, loss, scored, train


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(n):
        kind = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if kind == 0:
            text = [w + "###" for w in text]
        if kind == 1:
            text[rng.randrange(len(text))] = rng.choice(["badword", "worseword"])
        rows.append((k, " ".join(text), "s"))
        labels.append((k, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_held_out_accuracy_and_order(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    model = train(docs, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in scored(docs, model).collect()}
    held = labels[600:]
    assert np.mean([got[k].keep == (q == 1 and t == 0) for k, q, t in held]) > 0.97
    assert all(r.p_good >= r.p_clean and abs(r.expected_grade - r.p_good - r.p_clean) < 1e-9 for r in got.values())
    again = {r.doc_id: r for r in scored(docs, train(docs.repartition(3), spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int").repartition(5))).collect()}
    assert again == got


def test_edges(spark):
    rows, labels = corpus(200, 2)
    docs = spark.createDataFrame(rows + [(900, None, "x"), (900, None, "x"), (None, "a " * 50_000, None)], "doc_id long, text string, keep string")
    marks = spark.createDataFrame([*labels, (5, 0, 0), (7, None, 1), (None, 1, 1), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, marks)
    assert scored(docs, model).count() == 203
    kept = accepted(docs, marks)
    assert kept.columns == docs.columns and kept.filter("keep = 's'").count() > 50
    assert train(docs, marks.limit(0)) is None and scored(docs, None).filter("keep").count() == 203
    assert scored(docs.limit(0), model).count() == 0
    doc, feature = features(pa.array(["", "x x", "x x"]))
    assert list(feature[doc == 1]) == list(feature[doc == 2])
    one = fit(np.array([0]), np.array([5]), np.array([2]))
    assert np.isfinite(one.thresholds).all()


def test_loss_and_gradient_equal_brute_force():
    """The likelihood by its definition, document by document, and its gradient by differences."""
    rng = np.random.default_rng(6)
    n, used, l2 = 40, 7, 0.3
    has = rng.random((n, used)) < 0.4
    doc, col = np.nonzero(has)
    grade = rng.integers(0, 3, n)
    p = rng.normal(size=used + 2)

    def plain(p):
        theta = [p[used], p[used] + math.exp(p[used + 1])]
        total = 0.0
        for i in range(n):
            score = sum(p[j] for j in range(used) if has[i, j])
            below = [1 / (1 + math.exp(-(t - score))) for t in theta]
            total -= math.log([below[0], below[1] - below[0], 1 - below[1]][grade[i]])
        return total / n + l2 * sum(x * x for x in p[:used]) / (2 * n)

    value, gradient = loss(p, doc, col, grade, used, l2)
    assert math.isclose(value, plain(p), rel_tol=1e-9)
    for k in range(used + 2):
        step = np.zeros(used + 2)
        step[k] = 1e-5
        assert math.isclose(gradient[k], (plain(p + step) - plain(p - step)) / 2e-5, rel_tol=1e-5, abs_tol=1e-8)


def test_training_reaches_the_least_loss():
    """No step in any direction from the fitted weights and thresholds is better by much."""
    rng = np.random.default_rng(7)
    n = 600
    grade = rng.integers(0, 3, n)
    has = np.stack([rng.random(n) < 0.1 + 0.35 * (grade == 0), rng.random(n) < 0.1 + 0.5 * (grade <= 1), rng.random(n) < 0.3], axis=1)
    doc, col = np.nonzero(has)
    model = fit(doc, np.array([300, 400, 500])[col], grade)
    kept = np.array([model.weights[300] != 0, model.weights[400] != 0, model.weights[500] != 0])
    assert kept.tolist() == [True, True, False]  # the third is no sign of any grade
    p = np.array([model.weights[300], model.weights[400], model.thresholds[0], math.log(model.thresholds[1] - model.thresholds[0])])
    some = col < 2
    best, gradient = loss(p, doc[some], col[some], grade, 2, 0.02)
    assert np.abs(gradient).max() < 1e-3
    for _ in range(50):
        assert loss(p + rng.normal(scale=0.05, size=4), doc[some], col[some], grade, 2, 0.02)[0] > best - 1e-6


def test_no_more_rows_than_the_sample_are_fetched(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("tallyframe.llm.quality.fit", lambda doc, feature, grade: seen.append(len(grade)))
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(900)], "doc_id long, text string")
    train(docs, spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id long, quality int, toxic int"), max_rows=2)
    assert seen == [2]
