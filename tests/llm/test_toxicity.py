import random

import numpy as np
from codeweave.llm import toxicity as T

from .helpers import documents


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 120))]
        toxic = i % 7 == 0
        if toxic:
            words += [r.choice(["vile", "scumly", "vilest", "scumbag"]) for _ in range(r.randint(1, 8))]
        r.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_order(spark):
    rows = corpus(1500, 3)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.judge(docs, labels).collect()}
    held = [(got[i].toxic, y) for i, _, y in rows if i % 3 == 0]
    assert np.mean([p == bool(y) for p, y in held]) > 0.97
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.p_toxic <= 1 and r.expected_severity >= r.p_toxic - 1e-12 for r in got.values())
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - sum(not y for *_, y in rows)) < 30


def test_thresholds_share_weights():
    r = np.random.default_rng(1)
    n, bits = 3000, 10
    x = r.random((n, 6)) < 0.3
    score = x @ np.array([2.0, 1.5, -1.0, 0, 0, 0])
    grades = (score + r.logistic(size=n) > 1).astype(int) + (score + r.logistic(size=n) > 3).astype(int)
    rows, features = np.nonzero(x)
    m = T.fit_ordinal(rows, features, grades, bits)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[0] > m.weights[1] > 0 > m.weights[2] and abs(m.weights[4]) < 0.4
    above = m.exceeds(x @ m.weights[:6])
    assert (above[:, 0] >= above[:, 1]).all() and abs(above[:, 0].mean() - (grades >= 1).mean()) < 0.03


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "z " * 50_000)])
    got = T.judge(docs, labels).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    assert T.judge(documents(spark, []), labels).count() == 0
    assert T.drop_toxic(docs, labels.limit(0)).count() == 5


def test_features_of_long_texts_all_count(spark):
    """The toxic words' features come last by hash among the thousands of each text."""
    import pyarrow as pa

    def last(word):
        for _, _, w in T.words_of(pa.array([word]), T.ALNUM, T.LOWER):
            return T.mix(T._features(w, 1, T.BITS)[1].astype(T.U64)).min()

    words = sorted((f"q{i}" for i in range(3000)), key=last)[-1:]
    r = random.Random(4)
    rows = [(i, " ".join([f"w{r.randint(0, 10**9)}" for _ in range(1500)] + words * (i % 3 == 0)), int(i % 3 == 0)) for i in range(120)]
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x.toxic for x in T.judge(docs, labels).collect()}
    assert got == {i: bool(y) for i, _, y in rows}


def test_gradient_against_differences():
    """loss_and_gradient against the likelihood written out row by row, and its gradient against differences."""
    r = np.random.default_rng(2)
    n, m, top = 60, 5, 2
    x = r.random((n, m)) < 0.4
    grades = r.integers(0, top + 1, n)
    rows, features = np.nonzero(x)

    def plain(v):
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        total = 0.0
        for i in range(n):
            edges = [1.0, *(sigmoid(v[:m] @ x[i] - t) for t in v[m:]), 0.0]
            total -= np.log(edges[grades[i]] - edges[grades[i] + 1])
        return total / n + 0.01 * (v[:m] @ v[:m]) / 2

    for _ in range(3):
        v = np.concatenate([r.normal(size=m), np.sort(r.normal(size=top) + [0, 1])])
        loss, grad = T.loss_and_gradient(v, rows, features, grades, m, 0.01)
        assert abs(loss - plain(v)) < 1e-12
        steps = np.eye(len(v)) * 1e-6
        assert np.allclose(grad, [(plain(v + s) - plain(v - s)) / 2e-6 for s in steps], atol=1e-7)


def test_threshold_parts_best():
    r = np.random.default_rng(5)
    for _ in range(30):
        p, y = r.random(40).round(2), r.random(40) < 0.4
        t = T.best_threshold(p, y)
        right = lambda t: (p[y] >= t).mean() + (p[~y] < t).mean()
        assert right(t) >= max(right(x) for x in [*p, *(p + 1e-6)]) - 1e-9 or not y.any()
    assert T.best_threshold(np.array([0.01, 0.02, 0.98, 0.99]), np.array([False, False, True, True])).__round__(9) == 0.5
    assert T.best_threshold(np.array([0.3]), np.array([True])) == 0.5


def test_given_grades_and_repeated_rows(spark):
    """Severity in the labels themselves: mild words for grade 1, others for 2 and 3. Many rows of one labelled doc_id count once."""
    r = random.Random(9)
    rows = []
    for i in range(1200):
        grade = i % 4
        words = [f"w{r.randint(0, 300)}" for _ in range(30)] + [["rude"], ["rude", "nasty"], ["rude", "nasty", "vicious"]][grade - 1] * (grade > 0)
        rows.append((i, " ".join(words), grade))
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(0, rows[0][1])] * 300)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3], "doc_id long, grade int")
    got = {x.doc_id: x for x in T.judge(docs, labels, grade="grade").collect()}
    held = [(got[i], g) for i, _, g in rows if i % 3 == 0]
    assert np.mean([x.grade == g for x, g in held]) > 0.95 and all(x.toxic == (g > 0) for x, g in held)
    means = [np.mean([x.expected_severity for x, g in held if g == k]) for k in range(4)]
    assert all(a + 0.5 < b for a, b in zip(means, means[1:], strict=False))


def test_foreign_labels_change_nothing(spark):
    """Labels of documents that aren't there, many times the bound: the model is the same without them."""
    rows = corpus(400, 6)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    foreign = spark.range(10_000, 40_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    a, b = T.fit(docs, labels, max_rows=300), T.fit(docs, labels.union(foreign), max_rows=300)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all() and a.reject == b.reject and (a.weights != 0).any()
    assert T.judge(docs, labels.union(foreign), max_rows=300).filter("toxic").count() > 40


def test_fit_against_newton():
    """Weights and thresholds against Newton steps on the likelihood written out plainly, derivatives by differences."""
    r = np.random.default_rng(8)
    n, m = 1500, 4
    x = r.random((n, m)) < 0.4
    score = x @ np.array([2.5, 1.8, -2.0, 1.2])
    grades = (score + r.logistic(size=n) > 1).astype(int) + (score + r.logistic(size=n) > 3).astype(int)

    def loss(v):
        above = 1 / (1 + np.exp(v[m:][None, :] - (x @ v[:m])[:, None]))
        edges = np.column_stack([np.ones(n), above, np.zeros(n)])
        return -np.log(edges[np.arange(n), grades] - edges[np.arange(n), grades + 1]).mean() + 1e-4 * (v[:m] @ v[:m]) / 2

    v, h = np.array([0.0] * m + [0.5, 2.0]), 1e-4
    steps = np.eye(len(v)) * h
    for _ in range(12):
        grad = np.array([(loss(v + s) - loss(v - s)) / (2 * h) for s in steps])
        hess = np.array([[(loss(v + s + t) - loss(v + s - t) - loss(v - s + t) + loss(v - s - t)) / (4 * h * h) for t in steps] for s in steps])
        v = v - np.linalg.solve(hess, grad)
    model = T.fit_ordinal(*np.nonzero(x), grades, bits=6)
    assert np.allclose(model.weights[:m], v[:m], atol=0.02) and np.allclose(model.thresholds, v[m:], atol=0.02)
