"""Toxicity as ordinal regression: a cumulative-link (proportional-odds) model over sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k), theta_1 < theta_2 < ...: one weight vector for all thresholds. x marks which
hashed features a text has: its words and their leading 4, 5 and 6 bytes (A-Z lower-cased), so inflected forms of
a stem share a feature. Expected severity is the sum of P(grade >= k) over k.

Fitting takes a bounded sample of labelled rows (MAX_FIT_ROWS, those of least hash of doc_id), one for each doc_id, with
its whole text: executors count the rows and toxic rows of every feature, then send the selected features of each row; the
driver takes gradient steps with an L2 penalty. Scoring covers every row, map-side; the model is 2**BITS numbers
whatever the corpus. Only features that a chi-square test ties to a grade above 0 get weights, so the many rare features
of single texts can't explain the labels away.

The rejection threshold is part of the fit: FOLDS models, each fitted without a fold of the rows, score the rows left
out, and the threshold is where these scores part the toxic rows from the others best.

Labels that are only 0 or 1 give no severity of their own. severity_grades then splits the toxic rows by how many strongly
toxic features they hold, which are features that the model sees too: the upper grade says that a text has much of what
toxic texts have, not that a reader called it worse. Labels with grades (the argument `grade`) are fitted as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_BASE, LOWER, U64, Words, _ranges, materialise, mix, words_of

BITS, PREFIXES = 18, (4, 5, 6)
MAX_FIT_ROWS = 12_000
FOLDS = 4


def _features(w: Words, texts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of a slice, without repeats, by text."""
    keys = [w.hashes >> U64(64 - bits)]
    folded = LOWER[w.data].astype(U64) + U64(1)
    for i, size in enumerate(PREFIXES):
        ends = np.minimum(w.starts + size, w.ends)
        keys.append(mix(_ranges(folded, BYTE_BASE, w.starts, ends) + U64(1000 + i)) >> U64(64 - bits))
    both = np.unique((np.tile(w.text, len(keys)).astype(np.int64) << bits) | np.concatenate(keys).astype(np.int64))
    return both >> bits, both & ((1 << bits) - 1)


def _count_batches(bits: int):
    """(feature, n, hot) of a task: rows and rows of grade above 0 that have the feature; all rows count for feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hot, total = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            positive = batch.column("grade").to_numpy(zero_copy_only=False) > 0
            total += (len(positive), positive.sum())
            for first, end, w in words_of(batch.column("text"), ALNUM, LOWER):
                text, feature = _features(w, end - first, bits)
                n += np.bincount(feature, minlength=1 << bits)
                hot += np.bincount(feature[positive[first + text]], minlength=1 << bits)
        seen = np.flatnonzero(n)
        columns = (np.append(seen, -1).astype(np.int32), np.append(n[seen], total[0]), np.append(hot[seen], total[1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["feature", "n", "hot"])

    return run


def _feature_batches(bits: int, shared):
    """The selected features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(1 << bits, dtype=bool)
        chosen[shared.value] = True
        for batch in batches:
            lists = []
            for first, end, w in words_of(batch.column("text"), ALNUM, LOWER):
                text, feature = _features(w, end - first, bits)
                text, feature = text[chosen[feature]], feature[chosen[feature]]
                cuts = np.searchsorted(text, np.arange(end - first + 1))
                lists += [feature[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(lists, pa.list_(pa.int32()))], names=["grade", "features"])

    return run


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    #: From this P(grade >= 1) on a text is rejected.
    reject: float = 0.5

    def exceeds(self, margin: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -40, 40)))


def _tied(seen: np.ndarray, hot: np.ndarray, share: float, least_chi2: float = 20.0, least_rows: int = 4) -> np.ndarray:
    return (seen >= least_rows) & ((hot - seen * share) ** 2 >= least_chi2 * np.maximum(seen * share * (1 - share), 1e-9))


def _strong(seen: np.ndarray, hot: np.ndarray, n: int, toxic: int) -> np.ndarray:
    strong = np.log((hot + 0.5) / (toxic + 1)) - np.log((seen - hot + 0.5) / (n - toxic + 1)) > 3
    return strong & (hot >= 3)


def associated(rows: np.ndarray, features: np.ndarray, positive: np.ndarray, bits: int, least_chi2: float = 20.0, least_rows: int = 4) -> np.ndarray:
    """Which features occur in at least least_rows texts and significantly more or less often in positive ones."""
    size, share = 1 << bits, positive.mean() if len(positive) else 0.0
    seen = np.bincount(features, minlength=size)
    hot = np.bincount(features, weights=positive[rows], minlength=size)
    return _tied(seen, hot, share, least_chi2, least_rows)


def loss_and_gradient(x: np.ndarray, rows: np.ndarray, features: np.ndarray, grades: np.ndarray, m: int, l2: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood plus l2 |w|^2 / 2 at x = (m weights, thresholds), and its gradient."""
    n, top = len(grades), len(x) - m
    w, theta, each = x[:m], x[m:], np.arange(n)
    margin = np.bincount(rows, weights=w[features], minlength=n)
    above = 1 / (1 + np.exp(np.clip(theta[None, :] - margin[:, None], -40, 40)))
    edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    p = np.maximum(edges[each, grades] - edges[each, grades + 1], 1e-9)
    slope = edges * (1 - edges)
    to_margin = (slope[each, grades + 1] - slope[each, grades]) / p / n
    to_theta = [((slope[:, k] / p) * ((grades == k).astype(float) - (grades == k - 1))).sum() / n for k in range(1, top + 1)]
    return float(-np.log(p).mean() + l2 * (w @ w) / 2), np.concatenate([np.bincount(features, weights=to_margin[rows], minlength=m) + l2 * w, to_theta])


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, bits: int = BITS, l2: float = 1e-4, steps: int = 400) -> OrdinalModel:
    """Adam steps on loss_and_gradient; rows, features: where x is 1."""
    n, top, size = len(grades), max(1, int(grades.max(initial=0))), 1 << bits
    share = np.array([np.clip((grades >= k).mean() if n else 0.5, 1e-3, 1 - 1e-3) for k in range(1, top + 1)])
    theta = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(top))
    weights = np.zeros(size)
    chosen = np.flatnonzero(associated(rows, features, (grades > 0).astype(float), bits))
    if not len(chosen):
        return OrdinalModel(weights, theta, bits)
    number = np.full(size, -1)
    number[chosen] = np.arange(len(chosen))
    rows, features = rows[number[features] >= 0], number[features[number[features] >= 0]]
    m = len(chosen)
    x, first, second = np.concatenate([np.zeros(m), theta]), np.zeros(m + top), np.zeros(m + top)
    for step in range(1, steps + 1):
        _, grad = loss_and_gradient(x, rows, features, grades, m, l2)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        x = x - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        x[m:] = np.maximum.accumulate(x[m:])
    weights[chosen] = x[:m]
    return OrdinalModel(weights, x[m:], bits)


def held_out_scores(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, folds: int = FOLDS, **options) -> np.ndarray:
    """P(grade >= 1) of each row by the model fitted without the row's fold; rows are dealt to folds in turn."""
    n = len(grades)
    fold, out = np.arange(n) % folds, np.zeros(n)
    for f in range(folds):
        own, kept = fold == f, np.flatnonzero(fold != f)
        place = np.full(n, -1)
        place[kept] = np.arange(len(kept))
        inside = place[rows] >= 0
        model = fit_ordinal(place[rows[inside]], features[inside], grades[kept], **options)
        margin = np.bincount(rows, weights=model.weights[features], minlength=n)
        out[own] = model.exceeds(margin)[own, 0]
    return out


def best_threshold(p: np.ndarray, positive: np.ndarray) -> float:
    """Where p parts positive rows from others with the highest sum of both rates of right answers, in the middle of the
    widest such gap between scores (in log-odds). 0.5 where rows of a kind are missing."""
    if not positive.any() or positive.all():
        return 0.5
    odds = np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))
    cuts = np.unique(odds)
    hit = np.searchsorted(np.sort(odds[positive]), cuts)  # positive rows below each cut
    free = np.searchsorted(np.sort(odds[~positive]), cuts)
    right = (1 - hit / positive.sum()) + free / (~positive).sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    best = best[best > 0] if (best > 0).any() else best
    gap = cuts[best] - cuts[np.maximum(best - 1, 0)]
    k = best[int(np.argmax(gap))]
    return float(1 / (1 + np.exp(-(cuts[k] + cuts[max(k - 1, 0)]) / 2)))


def severity_grades(rows: np.ndarray, features: np.ndarray, toxic: np.ndarray, bits: int = BITS) -> np.ndarray:
    """0, 1 or 2 from binary labels: a toxic text with more than the toxic median of strongly toxic features is severe.

    A feature is strongly toxic if its smoothed log-odds between toxic and other texts exceed 3.
    """
    size, n = 1 << bits, len(toxic)
    hot = np.bincount(features, weights=toxic[rows], minlength=size)
    strong = _strong(np.bincount(features, minlength=size), hot, n, toxic.sum())
    count = np.bincount(rows, weights=strong[features], minlength=n)
    middle = np.median(count[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(count > middle, 2, 1), 0).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, grade: str | None = None, max_rows: int = MAX_FIT_ROWS, bits: int = BITS) -> OrdinalModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0/1, or integer grades in the column `grade`).

    Labels that are null, and rows without a partner, take no part; a doc_id labelled twice takes its highest label, and of
    several texts of a doc_id the greatest in order counts. With no labelled row at all every text scores even odds
    at most and none is rejected.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade or "toxic").cast("int").alias("grade")).filter("doc_id is not null and grade >= 0")
    # only labels of these documents count towards the bound
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    y = y.groupBy("doc_id").agg(F.max("grade").alias("grade")).join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    once = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.max("text").alias("text"))
    rows = materialise(once.select("grade", "text"), "toxicity-sample")
    counts = rows.mapInArrow(_count_batches(bits), "feature int, n long, hot long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hot").alias("hot")).toArrow()
    feature, seen, hot = (counts.column(c).to_numpy() for c in ("feature", "n", "hot"))
    n, toxic = int(seen[feature < 0].sum()), int(hot[feature < 0].sum())
    chosen = _tied(seen, hot, toxic / n if n else 0.0) | _strong(seen, hot, n, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(feature[chosen & (feature >= 0)])
    sample = rows.mapInArrow(_feature_batches(bits, shared), "grade int, features array<int>").toArrow()
    lists = sample.column("features").combine_chunks()
    features = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), np.array(lists.value_lengths().to_pylist(), dtype=np.int64))
    grades = sample.column("grade").to_numpy().astype(np.int64)
    if grade is None:
        grades = severity_grades(rows, features, (grades > 0).astype(np.int64), bits)
    model = fit_ordinal(rows, features, grades, bits)
    if not (grades > 0).any():
        model.thresholds = np.full_like(model.thresholds, 40.0)
    model.reject = best_threshold(held_out_scores(rows, features, grades, bits=bits), grades > 0)
    return model


def _margins(column: pa.Array, model: OrdinalModel) -> np.ndarray:
    """w . x of each text."""
    out = np.zeros(len(column))
    for first, end, w in words_of(column, ALNUM, LOWER):
        text, feature = _features(w, end - first, model.bits)
        out[first:end] = np.bincount(text, weights=model.weights[feature], minlength=end - first)
    return out


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: OrdinalModel = shared.value
        for batch in batches:
            above = model.exceeds(_margins(batch.column("text"), model))
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            columns["p_toxic"] = pa.array(above[:, 0])
            columns["expected_severity"] = pa.array(above.sum(axis=1))
            columns["grade"] = pa.array((above >= 0.5).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, model: OrdinalModel, keep_text: bool = False) -> DataFrame:
    """doc_id (and text), p_toxic = P(grade >= 1), expected_severity, grade (thresholds passed at even odds).

    Every row of docs gives one row, repeated ones too; a null or empty text has no features. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(_score_batches(shared), "doc_id long, text string, p_toxic double, expected_severity double, grade int")
    return out if keep_text else out.drop("text")


def judge(docs: DataFrame, labels: DataFrame, reject: float | None = None, **fit_options) -> DataFrame:
    """score() by a model fitted on docs and labels, with toxic = p_toxic >= reject (by default the model's own threshold)."""
    model = fit(docs, labels, **fit_options)
    return score(docs, model).withColumn("toxic", F.col("p_toxic") >= (model.reject if reject is None else reject))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float | None = None) -> DataFrame:
    """The rows of docs, all columns, whose text the model doesn't reject; scored in place, without a join."""
    model = fit(docs, labels)
    shared, least = docs.sparkSession.sparkContext.broadcast(model), model.reject if reject is None else reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.exceeds(_margins(batch.column("text"), shared.value))[:, 0]
            yield batch.filter(pa.array(p < least))

    return docs.mapInArrow(run, docs.schema)
