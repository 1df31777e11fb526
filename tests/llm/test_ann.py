import numpy as np
import pandas as pd
import pytest
from codeweave.llm import ann as A


def table(spark, vectors, ids=None):
    rows = [(int(i), v, 3, "x") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string")


def exact(x, ids, k, every):
    out = {}
    x = x.astype(np.float32).astype(np.float64)
    for i in np.flatnonzero(np.asarray(ids) % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 32)).astype(np.float32)
    x[:1500] = x[7] + 0.3 * x[:1500]
    x[2000:2600] = x[2000]  # one vector very often
    ids = np.arange(4000)
    want = exact(x, ids, 20, 20)
    got = {}
    for row in A.nearest(table(spark, x.tolist())).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([sum(s >= want[q][-1][1] - 1e-6 for _, s in g.values()) / 20 for q, g in got.items()])
    assert recall >= 0.95
    for q, g in got.items():
        assert all(abs(s - x[q].astype(float) @ x[v].astype(float)) < 1e-6 for v, s in g.values())
        assert all((g[k][1], -g[k][0]) >= (g[k + 1][1], -g[k + 1][0]) for k in range(1, 20))


def test_few_rows_and_odd_vectors(spark):
    vectors = [[1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [], [2.0, 0.0], [1.0, 0.0], [1.0, 2.0, 3.0]]
    got = A.nearest(table(spark, vectors)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 8, 2.0), (0, 2, 9, 1.0), (0, 3, 1, 0.5)]
    # vectors of another length meet each other only
    mixed = A.nearest(table(spark, [[1.0], [2.0], [1.0, 2.0], [2.0, 1.0], [3.0, 3.0]], [20, 1, 40, 2, 3])).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mixed) == [(20, 1, 1, 2.0), (40, 1, 3, 9.0), (40, 2, 2, 4.0)]
    assert A.nearest(table(spark, [])).count() == 0 and A.nearest(table(spark, [[1.0]], [20])).count() == 0


def test_robust_prune_keeps_diverse_edges():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2]], dtype=np.float32)
    kept = A.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 1, -1]]), 3, 1.2)[0]
    assert list(kept) == [1, 3, -1]


def doubles(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("scale", [1.0, 1e-50, 1e100])
def test_double_precision_at_every_size(spark, scale):
    """Scores are those of the original doubles, and no vector is lost to single precision."""
    x = np.random.default_rng(6).normal(size=(200, 16)) * scale
    got = {}
    for r in A.nearest(doubles(spark, x.tolist())).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 200, 20)) and all(len(g) == 20 for g in got.values())
    hits = 0
    for q, g in got.items():
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(200), -s)) if j != q][:20]
        hits += len({v for _, v, _ in g} & set(want))
        assert all(abs(score - s[v]) <= 1e-12 * np.abs(x[v]) @ np.abs(x[q]) for _, v, score in g)
    assert hits >= 0.95 * 200


def test_all_reverse_edges_are_offered():
    """A hub is offered far more friends than fit in one pass; a search still finds each point from the hub's side."""
    r = np.random.default_rng(8)
    x = np.concatenate([np.zeros((1, 8)), r.normal(size=(900, 8))]).astype(np.float32)
    graph, start = A.build_graph(x, degree=8, beam=32)
    nodes, _ = A.beam_search(x, graph, start, x, 32)
    assert (nodes[:, 0] == np.arange(len(x))).mean() > 0.95 and (graph < len(x)).all()


def unequal(n, spread, seed, dim=64):
    """Gaussian vectors; spread: deviation of the logarithm of a further factor of their length."""
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dim)) * np.exp(spread * r.normal(size=(n, 1)))


@pytest.mark.parametrize("n, spread", [(5000, 0.0), (5000, 0.3), (5000, 0.7), (20_000, 0.0)])
def test_recall_of_one_graph_on_unequal_norms(n, spread):
    """Inner products of vectors of unequal length, one shard of n rows, against brute force."""
    x = unequal(n, spread, n)
    row = A._shard_rows(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "shard": 0}), A.K).iloc[0].to_dict()
    own = np.arange(0, n, n // 200)
    q, v, _ = A._Shard(row).search(own, x[own], A.K, A.SEARCH_BEAM)
    hits = 0
    for i in own:
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(set(v[q == i]) & set(np.argsort(-s)[: A.K]))
    print(n, spread, hits / A.K / len(own))
    assert hits >= 0.9 * A.K * len(own)
