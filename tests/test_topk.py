import random

import pytest
from codeweave.functions import scores, text
from codeweave.operators import classify, lookup, topk
from pyspark.sql import functions as F


def brute(anchors, candidates, n, weights=scores.LOOKUP, digits=4):
    out = []
    for i, a in anchors:
        a, found = set(a or ()), []
        for j, c in candidates:
            c = set(c or ())
            both = len(a & c)
            s = weights[0] * (both / (len(a) + len(c) - both)) + weights[1] * (both / len(a)) if both else 0.0
            found.append((-round(s, digits), j))
        out += [(i, j, -s, k + 1) for k, (s, j) in enumerate(sorted(found)[:n])]
    return sorted(out)


def sets(r, n, vocabulary, low, high, skew=2.0):
    return [(i, r.sample(range(vocabulary), 0) if low > high else sorted({int(vocabulary * r.random() ** skew) for _ in range(r.randint(low, high))})) for i in range(n)]


def table(spark, rows, key):
    return spark.createDataFrame([(i, None if t is None else [f"t{x}" for x in t]) for i, t in rows], f"{key} long, tokens array<string>")


@pytest.mark.parametrize("seed, vocabulary, high, n", [(1, 40, 6, 5), (2, 300, 30, 3), (3, 8, 3, 10), (4, 5000, 12, 5)])
def test_batch_by_tokens_against_brute_force(spark, seed, vocabulary, high, n):
    """Repeated sets, hot tokens, ties, empty sets and anchors without enough partners."""
    r = random.Random(seed)
    anchors, candidates = sets(r, 60, vocabulary, 0, high), sets(r, 150, vocabulary, 0, high)
    anchors += [(100, None), (101, [99999]), (102, candidates[3][1])]
    candidates += [(1000 + i, candidates[3][1]) for i in range(20)] + [(2000, None)]
    got = lookup.batch_by_tokens(table(spark, anchors, "anchor_id"), table(spark, candidates, "record_id"), n).collect()
    assert sorted((x.anchor_id, x.record_id, round(x.sim_score, 4), x["rank"]) for x in got) == [(i, j, round(s, 4), k) for i, j, s, k in brute(anchors, candidates, n)]


@pytest.mark.parametrize("anchors, candidates", [([], [(1, [1])]), ([(1, [1])], []), ([(1, [1, 2])], [(5, [3]), (4, [])])])
def test_batch_by_tokens_on_little(spark, anchors, candidates):
    got = lookup.batch_by_tokens(table(spark, anchors, "anchor_id"), table(spark, candidates, "record_id"), 2).collect()
    assert sorted((x.anchor_id, x.record_id, x.sim_score, x["rank"]) for x in got) == brute(anchors, candidates, 2)


def test_few_pairs_are_scored(spark):
    """Common words beside rare ones, near partners for each anchor: most pairs share a token, few are scored."""
    r = random.Random(7)
    base = [[f"hot{r.randint(0, 9)}" for _ in range(3)] + [f"w{r.randint(0, 2000)}" for _ in range(7)] for _ in range(300)]
    near = [(1000 * k + i, sorted(set(b[:-1] + [f"x{k}"]))) for i, b in enumerate(base) for k in range(6)]
    to = lambda rows, key: topk._sets(spark.createDataFrame(rows, f"{key} long, tokens array<string>"), key)
    a, c = to([(i, sorted(set(b))) for i, b in enumerate(base)], "anchor_id"), to(near, "record_id")
    members = c.groupBy("set").agg(F.min("record_id").alias("least"), F.count("*").alias("many"))
    best, scored = topk.best_sets(a.select(F.col("set").alias("aset"), "tokens"), c.select("set", "tokens"), members, 5, scores.LOOKUP, 4, 0.0)
    assert best.groupBy("aset").count().filter("count = 5").count() == 300
    assert scored < 300 * len(near) / 20


def test_best_by_tokens_shuffled_against_brute_force(spark):
    r = random.Random(11)
    left, right = sets(r, 80, 200, 0, 25), sets(r, 60, 200, 0, 15)
    right += [(200 + i, right[5][1]) for i in range(3)]
    d, b = table(spark, left, "id"), table(spark, right, "other").withColumn("ord", -F.col("other"))
    got = {x.id: (x.other, round(x.score, 9), x.shared) for x in classify.best_by_tokens(d, b, max_cells=0).collect()}
    want = {}
    for i, a in left:
        best = min(((-round(scores.CLASSIFY[0] * m / (len(a) + len(c) - m) + scores.CLASSIFY[1] * m / len(a), 12), -j, j, c) for j, c in right if (m := len(set(a) & set(c)))), default=None)
        if best and -best[0] >= classify.ACCEPT:
            want[i] = (best[2], round(-best[0], 9), sorted(f"t{x}" for x in set(a) & set(best[3])))
    assert got == want and len(want) > 40


def test_lookup_scores_few_pairs_of_the_tables(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_size", text.tokens(F.col("p_name")).alias("tokens"))
    a, c = topk._sets(p.filter("p_size = 1"), "p_partkey"), topk._sets(p.filter("p_size <> 1"), "p_partkey")
    members = c.groupBy("set").agg(F.min("p_partkey").alias("least"), F.least(F.count("*"), F.lit(5)).alias("many"))
    one = lambda df, key: df.groupBy(F.col("set").alias(key)).agg(F.first("tokens").alias("tokens"))
    assert topk.best_sets(one(a, "aset"), one(c, "set"), members, 5, scores.LOOKUP, 4, 0.0)[1] < a.count() * c.count() / 10
