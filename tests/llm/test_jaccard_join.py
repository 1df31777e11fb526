import re
from collections import Counter, defaultdict

import numpy as np
from codeweave.llm import jaccard_join as J

from .helpers import documents, odd_texts


def brute(rows, k=5, t=0.8):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    texts = defaultdict(list)
    for i, x in rows:
        texts[x or ""].append(i)
    root, links = {i: i for i, _ in rows}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    same = {i: x or "" for i, x in rows}
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if same[ids[a]] == same[ids[b]] or (x and y and len(x & y) >= t * len(x | y) - 1e-9):
                links[ids[a]] += 1
                links[ids[b]] += 1
                ra, rb = find(ids[a]), find(ids[b])
                root[max(ra, rb)] = min(ra, rb)
    return {i: (find(i), links[i], len(texts[same[i]])) for i in ids}


def near_copies(n):
    r = np.random.default_rng(2)
    base = [f"v{i}" for i in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for at in r.choice(150, size=r.integers(0, 9), replace=False):
            w[at] = f"n{r.integers(10**9)}"
        out.append((1000 + i, " ".join(w[r.integers(0, 4) :])))
    return out


def test_against_brute_force(spark):
    rows = odd_texts() + near_copies(150)
    for block, small in ((128, 128), (16, 20)):
        got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.join_near_duplicates(documents(spark, rows).repartition(3), block=block, small=small).collect()}
        assert got == brute(rows)


def near(text):
    """The text with its last word changed."""
    return " ".join([*text.split()[:-1], "changed"])


def test_one_doc_id_with_two_texts(spark):
    """Rows (1, A), (1, B), (2, A'), (3, B'): no text hides the other's links, in any partitioning."""
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, a), (4, "alone")]
    for parts in (4,):
        got = sorted((r.doc_id or -1, r.class_id, r.n_links, r.n_copies) for r in J.join_near_duplicates(documents(spark, rows).repartition(parts)).collect())
        assert got == [(-1, None, 0, 1), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (4, 4, 0, 1)]
        kept = sorted((r.doc_id or -1, r.text) for r in J.keep_first_of_class(documents(spark, rows).repartition(parts)).collect())
        assert kept == [(-1, a), (1, a), (1, b), (4, "alone")]


def test_one_doc_id_whose_texts_are_near(spark):
    a = " ".join(f"a{i}" for i in range(80))
    rows = [(5, a), (5, near(a)), (7, a), (5, a)]
    assert {(r.doc_id, r.class_id, r.n_links) for r in J.join_near_duplicates(documents(spark, rows)).collect()} == {(5, 5, 3), (7, 5, 3)}
    assert J.keep_first_of_class(documents(spark, rows).repartition(4)).count() == 1


def components(spark, rows):
    docs = documents(spark, rows).withColumn("node", J.text_digest(J.F.col("text"))).select("doc_id", "node", "text")
    nodes = docs.mapInArrow(J._signature_batches(5), "doc_id long, node long, n long, minima binary").withColumnRenamed("doc_id", "first_id")
    assert nodes.mapInArrow(J._band_batches, "band long, node long").groupBy("band").count().filter(f"count > {J.SMALL}").count() > 0
    return J._candidate_components(docs, nodes, J.SHINGLE, J.THRESHOLD, J.least_matches(), J.SMALL)[0]


def test_weak_similarity_does_not_chain(spark):
    """6,000 texts with 40 common and 20 own words, no pair linked: many share a band, none ends in a large component."""
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"t{i}_{j}" for j in range(20)])) for i in range(6000)]
    assert components(spark, rows).groupBy("comp").count().filter(f"count > {J.SMALL}").count() == 0


def test_links_within_boilerplate_are_found(spark):
    """Of texts that share two thirds of their words, every tenth has near copies: their links, and no others."""
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(400):
        own = [f"t{i}_{j}" for j in range(20)]
        rows.append((10 * i, " ".join(common + own)))
        if i % 10 == 0:
            rows += [(10 * i + k, " ".join(common + own[:-1] + [f"end{k}"])) for k in (1, 2)]
    comp = components(spark, rows)
    assert comp.groupBy("comp").count().agg(J.F.max("count")).first()[0] <= 3
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.join_near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_large_clusters_of_near_copies(spark):
    """More copies than a block or bucket holds, and boilerplate beside them: minima meet before the shingle sets do."""
    common = [f"c{i}" for i in range(60)]
    rows = near_copies(330) + [(i, " ".join(common + [f"t{i}_{j}" for j in range(30)])) for i in range(300)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in J.join_near_duplicates(documents(spark, rows).repartition(3)).collect()}
    assert got == brute(rows)


def test_bayes_pruning_keeps_what_can_reach_the_threshold():
    least = J.least_matches()
    r = np.random.default_rng(0)
    for n, m in least.items():
        assert m < 0.8 * n
        assert (r.binomial(n, 0.8, 20_000) < m).mean() < 1e-3


def test_first_of_class(spark):
    docs = documents(spark, [(5, "a b c d e f"), (2, "a b c d e f"), (9, "other words here"), (None, "a b c d e f"), (7, None), (8, "")])
    kept = J.keep_first_of_class(docs)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 7, 9] and kept.columns == docs.columns
    assert J.join_near_duplicates(documents(spark, [])).count() == 0
