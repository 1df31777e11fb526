import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from codeweave.llm import sharding as S

from .helpers import documents, odd_texts


def check(rows, got, shards):
    by = Counter(i for i, _ in rows)
    assert Counter(r.doc_id for r in got) == by
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_with_a_hot_group(spark):
    r = np.random.default_rng(3)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else " ".join(f"w{x}" for x in r.integers(0, 999, r.integers(1, 80)))) for i in range(12_000)]
    got = S.assign(documents(spark, rows).repartition(5)).collect()
    check(rows, got, 24)
    texts = dict(rows)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    for field in ("size", "n_tokens"):
        sums = Counter()
        for r in got:
            sums[r.shard] += r[field]
        assert max(sums.values()) < 1.03 * min(sums.values()), field
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) < 1.05 * min(counts.values())


def whole_groups(got):
    where = defaultdict(set)
    for r in got:
        where[(r.text_crc32, r.size)].add(r.shard)
    return all(len(s) == 1 for s in where.values())


def test_groups_stay_together_unless_too_large(spark):
    rows = [(i, f"text number {i % 4000}") for i in range(8000)]
    assert whole_groups(S.assign(documents(spark, rows)).collect())
    # groups of a hundredth of all rows, a quarter of a shard
    rows = [(i, f"text number {i % 100 if i % 2 else i}" * (i % 7 * (1 - i % 2) + 1)) for i in range(10_000)]
    assert whole_groups(S.assign(documents(spark, rows)).collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_tables(spark, sf):
    """No group is split, and sizes lie within three hundredths unless single texts outweigh that."""
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    got = S.assign(docs).collect()
    check([(r.doc_id, None) for r in docs.select("doc_id").collect()], got, 24)
    assert whole_groups(got)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) <= 1.03 * min(sums.values())


def test_even_out_against_all_moves():
    """One step makes the best of all single moves and swaps between the fullest and the emptiest shard."""
    r = np.random.default_rng(7)
    for _ in range(20):
        loads = np.stack([r.integers(1, 50, 14), np.ones(14), np.ones(14)], axis=1).astype(float) * [1, 0, 0]
        where = r.integers(0, 3, 14)
        sums = lambda w: np.bincount(w, weights=loads[:, 0], minlength=3)
        full, free = int(np.argmax(sums(where))), int(np.argmin(sums(where)))
        best = sums(where)[full] - sums(where)[free]
        for i in np.flatnonzero(where == full):
            for j in [None, *np.flatnonzero(where == free)]:
                w = where.copy()
                w[i] = free
                if j is not None:
                    w[j] = full
                best = min(best, abs(sums(w)[full] - sums(w)[free]))
        w = S.even_out(loads, where, 3, most=1)
        assert abs(abs(sums(w)[full] - sums(w)[free]) - best) < 1e-9


def test_odd_rows(spark):
    rows = odd_texts() + [(None, "a"), (None, None), (1, "again"), (1, "again")]
    check(rows, S.assign(documents(spark, rows)).collect(), 24)
    assert S.assign(documents(spark, [])).count() == 0
    one = S.assign(documents(spark, [(1, None)])).first()
    assert (one.size, one.text_crc32, one.slot) == (8, 0, 0)


def test_place_prefers_what_is_left():
    loads = np.array([[4.0, 1], [1, 4], [4, 1], [1, 4]])
    where = S.place(loads, 2)
    sums = np.array([loads[where == s].sum(axis=0) for s in range(2)])
    assert (sums == 5).all()


def test_cells_numbered_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "SALT_ROWS", 3)
    rows = odd_texts() + [(1000 + i, "one hot text") for i in range(200)]
    check(rows, S.assign(documents(spark, rows).repartition(3), shards=4).collect(), 4)
