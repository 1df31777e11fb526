import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from codeweave.llm import collocations as co
from codeweave.llm.transducers import CountTransducer

from .helpers import SCHEMA, odd_texts

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, covered=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(UPPER)):
            ws = re.findall("[^ \t]+", piece)
            totals[lang] += len(ws)
            for k in range(1, 5):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s1", 0, "r", 7, 8, 9, "g", "k") for i, (lang, t) in enumerate(rows)], SCHEMA)


def some_rows(seed=1, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "ÑU", "日本", "A b", "don't"]
    fixed = ["the Quick brown fox", "new york city hall", "in spite of"]
    text = lambda: "".join((r.choice(fixed) if r.random() < 0.1 else r.choice(words)) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ; "]) for _ in range(r.randint(0, 40)))
    return [(r.choice(["en", "en", "en", "fr", None, "und", ""]), text()) for _ in range(n)]


@pytest.mark.parametrize("least, top", [(3, 2000), (8, 12), (5, 40)])
def test_against_brute_force(spark, monkeypatch, least, top):
    """Small runs and ranges, so that there are many of both."""
    rows = some_rows(least) + [(None, None), ("en", ""), ("fr", " .. "), ("en", "x " * 400)] + [("en", "one hot passage of words")] * 150
    got = co.mine(table(spark, rows).repartition(5), least=least, top=top, range_words=200).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute(rows, least, top=top)
    assert len(got) > 10


def test_long_and_odd_texts(spark):
    rows = [("en", t) for _, t in odd_texts()]
    got = co.mine(table(spark, rows), least=20).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute(rows, 20)


@pytest.mark.parametrize("rows", [[], [("en", "a few rare words")], [(None, None)]])
def test_nothing_frequent(spark, rows):
    assert co.mine(table(spark, rows)).collect() == []


def test_runs_end_between_texts(monkeypatch):
    """What a task's runs count is what one run counts."""
    import pyarrow as pa

    class Everything:
        value = type("F", (), {"has": staticmethod(lambda keys: np.ones(len(keys), bool))})

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array([f"a b c{i % 3} d" for i in range(50)])], names=["lang", "text"])
    monkeypatch.setattr("codeweave.llm.common.SLICE_BYTES", 64)
    found = []
    for words in (20, 10**6):
        monkeypatch.setattr(co, "RUN_WORDS", words)
        parts = [CountTransducer.from_bytes(x.as_py()) for b in co._shard_batches(Everything, {"en": 3}, 3, 4)(iter([batch])) for x in b.column("fst")]
        rows, counts = CountTransducer.union(parts).paths()
        found.append(dict(zip(map(bytes, rows), counts.tolist(), strict=True)))
    assert found[0] == found[1] and sum(found[0].values()) == 150


def test_exact_scores_past_64_bits():
    a = np.array([5, (1 << 61) + 3], dtype=np.int64)
    both = np.array([13, (1 << 62) + 9], dtype=np.int64)
    assert co.exact_scores(a, both).tolist() == [int(x) * 2_000_000 // int(y) for x, y in zip(a, both, strict=True)]


def sequences(seed, n, alphabet=6, width=4):
    r = np.random.default_rng(seed)
    rows = r.integers(1, alphabet, (n, width)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows[np.arange(width)[None, :] >= r.integers(1, width + 1, n)[:, None]] = 0
    rows = np.unique(rows, axis=0)
    return rows, r.integers(1, 4, len(rows))


def as_dict(rows, weights):
    return dict(zip(map(bytes, np.ascontiguousarray(rows)), weights.tolist(), strict=True))


def test_transducer_round_trip_union_and_composition():
    (a, wa), (b, wb) = sequences(1, 400), sequences(2, 300)
    ta, tb = CountTransducer.build(a, wa), CountTransducer.build(b, wb)
    da, db = as_dict(a, wa), as_dict(b, wb)
    assert as_dict(*ta.paths()) == da
    assert as_dict(*CountTransducer.from_bytes(ta.to_bytes()).paths()) == da
    assert as_dict(*CountTransducer.union([ta, tb]).paths()) == {k: da.get(k, 0) + db.get(k, 0) for k in da | db}
    assert as_dict(*CountTransducer.union([ta, tb], np.maximum, 3).paths()) == {k: m for k in da | db if (m := max(da.get(k, 0), db.get(k, 0))) >= 3}
    rows, x, y = ta.compose(tb)
    assert as_dict(rows, x) == {k: da[k] for k in da.keys() & db} and as_dict(rows, y) == {k: db[k] for k in da.keys() & db}
    assert ta.counts_of(b).tolist() == [da.get(bytes(k), 0) for k in b]


def test_transducer_shares_equal_ends():
    labels = np.arange(1, 51, dtype=np.uint64)
    rows = np.array([(a, b, 7, 8) for a in labels for b in labels], dtype=np.uint64)
    t = CountTransducer.build(rows, np.ones(len(rows), np.int64))
    assert len(t.label) == 50 + 50 + 1 + 1 and len(t.first) - 1 == 4


def test_empty_transducer():
    none = CountTransducer.build(np.zeros((0, 3), np.uint64), np.zeros(0, np.int64))
    some = CountTransducer.build(*sequences(3, 20, width=3))
    assert len(none.paths()[0]) == len(none.compose(some)[0]) == len(some.compose(none)[0]) == 0
    assert none.counts_of(np.ones((2, 3), np.uint64)).tolist() == [0, 0]
    assert len(CountTransducer.union([]).paths()[0]) == 0 and len(CountTransducer.from_bytes(none.to_bytes()).paths()[0]) == 0
