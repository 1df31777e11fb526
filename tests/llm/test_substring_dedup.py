import hashlib
import re

import pytest
from codeweave.llm import substring_dedup as S

from .helpers import documents, odd_texts


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        keep = [True] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                keep[s : s + length] = [False] * length
            seen.add(k)
        kept = [x for x, y in zip(w, keep) if y]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("length,seed", [(20, 5), (6, 3), (5, 5)])
def test_against_brute_force(spark, length, seed):
    rows = odd_texts()
    found = S.dedup_substrings(documents(spark, rows).repartition(5), length, seed).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows, length)
    assert sum(r.n_removed for r in found) > 0


def test_many_contexts_of_one_phrase(spark):
    """One short phrase in every document with other words around it, and passages cut at different places."""
    phrase = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} " + " ".join(phrase.split()[i % 40 : i % 40 + 8 + i % 25]) + f" c{i} d{i}") for i in range(300)]
    found = S.dedup_substrings(documents(spark, rows).repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows, 20)


def test_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = S.dedup_substrings(documents(spark, [(None, text), (None, text), (3, text), (4, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (-1, 0), (3, 0), (4, 30)]
    assert S.dedup_substrings(documents(spark, [])).count() == 0


def test_cut_repeats_keeps_rows_and_columns(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [(1, f"one\n{passage}  two"), (2, f"three {passage} four"), (3, passage), (4, "left   as it\tis"), (5, None)])
    got = {r.doc_id: r for r in S.cut_repeats(docs).collect()}
    assert got[1].text == f"one\n{passage}  two" and got[2].text == "three four" and got[2].n_chars == 10
    assert 3 not in got and got[4].text == "left   as it\tis" and got[5].text is None
    assert S.cut_repeats(docs).columns == docs.columns and got[2].runs == "r" and got[2]._doc == 9


@pytest.mark.parametrize("parts", [1, 4])
def test_doubled_rows_keep_their_words(spark, parts):
    """Equal rows of one doc_id, in one batch or in several: as if each were there once."""
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"a {passage} b"), (2, " ".join(f"v{i}" for i in range(40))), (3, f"c d {passage} e {passage[:-4]} f"), (4, " ".join(f"u{i}" for i in range(25)) + " x " + " ".join(f"u{i}" for i in range(25)))]
    docs = documents(spark, rows * 3).repartition(parts)
    if parts > 1:
        docs = documents(spark, rows).coalesce(1)
        docs = docs.union(docs).union(docs)
    want = brute(rows, 20)
    found = S.dedup_substrings(docs).collect()
    assert len(found) == 12 and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in found)
    assert S.cut_repeats(docs).filter("doc_id = 2").count() == 3


def test_cut_repeats_beside_any_names(spark):
    """Columns named like the internal ones stay as they are."""
    passage = " ".join(f"w{i}" for i in range(30))
    docs = documents(spark, [(1, f"a {passage}"), (2, f"b {passage}")])
    names = ["_runs", "_RUNS_", "_doc_", "lo", "n", "w", "a", "first", "content", "many", "kept_text", "n_removed"]
    docs = docs.selectExpr("*", *[f"'{i}' as `{c}`" for i, c in enumerate(names)])
    got = {r.doc_id: r for r in S.cut_repeats(docs).collect()}
    assert got[2].text == "b" and S.cut_repeats(docs).columns == docs.columns
    assert all(got[k][c] == str(i) for k in (1, 2) for i, c in enumerate(names))
