import hashlib
import random
from collections import Counter

import pytest
from codeweave.llm import fingerprints as fp
from pyspark.sql import functions as F

from .helpers import documents, odd_texts


def edited(rows):
    """(doc_id, n_chars, edited text, next text) by hand; equal ids in order of Spark's hash, given as third item."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    out = []
    for i, (doc, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), text[: len(text) - half] + after[:half], text, after))
    return out


def shingles(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check(spark, rows):
    docs = documents(spark, rows).repartition(3)
    digest = {r.text: r.d for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("d")).distinct().collect()}
    want = edited([(i, t, digest[t]) for i, t in rows])
    got = fp.compare_with_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter((d, n, hashlib.sha256(e.encode()).hexdigest()) for d, n, e, _, _ in want)
    texts = {x for _, _, e, t, a in want for x in (e, t, a)}
    by_text = {r.text: r.f for r in fp.sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).join(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "doc_id").select("text", F.col("fingerprint").alias("f")).collect()}

    def like(a, b):
        a, b = ({by_text[x][i : i + 16] for i in range(0, len(by_text[x]), 16)} for x in (a, b))
        return 1.0 if a == b else len(a & b) / max(1, min(len(a), len(b)))

    assert Counter((r.doc_id, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == Counter(
        (d, hashlib.sha256(e.encode()).hexdigest(), by_text[t], by_text[e], round(like(t, e), 9), round(like(t, a), 9)) for d, _, e, t, a in want
    )
    columns = fp.compare_with_edits(docs).select("near_edited", fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("by_column")).collect()
    assert all(abs(r.near_edited - r.by_column) < 1e-12 for r in columns)
    return got


def test_against_brute_force(spark):
    check(spark, odd_texts())


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "a b c d e f g"), (None, None), (5, "x y"), (5, "x y"), (5, "x y"), (5, "other text of five words here"), (1, "é" * 7), (9, ""), (9, "")]
    got = check(spark, rows)
    assert sum(r.doc_id == 5 and r.near_next == 1 for r in got) >= 2


@pytest.mark.parametrize("rows", [[], [(3, "one two three four five six")], [(1, None)]])
def test_tiny_tables(spark, rows):
    assert len(check(spark, rows) if rows else fp.compare_with_edits(documents(spark, rows)).collect()) == len(rows)


def test_likeness_estimates_containment_of_very_unequal_documents(spark):
    r = random.Random(2)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:4000] + [f"n{i}" for i in range(1000)])), (3, " ".join(f"z{i}" for i in range(5000)))]
    s = {x.doc_id: x.fingerprint for x in fp.sketch(documents(spark, rows)).collect()}
    one = spark.createDataFrame([(s[1], s[2], s[3])], "a string, b string, c string")
    got = one.select(fp.likeness(F.col("a"), F.col("b")).alias("ab"), fp.likeness(F.col("a"), F.col("c")).alias("ac"), fp.containment(F.col("a"), F.col("b")).alias("in_b"), fp.merge(F.col("b"), F.col("c")).alias("bc")).first()
    true = len(shingles(rows[0][1]) & shingles(rows[1][1])) / len(shingles(rows[1][1]))
    assert abs(got.ab - true) < 0.05 and got.ac == 0 and got.in_b < 0.1
    assert abs(len(s[1]) / 16 / len(shingles(rows[0][1])) - 1 / fp.SCALE) < 0.02
    both = {s[2][i : i + 16] for i in range(0, len(s[2]), 16)} | {s[3][i : i + 16] for i in range(0, len(s[3]), 16)}
    assert got.bc == "".join(sorted(both))


def test_a_text_without_a_low_hash_keeps_its_least(spark):
    docs = documents(spark, [(i, f"word{i}") for i in range(40)])
    s = [r.fingerprint for r in fp.sketch(docs, scale=1000).collect()]
    assert all(len(x) == 16 for x in s) and len(set(s)) == 40
    low, high = f"{0:016x}", "f" * 16
    one = spark.createDataFrame([(low, high, "")], "a string, b string, c string")
    assert one.select(fp.merge(F.col("a"), F.col("b")).alias("m"), fp.merge(F.col("b"), F.col("c")).alias("k")).first() == (low, high)


def test_half_edits_are_nearer_than_the_next_document(spark):
    r = random.Random(4)
    docs = documents(spark, [(i, " ".join(f"w{r.randint(0, 5000)}" for _ in range(r.randint(60, 400)))) for i in range(200)])
    rows = fp.compare_with_edits(docs).collect()
    assert sum(x.near_edited > x.near_next for x in rows) >= 198
    assert abs(sum(x.near_edited for x in rows) / 200 - 0.49) < 0.05
