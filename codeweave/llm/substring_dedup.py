"""Substring dedup by seed and extend: winnowed anchors are joined, and repeats are followed outwards from them.

A window is `length` consecutive words of one document. It is a repeat if its word sequence also starts earlier
(smaller doc_id, or same document and earlier start); every word of a repeat is removed.

Seed. Each window picks, among the `seed`-word grams it holds, the one of least fingerprint (winnowing). The pick
depends on the window's words alone, so equal windows have equal anchors at equal offsets. Consecutive windows
with the same anchor occurrence form a run. A run's row carries its anchor's and its whole content's fingerprints.

Extend. Rows meet by anchor. Where one anchor has one content only, the whole run extends to a match: all but the
first are repeats, and nothing else is to be looked at. Where it has several contents, the match with another
occurrence ends somewhere inside the run: the first row of each content goes on to be compared window by window,
by 128 bits of fingerprint. Each step keeps the least doc_id per key, so no pairs are made.

Skew. A mapper sends one row for each content of an anchor it has seen, knows later copies to be repeats at once,
and sends one row only for an anchor with several contents; what needs no meeting travels under a key of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, first_of_key, hash_runs, materialise, mix, unused, words_of

LENGTH, SEED = 20, 5
#: Kinds of rows: to meet by anchor; known repeat; to be compared by windows.
MEET, REPEAT, COMPARE = 0, 1, 2
RUNS = "kind int, k long, content long, doc_id long, lo int, n int, many boolean"
WINDOWS = "repeat boolean, w long, a long, doc_id long, lo int"


def _runs(w: Words, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window start, number of windows, anchor, content) of each run."""
    n, none = len(w.hashes), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U64), none.astype(U64)
    at = np.arange(n - seed + 1)
    grams = hash_runs(w.hashes, at, at + seed)
    span = length - seed + 1
    best, size = grams.copy(), 1  # least of grams[i : i + size], doubling
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    starts = n - length + 1
    best = np.minimum(best[:starts], best[span - size : span - size + starts])
    # the anchor's place: the last equal to the least, found from gram places that end windows
    inside = w.text[:starts] == w.text[length - 1 :]
    place = np.full(starts, -1, dtype=np.int64)
    todo = np.flatnonzero(inside)
    for back in range(span):
        if not len(todo):
            break
        hit = grams[todo + back] == best[todo]
        place[todo[hit]] = todo[hit] + back
        todo = todo[~hit]
    starts_at = np.flatnonzero(inside)
    if not len(starts_at):
        return none, none, none, none.astype(U64), none.astype(U64)
    p = place[starts_at]
    new = np.ones(len(starts_at), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (starts_at[1:] != starts_at[:-1] + 1)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(starts_at)))
    lo = starts_at[first]
    content = hash_runs(w.hashes, lo, lo + many + length - 1)
    return w.text[lo], lo - w.bounds[w.text[lo]], many, grams[p[first]], content


def _seed_batches(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for first, _, w in words_of(batch.column("text")):
                text, lo, n, anchor, content = _runs(w, length, seed)
                parts.append((ids[first + text], lo, n, anchor, content))
            if parts:
                yield from _seed_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _seed_rows(doc, lo, n, anchor, content) -> Iterator[pa.RecordBatch]:
    order, new = first_of_key(anchor, content, doc, lo)
    order = order[new]  # equal rows of one doc_id start at the same place: neither is the other's repeat
    doc, lo, n, anchor, content = (x[order] for x in (doc, lo, n, anchor, content))
    if not len(doc):
        return
    new_anchor, new_content = np.ones(len(doc), bool), np.ones(len(doc), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_content[1:] = new_anchor[1:] | (content[1:] != content[:-1])
    kinds = np.cumsum(new_anchor) - 1
    several = (np.bincount(kinds, weights=new_content) > 1)[kinds]
    kind = np.where(~new_content, REPEAT, np.where(several, COMPARE, MEET))
    own = mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + lo.astype(U64))  # where nothing is to be met
    key = np.where(kind == MEET, anchor, own)
    tell = np.flatnonzero(several & new_anchor)  # one row tells the others that the anchor has several contents
    both = lambda x, y: np.concatenate([x, y])
    columns = (
        both(kind, np.full(len(tell), MEET)).astype(np.int32), both(key, anchor[tell]).view(np.int64), both(content, content[tell]).view(np.int64),
        both(doc, doc[tell]), both(lo, lo[tell]).astype(np.int32), both(n, n[tell]).astype(np.int32), both(np.zeros(len(doc), bool), np.ones(len(tell), bool)),
    )
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], names=["kind", "k", "content", "doc_id", "lo", "n", "many"])


def _window_batches(length: int, seed: int):
    """The windows of the runs in `runs` (lo * 64 + n); the first of each in a batch, the rest as repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            runs = batch.column("runs")
            codes, ends = runs.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.array(pa.compute.list_value_length(runs).to_pylist(), dtype=np.int64))
            begins, parts = np.concatenate([[0], ends[:-1]]), []
            for first, end, w in words_of(batch.column("text")):
                for i in range(first, end):
                    own = codes[begins[i] : ends[i]]
                    lo, n = own >> 6, own & 63
                    starts = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    parts.append((np.full(len(starts), i), starts, starts + w.bounds[i - first], None))
                if parts:
                    text, rel, at = (np.concatenate([p[j] for p in parts]) for j in range(3))
                    h = w.hashes
                    key = hash_runs(h, at, at + length)
                    other = hash_runs(mix(h + U64(0x51ED270B)), at, at + length)
                    parts = []
                    yield from _window_rows(key, other, ids[text], rel)

    return run


def _window_rows(key, other, doc, lo) -> Iterator[pa.RecordBatch]:
    order, new = first_of_key(key, other, doc, lo)
    order = order[new]
    key, other, doc, lo = (x[order] for x in (key, other, doc, lo))
    repeat = np.zeros(len(key), bool)
    repeat[1:] = (key[1:] == key[:-1]) & (other[1:] == other[:-1])
    own = mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) + lo.astype(U64))
    columns = (repeat, np.where(repeat, own, key).view(np.int64), other.view(np.int64), doc, lo.astype(np.int32))
    for at in range(0, len(key), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], names=["repeat", "w", "a", "doc_id", "lo"])


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, lo, n): the windows that start at words lo .. lo + n - 1 of the document are repeats."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows = docs.mapInArrow(_seed_batches(length, seed), RUNS)
    met = rows.selectExpr(
        "kind", "doc_id", "lo", "n", "many", "min(doc_id) over (partition by k, content) as first",
        "(min(content) over (partition by k)) <> (max(content) over (partition by k)) or max(many) over (partition by k) as several",
    )
    met = met.filter(f"kind = {REPEAT} or (kind = {COMPARE}) or (not many and (doc_id > first or several))")
    met = met.selectExpr(f"kind = {REPEAT} or (kind = {MEET} and doc_id > first) as repeat", "doc_id", "lo", "n")
    met = materialise(met, "substring-runs")
    compare = met.filter("not repeat").groupBy("doc_id").agg(F.collect_set(F.expr("cast(lo as long) * 64 + n")).alias("runs"))
    windows = docs.join(compare, "doc_id").mapInArrow(_window_batches(length, seed), WINDOWS)
    windows = windows.selectExpr("repeat", "doc_id", "lo", "min(doc_id) over (partition by w, a) as first").filter("repeat or doc_id > first")
    return met.filter("repeat").select("doc_id", "lo", "n").union(windows.selectExpr("doc_id", "lo", "1"))


def _removal_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            codes = runs.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([x or 0 for x in pa.compute.list_value_length(runs).to_pylist()], dtype=np.int64)
            ends = np.cumsum(sizes)
            total, removed, digest, kept_text = [], [], [], []
            for first, end, w in words_of(batch.column("text")):
                for i in range(first, end):
                    a, b = w.bounds[i - first], w.bounds[i - first + 1]
                    own = codes[ends[i] - sizes[i] : ends[i]]
                    depth = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(depth, own >> 6, 1)
                    np.add.at(depth, np.minimum((own >> 6) + (own & 63) + length - 1, b - a), -1)
                    keep = np.cumsum(depth[:-1]) == 0
                    raw = w.data[w.offsets[i - first] : w.offsets[i - first + 1]].tobytes()
                    text = b" ".join(np.array(raw.split(), dtype=object)[keep]) if len(own) else b" ".join(raw.split())
                    total.append(b - a)
                    removed.append(int((~keep).sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept_text.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, kept_text (the kept words joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words: zero counts and the digest of nothing. Rows
    with a null doc_id are neither judged nor matched, and come back whole. Equal rows of one doc_id are judged alike, in any
    partitioning: none is earlier than the other, so each keeps what a single row would. Rows of one doc_id with different
    texts count as one document whose windows repeat where either text's do. Other columns of docs are ignored. An empty table gives no rows.
    """
    if not seed <= length <= 50:
        raise ValueError("seed <= length <= 50")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = repeated_windows(docs, length, seed).groupBy("doc_id").agg(F.collect_set(F.expr("cast(lo as long) * 64 + n")).alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    return docs.join(marks, "doc_id", "left").mapInArrow(_removal_batches(length), schema)


def cut_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, without the words of repeated windows.

    A row with nothing to cut stays as it is. Where words go, text is the kept words joined by one space, and n_chars, if there
    is such a column, its length. A row that loses all its words goes. The text is shuffled with its row, not joined anew.
    """
    key = unused(docs, "_doc")
    marks = repeated_windows(docs, length, seed).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.expr("cast(lo as long) * 64 + n")).alias(unused(docs, "_runs")))
    both = docs.join(marks, docs["doc_id"].cast("long") == marks[key], "left").drop(marks[key])  # the runs come last
    schema = docs.schema
    counted = "n_chars" in schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _removal_batches(length)
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column(batch.num_columns - 1)], names=["doc_id", "text", "runs"])
            verdict = next(judge(iter([narrow])))
            cut = pa.compute.greater(verdict.column("n_removed"), 0)
            text = pa.compute.if_else(cut, verdict.column("kept_text").cast(batch.column("text").type), batch.column("text"))
            columns = {f.name: batch.column(i) for i, f in enumerate(list(batch.schema)[:-1])} | {"text": text}
            if counted:
                length_now = pa.compute.utf8_length(text).cast(columns["n_chars"].type)
                columns["n_chars"] = pa.compute.if_else(cut, length_now, columns["n_chars"])
            stays = pa.compute.or_(pa.compute.invert(cut), pa.compute.greater(verdict.column("n_words"), verdict.column("n_removed")))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(stays)

    return both.mapInArrow(run, schema)
