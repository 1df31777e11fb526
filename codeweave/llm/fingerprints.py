"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range is retained.

A sketch grows with its document, and two sketches keep or drop a shingle alike, so the share of one in the other estimates
containment however unequal the documents are, and the sketch of a union is the union of sketches (merge). Shingles are
`shingle` consecutive blank-separated words (all words, if fewer); their 64-bit fingerprints below 2**64 / scale are kept. A text
with words none of whose hashes lies below keeps its least one, which is recognised by lying above and gives way in a merge.

A fingerprint is a string: 16 hexadecimal digits for each hash, ascending. Null and blank texts have the empty one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, words_of
from .jaccard_join import _shingles

SHINGLE, SCALE = 5, 4
DIGITS = 16
#: Ranges of documents in order, for each task that works on some.
RANGES_A_TASK = 4


def _sketches(texts: pa.Array, shingle: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the kept hashes, both ascending, each once."""
    limit = U64(((1 << 64) - 1) // scale)
    texts_, prints_ = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for first, end, w in words_of(texts):
        text, prints = _shingles(w, shingle)
        if not len(text):
            continue
        kept = prints <= limit
        heads = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        none = np.bincount(text[kept], minlength=end - first)[text[heads]] == 0
        least = np.minimum.reduceat(prints, heads)[none]
        text, prints = np.append(text[kept], text[heads][none]), np.append(prints[kept], least)
        order = np.lexsort((prints, text))
        text, prints = text[order], prints[order]
        once = np.append(True, (text[1:] != text[:-1]) | (prints[1:] != prints[:-1]))
        texts_.append(first + text[once])
        prints_.append(prints[once])
    return np.concatenate(texts_), np.concatenate(prints_)


def _spelt(text: np.ndarray, prints: np.ndarray, n: int) -> list[str]:
    """The fingerprints of n texts."""
    digits = prints.astype(">u8").tobytes().hex()
    cuts = np.searchsorted(text, np.arange(n + 1)) * DIGITS
    return [digits[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """likeness() of the sketches of equal number, for numbers under n."""
    keys = [mix(prints + mix(text.astype(U64))) for text, prints in (a, b)]
    _, at, _ = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    shared, sizes = np.bincount(a[0][at], minlength=n)[:n], [np.bincount(x[0], minlength=n)[:n] for x in (a, b)]
    return np.where(np.maximum(*sizes) == 0, 1.0, shared / np.maximum(np.minimum(*sizes), 1))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[str]:
    """The fingerprint of each text."""
    return _spelt(*_sketches(texts, shingle, scale), len(texts))


def hashes(fingerprint: Column) -> Column:
    """The hashes of a fingerprint as an array of strings."""
    return F.regexp_extract_all(fingerprint, F.lit(f".{{{DIGITS}}}"), F.lit(0))


def containment(part: Column, whole: Column) -> Column:
    """The share of the shingles of `part` that `whole` has too, estimated from their fingerprints; 1 if equal."""
    size = F.greatest(F.length(part) / DIGITS, F.lit(1.0))
    return F.when(part == whole, 1.0).otherwise(F.size(F.array_intersect(hashes(part), hashes(whole))) / size)


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller of two fingerprints in the larger: 1 for equal ones, 0 where just one is empty."""
    return F.when(F.length(a) <= F.length(b), containment(a, b)).otherwise(containment(b, a))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The fingerprint of two documents' shingles together."""
    both = F.array_sort(F.array_union(hashes(a), hashes(b)))
    below = F.filter(both, lambda h: h <= F.lit(f"{((1 << 64) - 1) // scale:0{DIGITS}x}"))
    return F.array_join(F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1)), "")


def _fingerprint_batches(shingle: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), shingle, scale), pa.string())], names=["doc_id", "fingerprint"])

    return run


def sketch(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, fingerprint of each row of docs, where it lies; repeated rows and null ids too."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches(shingle, scale), "doc_id long, fingerprint string")


def _ranged_batches(shared):
    """Each row with the number of its range; a range's first row also goes to the range before it, as its end (the first of all to the last).

    Rows of a batch that are equal travel once, with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: list[tuple] = shared.value
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("late", "doc_id", "digest")], strict=True))
            row_of: dict[tuple, int] = {}
            copies: dict[tuple, int] = {}
            for i, key in enumerate(keys):
                row_of.setdefault(key, i)
                copies[key] = copies.get(key, 0) + 1
            rows = []
            for key, i in row_of.items():
                at = bisect.bisect_right(heads, (key[0], key[1] or 0, key[2])) - 1
                rows.append((i, at, False, copies[key]))
                if heads[at] == (key[0], key[1] or 0, key[2]):
                    rows.append((i, (at - 1) % len(heads), True, 1))
            index, part, end, many = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = {c: batch.column(c).take(pa.array(index, pa.int64())) for c in batch.schema.names}
            columns |= {"part": pa.array(part, pa.int32()), "is_end": pa.array(end, pa.bool_()), "copies": pa.array(many, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _neighbour_batches(shingle: int, scale: int):
    """Rows in order, a range's end last, to one result row each: the row behind is the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "is_end", "copies")], strict=True))
            held = rows[-1:]
            if len(rows) < 2:
                continue
            own = _sketches(pa.array([r[1] for r in rows], pa.string()), shingle, scale)
            spelt = _spelt(*own, len(rows))
            behind = _likeness(own, (own[0][own[0] > 0] - 1, own[1][own[0] > 0]), len(rows) - 1)
            at, edited, near_next, copies = [], [], [], []
            for i, (_, text, _, is_end, many) in enumerate(rows[:-1]):
                # all but the last of equal rows are followed by their like
                for n, following, near in ((many - 1, text, 1.0), (1, rows[i + 1][1], behind[i])):
                    if n and not is_end:
                        half = len(text) // 2
                        at.append(i)
                        edited.append(text[: len(text) - half] + following[:half])
                        near_next.append(near)
                        copies.append(n)
            changed = _sketches(pa.array(edited, pa.string()), shingle, scale)
            bounds = np.searchsorted(own[0], np.arange(len(rows) + 1))
            many = np.diff(bounds)[at] if at else np.zeros(0, np.int64)
            mine = np.repeat(bounds[at] - np.cumsum(many) + many, many) + np.arange(many.sum()) if at else np.zeros(0, np.int64)
            columns = {
                "doc_id": pa.array([rows[i][0] for i in at], pa.int64()), "n_chars": pa.array([len(rows[i][1]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), "fingerprint": pa.array([spelt[i] for i in at], pa.string()),
                "edited_fingerprint": pa.array(_spelt(*changed, len(at)), pa.string()), "near_edited": pa.array(_likeness((np.repeat(np.arange(len(at)), many), own[1][mine]), changed, len(at))),
                "near_next": pa.array(near_next, pa.float64()), "copies": pa.array(copies, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def compare_with_edits(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text of n characters is the text whose last n // 2 are replaced by the first as many (or all) of the next document's.
    Documents are in ascending order of doc_id, those without one last, rows of one doc_id by a hash of their text; after the
    last comes the first. Null texts count as empty. Repeated rows give a row each, and follow one another. near_*: likeness of
    the fingerprints. A table of one row is its own next; an empty table gives no rows; other columns are ignored.

    Texts are shuffled once, dealt to ranges of that order; only the ranges' first keys are gathered, some for each task.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").isNull().alias("late"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    order = ["late", "doc_id", "digest"]
    ranges = rows.select(*order).repartitionByRange(tasks * RANGES_A_TASK, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*order)).alias("head"))
    # any keys that occur may be heads, if the first of all is among them
    heads = sorted({(r["head"]["late"], r["head"]["doc_id"] or 0, r["head"]["digest"]) for r in ranges.collect()})
    shared = spark.sparkContext.broadcast(heads)
    dealt = rows.mapInArrow(_ranged_batches(shared), "late boolean, doc_id long, digest long, text string, part int, is_end boolean, copies long")
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", "is_end", *order)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    found = dealt.select("doc_id", "text", "part", "is_end", "copies").mapInArrow(_neighbour_batches(shingle, scale), schema)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
