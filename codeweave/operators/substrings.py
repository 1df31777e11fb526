"""A stored trigram index of codes and names for substring search.

Postings (gram, record_id) lie in runs that are sorted by gram, texts sorted by record_id, so a search reads little of either (a few pages
of each run): its rarest grams are intersected, and the candidates, in order of record_id, verified on the texts of so many ids at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .graph import materialise

SIZE = 3
#: Grams of a search that are intersected, and candidates verified at a time.
RAREST, AT_ONCE = 4, 500
#: Characters that make a run of postings, and postings that leave a task at a time.
RUN_CHARS, POSTED = 1 << 22, 1 << 18


def contains_query(code: str, name: str, query: str) -> Column:
    """Whether the code or the name contains the query, ignoring case."""
    return F.contains(F.upper(text.text_or_blank(code)), F.lit(query.upper())) | F.contains(F.lower(text.text_or_blank(name)), F.lit(query.lower()))


def gram_codes(text_: str) -> np.ndarray:
    """The runs of SIZE characters as numbers, in order of appearance."""
    points = np.frombuffer(text_.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < SIZE:
        return np.zeros(0, np.int64)
    out = np.zeros(len(points) - SIZE + 1, np.int64)
    for i in range(SIZE):
        out = (out << 21) | points[i : len(points) - SIZE + 1 + i]
    return out


def gram_texts(codes: np.ndarray) -> list[str]:
    points = np.stack([codes >> 21 * i & 0x1FFFFF for i in reversed(range(SIZE))], axis=1).astype("<u4")
    all_ = points.tobytes().decode("utf-32-le")
    return [all_[i : i + SIZE] for i in range(0, len(all_), SIZE)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (record_id, province, code, name) to postings, so many characters at a time sorted by gram."""
    for whole in batches:
        sizes = np.array([len(c or "") + len(n or "") for c, n in zip(whole.column("code").to_pylist(), whole.column("name").to_pylist(), strict=True)], dtype=np.int64)
        run = (np.cumsum(sizes) - sizes) // RUN_CHARS
        for at in np.unique(run):
            here = np.flatnonzero(run == at)
            batch = whole.slice(int(here[0]), len(here))
            own = [np.unique(np.concatenate([gram_codes(c), gram_codes(n)])) for c, n in zip(batch.column("code").to_pylist(), batch.column("name").to_pylist(), strict=True)]
            gram, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            codes, place = np.unique(gram, return_inverse=True)
            by, texts = np.argsort(place, kind="stable"), pa.array(gram_texts(codes), pa.string())
            for first in range(0, len(by), POSTED):
                some = by[first : first + POSTED]
                rows = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([texts.take(pa.array(place[some])), batch.column("province").take(rows), batch.column("record_id").take(rows)], names=["gram", "province", "record_id"])


@dataclass
class SubstringIndex:
    """postings (gram, province, record_id), counts (gram, n) and texts (record_id and the records' columns), all stored."""

    postings: DataFrame
    counts: DataFrame
    texts: DataFrame

    @classmethod
    def build(cls, records: DataFrame) -> SubstringIndex:
        """From records with record_id, province, fsc_code, fsc_fn."""
        # both in the case that the search compares in; a gram of either may stand for a hit
        cased = records.select("record_id", "province", F.upper(text.text_or_blank("fsc_code")).alias("code"), F.lower(text.text_or_blank("fsc_fn")).alias("name"))
        key, province = (records.schema[c].dataType.simpleString() for c in ("record_id", "province"))
        parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # written where they are made: nothing is shuffled, and no text read twice for its ranges
        postings = materialise(cased.mapInArrow(_runs, f"gram string, province {province}, record_id {key}"), "substring-postings")
        counts = materialise(postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange(parts, "gram").sortWithinPartitions("gram"), "substring-counts")
        return cls(postings, counts, materialise(records.repartitionByRange(parts, "record_id").sortWithinPartitions("record_id"), "substring-texts"))

    def candidates(self, query: str, province: str | None = None) -> DataFrame:
        """(record_id,) of the records that hold the rarest grams of the query in its code or its name."""
        found = None
        own = self.postings if province is None else self.postings.filter(F.col("province") == province)
        for cased in (query.upper(), query.lower()):
            all_ = gram_texts(np.unique(gram_codes(cased)))
            known = {r["gram"]: r["n"] for r in self.counts.filter(F.col("gram").isin(all_)).collect()}  # a row for each gram of the query
            if len(known) < len(all_):
                continue  # some gram is nowhere
            rarest = sorted(all_, key=lambda g: (known[g], g))[:RAREST]
            hits = own.filter(F.col("gram").isin(rarest)).groupBy("record_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("record_id")
            found = hits if found is None else found.union(hits)
        return self.postings.select("record_id").limit(0) if found is None else found.distinct()

    def search(self, query: str, province: str | None = None, limit: int = 20) -> DataFrame:
        """The first `limit` records, by record_id, whose code or name contains the query, ignoring case; none for a blank query.

        Queries of fewer characters than a gram scan the texts. province: in all of them, if None.
        """
        q = query.strip()
        if not q:
            return self.texts.limit(0)
        here = self.texts if province is None else self.texts.filter(F.col("province") == province)
        hit = contains_query("fsc_code", "fsc_fn", q)
        if min(len(q.upper()), len(q.lower())) < SIZE:
            return here.filter(hit).orderBy("record_id").limit(limit)
        candidates = materialise(self.candidates(q, province), "substring-candidates")
        found: list = []
        last = None
        while len(found) < limit:
            ahead = candidates if last is None else candidates.filter(F.col("record_id") > last)
            some = [r[0] for r in ahead.orderBy("record_id").limit(AT_ONCE).collect()]
            if not some:
                break
            found += [r[0] for r in here.filter(F.col("record_id").between(some[0], some[-1]) & F.col("record_id").isin(some)).filter(hit).orderBy("record_id").limit(limit - len(found)).select("record_id").collect()]
            last = some[-1]
        return here.filter(F.col("record_id").isin(found)).orderBy("record_id") if found else self.texts.limit(0)
