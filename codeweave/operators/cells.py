"""Exact nearest vectors that skip: a coarse partition whose cells drop out by a bound on the inner product.

A cell is a ball: no vector in it has an inner product with q above q . centre + |q| radius. An anchor first visits the cells with the
largest q . centre until they hold n vectors, which bounds its n-th best score from below; then only the cells whose bound reaches
that. Cells are worked on in blocks of bounded size, so a cell with most of the vectors is many groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialise

#: Cells at most (a cell for each CELL_ROWS vectors), vectors that centres are drawn from, rounds of moving them.
CELLS, CELL_ROWS, SAMPLE_ROWS, ROUNDS = 1024, 256, 20_000, 4
#: Vectors of a cell, and anchors, that meet in a group.
BLOCK = 4096
#: Relative allowance for rounding in bounds.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, embedding); single precision travels as it is, at half the bytes, and is widened where it is computed with."""
    single = df.schema["embedding"].dataType.simpleString() == "array<float>"
    return df.select(key, F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.einsum("ij,ij->i", centres, centres)[None, :] - 2 * x @ centres.T, axis=1)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of cells: k-means of the sample from some of its distinct vectors."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(0).permutation(len(centres))[:cells]]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        many = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centres)
    return centres


@dataclass
class VectorCells:
    """rows: (cell, block, record_id, embedding), stored; centres, radii and sizes by cell, CELLS at most."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, cells: int = CELLS) -> VectorCells:
        """From (record_id, embedding); rows without a vector drop out. All vectors must have one length.

        Centres come from a bounded sample (SAMPLE_ROWS); every row is in a cell, and results don't depend on the centres.
        """
        spark = vectors.sparkSession
        v = _vectors(vectors.filter("embedding is not null"), "record_id")
        n = v.count()
        sample = v.orderBy(F.xxhash64("record_id")).limit(SAMPLE_ROWS).select("embedding").toArrow().column("embedding").combine_chunks()
        centres = _centres(_matrix(sample), max(1, min(cells, n // CELL_ROWS))) if n else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch.column("embedding"))
                    own = _nearest(x, shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns, pa.array(np.linalg.norm(x - shared.value[own], axis=1))], names=["cell", *batch.schema.names, "far"])

        key = v.schema["record_id"].dataType.simpleString()
        placed = materialise(v.mapInArrow(assign, f"cell int, record_id {key}, embedding {v.schema['embedding'].dataType.simpleString()}, far double"), "vector-cells")
        radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
        for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each cell
            radii[r["cell"]], sizes[r["cell"]] = r["far"], r["n"]
        blocks = F.element_at(F.lit(np.maximum(-(-sizes // BLOCK), 1).tolist() or [1]), F.col("cell") + 1)
        rows = placed.select("cell", F.pmod(F.xxhash64("record_id"), blocks).cast("int").alias("block"), "record_id", "embedding")
        return cls(rows, centres, radii, sizes)

    def _visits(self, anchors: DataFrame, n: int, first: bool) -> DataFrame:
        """(anchor_id, embedding, cell, block) of the cells to visit: the first ones, or the others whose bound reaches the anchor's `least`."""
        shared = anchors.sparkSession.sparkContext.broadcast((self.centres, self.radii, self.sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radii, sizes = shared.value
            for whole in batches:
                for at in range(0, len(whole), 512):
                    batch = whole.slice(at, 512)
                    q = _matrix(batch.column("embedding"))
                    near = q @ centres.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    held = np.cumsum(sizes[order], axis=1)
                    begins = np.zeros(near.shape, dtype=bool)
                    np.put_along_axis(begins, order, np.concatenate([np.zeros((len(q), 1), np.int64), held[:, :-1]], axis=1) < n, axis=1)
                    norms = np.linalg.norm(q, axis=1)[:, None]
                    if first:
                        go = begins & (sizes > 0)
                    else:
                        least = batch.column("least").to_numpy(zero_copy_only=False)[:, None]
                        allowance = SLACK * norms * (np.linalg.norm(centres, axis=1) + radii)[None, :]
                        go = ~begins & (sizes > 0) & (near + norms * radii + allowance >= np.where(np.isnan(least), -np.inf, least))
                    row, cell = np.nonzero(go)
                    many = -(-sizes[cell] // BLOCK)
                    row, cell = np.repeat(row, many), np.repeat(cell, many)
                    block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    columns = [batch.column(c).take(pa.array(row)) for c in ("anchor_id", "embedding")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))], names=["anchor_id", "embedding", "cell", "block"])

        key = anchors.schema["anchor_id"].dataType.simpleString()
        return anchors.mapInArrow(run, f"anchor_id {key}, embedding {anchors.schema['embedding'].dataType.simpleString()}, cell int, block int")

    def _best(self, visits: DataFrame, n: int) -> DataFrame:
        """(anchor_id, record_id, sim_score): the n best of each visited block."""

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"anchor_id": x["anchor_id"].iloc[:0], "record_id": y["record_id"].iloc[:0], "sim_score": np.zeros(0)})
            y = y.sort_values("record_id", ignore_index=True)
            theirs, parts = np.stack(y["embedding"].to_numpy()).astype(np.float64), []
            for at in range(0, len(x), 1024):
                some = x.iloc[at : at + 1024]
                s = np.stack(some["embedding"].to_numpy()).astype(np.float64) @ theirs.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :n]
                parts.append(pd.DataFrame({"anchor_id": np.repeat(some["anchor_id"].to_numpy(), best.shape[1]), "record_id": y["record_id"].to_numpy()[best.reshape(-1)], "sim_score": np.take_along_axis(s, best, 1).reshape(-1)}))
            return pd.concat(parts)

        types = f"anchor_id {visits.schema['anchor_id'].dataType.simpleString()}, record_id {self.rows.schema['record_id'].dataType.simpleString()}, sim_score double"
        # a block that many anchors visit is copied for each BLOCK of them
        crowds = materialise(visits.groupBy("cell", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("crowds")), "vector-crowds")
        came = visits.join(crowds, ["cell", "block"]).withColumn("crowd", F.pmod(F.xxhash64("anchor_id"), "crowds").cast("int")).drop("crowds")
        there = self.rows.join(crowds, ["cell", "block"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds")
        key = ["cell", "block", "crowd"]
        return came.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(meet, types)

    def search(self, anchors: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
        """((anchor_id, record_id, sim_score, rank), (anchor_id, visited): cells) for (anchor_id, embedding) anchors, all with a vector.

        The n largest inner products in double precision; equal ones go by record_id.
        """
        a = _vectors(anchors, "anchor_id")
        if not len(self.centres):
            a = a.limit(0)
        w = Window.partitionBy("anchor_id").orderBy(F.desc("sim_score"), "record_id")
        opening = materialise(self._visits(a, n, True), "vector-first")
        found = materialise(self._best(opening, n).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n), "vector-found")
        least = found.filter(F.col("rank") == n).select("anchor_id", F.col("sim_score").alias("least"))
        rest = materialise(self._visits(a.join(least, "anchor_id", "left"), n, False), "vector-rest")
        both = found.drop("rank").unionByName(self._best(rest, n)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        visited = opening.unionByName(rest).select("anchor_id", "cell").distinct().groupBy("anchor_id").agg(F.count("*").alias("visited"))
        return both, visited
