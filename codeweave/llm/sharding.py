"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts, and a group stays whole unless it weighs more than SPLIT of a shard (in bytes, tokens or rows); only
then it is split, by a hash of doc_id, into pieces of about PIECE of a shard. Light groups are dealt by a hash of the text to
CELLS cells for each shard; a group heavier than a cell should be is an item of its own. Cells, heavy groups and pieces
are few whatever the corpus, so their three-dimensional loads are gathered, and each, heaviest first, goes to the shard
whose residual capacity has the highest dot product with it. Where that leaves bytes uneven (the last items balance three
sums at once), single items are exchanged between the fullest and the emptiest shard. The places travel back as a small
broadcast table. Slots are numbered from counts by cell and salt, without gathering a shard.

The law is `bytes`: shard sizes come out near equal, as cells are small against a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

SHARDS, CELLS = 24, 128
ROW_BYTES = 8
#: Rows of a cell that one task numbers, and counts by cell and salt that may be broadcast.
SALT_ROWS, MAX_SALTS = 1_000_000, 1_000_000
#: The share of a shard from which on a group of equal texts is split, and that of its pieces.
SPLIT, PIECE = 0.5, 1 / 16
#: How far the fullest shard's bytes may lie above the emptiest's before items are exchanged.
EVEN = 0.01


def place(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of loads (items by dimensions): heaviest first, to the highest dot product with what is left.

    Capacity is the mean load; a shard that is past it in some dimension counts as negative there, and ties go to
    the lower shard.
    """
    total = np.maximum(loads.sum(axis=0), 1e-12)
    share = loads / total * shards
    room = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = int(np.argmax(room @ share[i]))
        room[out[i]] -= share[i]
    return out


def even_out(loads: np.ndarray, where: np.ndarray, shards: int, even: float = EVEN, most: int = 2000) -> np.ndarray:
    """where with items moved or swapped between the shards of most and least bytes (column 0) while that narrows their gap.

    Of all single moves and swaps the one that comes nearest to halving the gap is made; those that
    would push tokens or rows of the receiving shard more than 5 % past the mean don't count.
    """
    where, size = where.copy(), loads[:, 0]
    sums = np.zeros((shards, loads.shape[1]))
    np.add.at(sums, where, loads)
    mean = loads.sum(axis=0) / shards
    for _ in range(most):
        full, free = int(np.argmax(sums[:, 0])), int(np.argmin(sums[:, 0]))
        gap = sums[full, 0] - sums[free, 0]
        if gap <= even * mean[0]:
            break
        a, b = np.flatnonzero(where == full), np.append(-1, np.flatnonzero(where == free))
        b = b[np.argsort(np.where(b < 0, 0, size[b]), kind="stable")]
        have = np.where(b < 0, 0, size[b])
        # for each item of the full shard the partner (none counts as 0) that comes nearest to moving half the gap
        at = np.searchsorted(have, size[a] - gap / 2)
        near = np.stack([np.clip(at - 1, 0, len(b) - 1), np.clip(at, 0, len(b) - 1)])
        moved = size[a][None, :] - have[near]
        better = np.abs(gap - 2 * moved)
        gain = loads[a][None] - np.where(b[near][..., None] < 0, 0, loads[b[near]])
        fits = (sums[free] + gain <= np.maximum(1.05 * mean, np.maximum(sums[free], sums[full])))[..., 1:].all(axis=-1)
        better = np.where(fits & (moved > 0) & (better < gap), better, np.inf)
        row, k = np.unravel_index(int(np.argmin(better)), better.shape)
        if not np.isfinite(better[row, k]):
            break
        give, take = a[k], b[near[row, k]]
        where[give] = free
        if take >= 0:
            where[take] = full
        sums[full] -= gain[row, k]
        sums[free] += gain[row, k]
    return where


def assign(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, n_tokens, text_crc32, law, shard, slot, grown_shard of each row of docs.

    size is the text's UTF-8 bytes (none for null) plus 8; n_tokens counts its blank-separated words. Null and empty
    texts are one group. Rows of one doc_id with equal texts lie in one piece, so they are split no further. Equal doc_ids of one group are numbered in any order. Slots count from 0 in each shard without
    gaps. grown_shard is null, as `bytes` promises nothing about it. An empty table gives no rows; other columns are ignored.
    """
    spark, many = docs.sparkSession, shards * cells
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("group"),
    )
    rows = materialise(rows, "sharding-rows")
    sums = [F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("group").agg(*sums)
    total = rows.agg(*sums).first()
    names = ("size", "n_tokens", "rows")
    weight = lambda part: F.greatest(*[F.col(c) / F.lit(max(1.0, (total[c] or 0) * part)) for c in names])
    # at most 6 * many groups can weigh more than half a cell; pieces weigh PIECE of a shard
    heavy = groups.filter(weight(1 / (2 * many)) > 1)
    large = F.broadcast(heavy.select("group", F.when(weight(SPLIT / shards) > 1, F.ceil(weight(PIECE / shards))).otherwise(1).cast("long").alias("parts")))
    rows = rows.join(large, "group", "left")
    cell = F.when(F.col("parts").isNull(), F.pmod("group", F.lit(many))).otherwise(F.lit(many) + F.pmod(F.xxhash64("group", F.pmod(F.xxhash64("doc_id"), "parts")), F.lit(1 << 40)))
    rows = rows.withColumn("cell", cell)
    loads = rows.groupBy("cell").agg(*sums).orderBy("cell").toPandas()  # at most 7 * many cells and parts
    weights = loads[list(names)].to_numpy(dtype=float)
    where = even_out(weights, place(weights, shards), shards)
    starts = np.zeros(len(loads), dtype=np.int64)
    for s in range(shards):
        own = np.flatnonzero(where == s)
        starts[own] = np.cumsum(loads["rows"].to_numpy()[own]) - loads["rows"].to_numpy()[own]
    salts = -(-loads["rows"].to_numpy() // SALT_ROWS)
    places = spark.createDataFrame([tuple(map(int, x)) for x in zip(loads["cell"], where, starts, salts, strict=True)], "cell long, shard int, before long, salts long")
    rows = rows.join(F.broadcast(places), "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), "salts"))
    ahead = rows.groupBy("cell", "salt").agg(F.count("*").alias("n")).selectExpr("cell", "salt", "sum(n) over (partition by cell order by salt) - n as ahead")
    rows = rows.join(bounded_broadcast(ahead, MAX_SALTS), ["cell", "salt"])
    slot = "before + ahead + row_number() over (partition by cell, salt order by doc_id, group) - 1 as slot"
    return rows.selectExpr("doc_id", "size", "n_tokens", "text_crc32", "'bytes' as law", "shard", slot, "cast(null as int) as grown_shard")
