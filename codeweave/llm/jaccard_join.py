"""N-gram Jaccard self-join: MinHash bands propose, Bayesian pruning drops, exact sets decide.

Words are the blank-separated ones, unchanged; a text's shingles are its sets of `shingle` consecutive words (all its
words, if fewer). Two documents are linked if the Jaccard similarity of their shingle sets is at least `threshold`.

1. A node is a text, named by 64 bits of its MD5, so rows of one doc_id with different texts stay apart. One pass over
   the texts gives each row its minima; rows of a node become one by a pre-aggregated group, however many there are.
2. Each node has BANDS band keys of ROWS minima. A pair at the threshold 0.8 shares a band with probability
   1 - (1 - 0.8**ROWS)**BANDS, all but about 1e-7; above it, more. Buckets of the same nodes count once.
3. Pruning. A bucket of SMALL nodes at most is one row: its pairs' minima are compared STEP at a time, and a pair is
   dropped once the posterior probability of reaching the threshold, under a uniform prior, is below TOLERANCE (BayesLSH,
   Satuluri and Parthasarathy 2012). What is left is a forest, one edge a node at most. Nodes of larger buckets meet
   once more by shingles: linked sets share one of the first n - ceil(threshold * n) + 1 shingles of each, in any order of
   all shingles that both follow. Those that many of these nodes have come last in that order, so texts that share
   boilerplate, however many they are, meet only if it fills threshold / (2 - threshold) of them, about two thirds. Buckets
   of one shingle are pruned like the others; one that is still large stays together as a star round its least node.
4. A component's nodes are dealt to blocks, bounded in nodes and in bytes, by size level (linked sets differ in size by the
   threshold at most, so only the same or adjacent levels meet). Each pair of blocks is one group of two bounded blocks:
   pairs of all nodes of a group are looked at inside the task and never become rows.
5. In a component of several blocks the minima alone meet first, a byte each, which only adds chance matches: nodes with a
   pair that survives send their shingle sets to that group, and a bit for each such partner. There what is left is verified
   on the sets (64-bit fingerprints) and counted. A group returns a count and a root for each node.
6. The components of verified links are the classes.

The joins of texts are merge joins at every size: a side grows with the corpus, so it is shuffled from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, connected_components, hash_runs, materialise, mix, own_key, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
STEP, TOLERANCE = 20, 1e-9
SMALL = 128
#: A block of a component: about so many nodes, and so many bytes of shingle sets, at most.
BLOCK, BLOCK_BYTES = 128, 32 << 20
#: The most shingles that may be put last in the order of a node's shingles. The order is free, so results don't depend on it.
HOT_SHINGLES = 1_000_000
#: The most texts whose verdicts are broadcast because they have many copies.
HOT_TEXTS = 10_000
_MULTIPLIERS = (mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) >> U64(32)).astype(np.uint32) | np.uint32(1)


def text_digest(text: Column) -> Column:
    """64 bits of the text's MD5 as a long; a null text counts as empty."""
    return F.conv(F.left(F.md5(F.coalesce(text.cast("string"), F.lit(""))), F.lit(16)), 16, -10).cast("long")


def _shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of every shingle of a slice, in order, with repeats."""
    count = np.diff(w.bounds)
    number = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), number)
    at = np.repeat(w.bounds[:-1], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return text, hash_runs(w.hashes, at, np.minimum(at + k, w.bounds[text + 1]))


def _minima(text: np.ndarray, prints: np.ndarray, n: int) -> np.ndarray:
    """BANDS * ROWS minima for each text (all ones where it has no shingles)."""
    out = np.full((n, BANDS * ROWS), 0xFFFFFFFF, dtype=np.uint32)
    if len(text):
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        low = (prints >> U64(32)).astype(np.uint32) ^ prints.astype(np.uint32)
        for j, a in enumerate(_MULTIPLIERS):
            x = low * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[text[first], j] = np.minimum.reduceat(x, first)
    return out


def _fixed(column: pa.Array, dtype) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(dtype).reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    flat, width = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])


def _signature_batches(k: int):
    """doc_id, node, number of distinct shingles and minima of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signs = [np.zeros(0, np.int64)], [np.zeros((0, BANDS * ROWS), np.uint32)]
            for first, end, w in words_of(batch.column("text")):
                n = end - first
                text, prints = _shingles(w, k)
                signs.append(_minima(text, prints, n))
                _, at = np.unique(prints ^ mix(text.astype(U64)), return_index=True)
                sizes.append(np.bincount(text[at], minlength=n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(np.concatenate(sizes)), _binary(np.concatenate(signs))], names=["doc_id", "node", "n", "minima"])

    return run


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, node): the BANDS band keys of each node."""
    for batch in batches:
        if len(batch):
            minima = _fixed(batch.column("minima"), np.uint32)
            bands = np.zeros((len(batch), BANDS), dtype=U64)
            for r in range(ROWS):
                bands = mix(bands ^ minima[:, r::ROWS].astype(U64)) + np.arange(BANDS, dtype=U64)[None, :]
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1).view(np.int64)), pa.array(node)], names=["band", "node"])


def _set_batches(k: int):
    """Each node's distinct shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for first, end, w in words_of(batch.column("text")):
                text, prints = _shingles(w, k)
                cuts = np.searchsorted(text, np.arange(end - first + 1))
                sets += [np.unique(prints[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, most: int = BANDS * ROWS) -> dict[int, int]:
    """After n compared minima, the least number of matches with which a pair goes on.

    With m of n matches and a uniform prior the posterior is Beta(m + 1, n - m + 1), whose mass above t is the chance
    of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(step, most + 1, step):
        total, m = 0.0, -1
        while total < tolerance and m <= n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of minima a and b that Bayesian pruning leaves."""
    same, at = np.zeros(len(i), dtype=np.int64), 0
    for n, m in least.items():
        if not len(i):
            break
        same += (a[i, at:n] == b[j, at:n]).sum(axis=1)
        go = same >= m
        i, j, same, at = i[go], j[go], same[go], n
    return i, j


def _matched(left: list[np.ndarray], right: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of left[i] and right[j] for the given pairs."""
    i, j = pairs
    used_l, at_l = np.unique(i, return_inverse=True)
    used_r, at_r = np.unique(j, return_inverse=True)
    a, b = np.concatenate([left[x] for x in used_l]), np.concatenate([right[x] for x in used_r])
    who_a = np.repeat(np.arange(len(used_l)), [len(left[x]) for x in used_l])
    who_b = np.repeat(np.arange(len(used_r)), [len(right[x]) for x in used_r])
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(shared):
        return np.zeros(len(i), dtype=np.int64)
    col_a, col_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a = shared[np.minimum(col_a, len(shared) - 1)] == a
    in_b = shared[np.minimum(col_b, len(shared) - 1)] == b
    who_a, col_a, who_b, col_b = who_a[in_a], col_a[in_a], who_b[in_b], col_b[in_b]
    counts = np.zeros((len(used_l), len(used_r)), dtype=np.float64)
    wide = 4096
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    who_a, col_a, who_b, col_b = who_a[order_a], col_a[order_a], who_b[order_b], col_b[order_b]
    for at in range(0, len(shared), wide):
        x, y = np.searchsorted(col_a, [at, at + wide]), np.searchsorted(col_b, [at, at + wide])
        m = np.zeros((len(used_l), wide), dtype=np.float32)
        m[who_a[x[0] : x[1]], col_a[x[0] : x[1]] - at] = 1
        p = np.zeros((len(used_r), wide), dtype=np.float32)
        p[who_b[y[0] : y[1]], col_b[y[0] : y[1]] - at] = 1
        counts += m @ p.T
    return counts[at_l, at_r].astype(np.int64)


def _near(n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sizes may reach the threshold."""
    near = np.minimum(n_a[:, None], n_b[None, :]) >= threshold * np.maximum(n_a[:, None], n_b[None, :]) - 1e-9
    return near & (n_a[:, None] > 0) & (n_b[None, :] > 0)


def linked_pairs(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float, least: dict[int, int], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of linked rows of two blocks, or of one block with itself (i < j); among: the pairs that pruning left, if known."""
    one = right is None
    right = left if one else right
    sets_a = [np.frombuffer(x, dtype=U64) for x in left["shingles"]]
    sets_b = [np.frombuffer(x, dtype=U64) for x in right["shingles"]]
    n_a, n_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    near = _near(n_a, n_b, threshold)
    near = near if among is None else near & among
    i, j = np.nonzero(np.triu(near, 1) if one else near)
    if among is None:
        a, b = (np.stack([np.frombuffer(x, dtype=np.uint32) for x in side["minima"]]) for side in (left, right))
        i, j = surviving(a, b, i, j, least)
    if not len(i):
        return i, j
    both = _matched(sets_a, sets_b, (i, j))
    yes = both >= threshold * (n_a[i] + n_b[j] - both) - 1e-9
    return i[yes], j[yes]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _prune_batches(threshold: float, least: dict[int, int]):
    """Buckets (members: node, n, minima) to edges (u, v) from each node to the root of its component of surviving pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            rows, sizes = members.flatten(), np.array(members.value_lengths().to_pylist(), dtype=np.int64)
            if not len(rows):
                continue
            node, n, minima = rows.field("node").to_numpy(), rows.field("n").to_numpy(), _fixed(rows.field("minima"), np.uint32)
            starts, parts = np.cumsum(sizes) - sizes, []
            # all pairs i < j of each bucket; buckets of one size together
            for size in np.unique(sizes):
                at = starts[sizes == size]
                a, b = np.triu_indices(size, 1)
                step = max(1, (1 << 20) // max(1, len(a)))
                for some in range(0, len(at), step):
                    i, j = (at[some : some + step, None] + a).reshape(-1), (at[some : some + step, None] + b).reshape(-1)
                    may = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                    parts.append(surviving(minima, minima, i[may], j[may], least))
            root = _roots(len(rows), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            some = np.flatnonzero(root != np.arange(len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[root[some]])], names=["u", "v"])

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minima's lowest bytes: equal minima stay equal, others agree by chance once in 256."""
    for batch in batches:
        if len(batch):
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns["minima"] = _binary(_fixed(batch.column("minima"), np.uint32).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the group's two sides, and whether it is one block with itself."""
    one, side = rows.iloc[0], rows["side"].to_numpy()
    if (one["l1"], one["b1"]) == (one["l2"], one["b2"]):
        return np.arange(len(rows)), np.arange(len(rows)), True
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), False


def _minima_pair(least: dict[int, int]):
    """The nodes of a group that have a pair whose minima survive: the group, the node's place on its side, and bits of its partners' places."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        left, right, own = _sides(rows)
        minima = np.stack([np.frombuffer(x, dtype=np.uint8) for x in rows["minima"]])
        i, j = np.triu_indices(len(left), 1) if own else (x.reshape(-1) for x in np.indices((len(left), len(right))))
        i, j = surviving(minima[left], minima[right], i, j, least)
        met = np.zeros((len(left), len(right)), dtype=bool)
        met[i, j] = True
        met = met | met.T if own else met
        out = []
        for at, bits in ((left, met),) if own else ((left, met), (right, met.T)):
            some = np.flatnonzero(bits.any(axis=1))
            groups = rows[["comp", "l1", "b1", "l2", "b2", "side"]].iloc[at[some]].to_dict("records")
            out += [(node, {**g, "place": int(k), "partners": np.packbits(bits[k]).tobytes()}) for node, g, k in zip(rows["node"].to_numpy()[at[some]].tolist(), groups, some, strict=True)]
        return pd.DataFrame({"node": np.array([n for n, _ in out], dtype=np.int64), "pair": pd.Series([p for _, p in out], dtype=object)})

    return run


def _among(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """Which pairs of the sides' rows _minima_pair left; None where it had no part."""
    if rows["partners"].iloc[0] is None:
        return None
    there = rows["place"].to_numpy()[right]
    return np.stack([np.unpackbits(np.frombuffer(rows["partners"].iloc[k], dtype=np.uint8))[there] for k in left]).astype(bool)


def _block_pair(threshold: float, least: dict[int, int]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        left, right, own = _sides(rows)
        if not len(left) or not len(right):
            return pd.DataFrame({x: np.zeros(0, dtype=np.int64) for x in ("node", "root", "texts", "links")})
        i, j = linked_pairs(rows.iloc[left], None if own else rows.iloc[right], threshold, least, _among(rows, left, right))
        i, j = left[i], right[j]
        n, copies, ids = len(rows), rows["copies"].to_numpy(), rows["node"].to_numpy()
        texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        links = np.bincount(i, weights=copies[j], minlength=n) + np.bincount(j, weights=copies[i], minlength=n)
        some = texts > 0
        return pd.DataFrame({"node": ids[some], "root": ids[_roots(n, i, j)][some], "texts": texts[some].astype(np.int64), "links": links[some].astype(np.int64)})

    return run


def _bucket_edges(banded: DataFrame, nodes: DataFrame, threshold: float, least: dict[int, int], small: int) -> tuple[DataFrame, DataFrame]:
    """((u, v) edges that pruning leaves in buckets of `small` nodes at most, (node, centre) of the larger ones) of (band, node)."""
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("centre"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("mark2"))
    buckets = buckets.filter("centre < most")
    # of buckets with the same nodes one is enough
    kept = buckets.groupBy("size", "centre", "most", "mark", "mark2").agg(F.min("band").alias("band")).select("band", "centre", "size")
    stars = materialise(banded.join(kept.hint("merge"), "band").select("band", "node", "centre", "size"), "jaccard-buckets")
    members = stars.filter(F.col("size") <= small).select("band", "node").join(nodes.select("node", "n", "minima").hint("merge"), "node")
    members = members.groupBy("band").agg(F.collect_list(F.struct("node", "n", "minima")).alias("members")).select("members")  # of `small` nodes at most
    return members.mapInArrow(_prune_batches(threshold, least), "u long, v long"), stars.filter(F.col("size") > small).select("node", "centre")


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n): the shingles of a batch's sets and in how many of them they are."""
    for batch in batches:
        found, n = np.unique(_joined(batch.column("shingles")), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])


def _joined(sets: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sets.to_pylist()), dtype=U64)


def _prefix_batches(shared, threshold: float):
    """(band, node): the first shingles of each node's set, those in `shared` last; a linked pair has one of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column("shingles").to_pylist()], dtype=np.int64)
            shingles, owner = _joined(batch.column("shingles")), np.repeat(np.arange(len(batch)), sizes)
            at = np.minimum(np.searchsorted(hot, shingles), max(0, len(hot) - 1))
            late = hot[at] == shingles if len(hot) else np.zeros(len(shingles), bool)
            order = np.lexsort((shingles, late, owner))
            place = np.arange(len(shingles)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = place < (sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(shingles[order][first].view(np.int64)), pa.array(batch.column("node").to_numpy()[owner[first]])], names=["band", "node"])

    return run


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes (node, doc_id of one row that has it); repeated rows meet in a pre-aggregated group."""
    return docs.join(nodes.select("node", "doc_id").hint("merge"), ["doc_id", "node"], "left_semi").groupBy("node").agg(F.max("text").alias("text"))


def _candidate_components(docs: DataFrame, nodes: DataFrame, shingle: int, threshold: float, least: dict[int, int], small: int) -> tuple[DataFrame, DataFrame]:
    """((node, comp) of the nodes that have a partner which may reach the threshold, (node, shingles) of at least these). docs: doc_id, node, text; nodes: node, first_id, n, minima.

    Texts are shuffled once, for the sets of all nodes that pruning left or that are in large buckets.
    """
    banded = nodes.filter("n > 0").select("node", "minima").mapInArrow(_band_batches, "band long, node long")
    edges, large = _bucket_edges(banded, nodes, threshold, least, small)
    edges, large = materialise(edges, "jaccard-edges"), materialise(large.select("node").distinct(), "jaccard-large")
    wanted = edges.select("u").union(edges.select("v")).union(large).withColumnRenamed("u", "node").distinct().join(nodes.select("node", F.col("first_id").alias("doc_id")).hint("merge"), "node")
    sets = materialise(_texts_of(docs, wanted).mapInArrow(_set_batches(shingle), "node long, shingles binary"), "jaccard-sets")
    if not large.isEmpty():
        own = sets.join(large, "node")
        often = own.select("shingles").mapInArrow(_shingle_batches, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > small)
        hot = often.orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).select("shingle").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot.column("shingle").to_numpy().view(U64)))
        more, stars = _bucket_edges(own.mapInArrow(_prefix_batches(shared, threshold), "band long, node long"), nodes, threshold, least, small)
        edges = edges.union(more).union(stars.filter("node <> centre").selectExpr("node as u", "centre as v"))
    return connected_components(edges, "jaccard-candidates").withColumnRenamed("component", "comp"), sets


def _judged(docs: DataFrame, shingle: int, threshold: float, tolerance: float, block: int, small: int) -> DataFrame:
    """doc_id, node, class_id, class_node, n_links, n_text_links, n_copies of each row of docs that has a doc_id."""
    least = least_matches(threshold, tolerance)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null").withColumn("node", text_digest(F.col("text")))
    signed = materialise(docs.mapInArrow(_signature_batches(shingle), "doc_id long, node long, n long, minima binary"), "jaccard-signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("minima").alias("minima"))
    nodes = materialise(nodes, "jaccard-nodes")
    candidates, sets = _candidate_components(docs, nodes, shingle, threshold, least, small)
    members = candidates.join(nodes.select("node", "copies", "n"), "node")
    total = members.groupBy("comp").agg(F.count("*").alias("total"), F.sum("n").alias("total_n"))
    fits = (F.col("total") <= block) & (F.col("total_n") * 8 <= BLOCK_BYTES)
    members = members.join(total.select(own_key("comp"), "total", "total_n"), "comp").withColumn("level", F.when(fits, 0).otherwise(F.floor(F.log("n") / -math.log(threshold))).cast("int")).drop("total", "total_n")
    members = materialise(members, "jaccard-members")
    blocks = members.groupBy("comp", "level").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    near = blocks.select("comp", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"), F.struct(F.col("level").alias("level"), "blocks").alias("other"))
    near = near.groupBy("comp", "level").agg(F.collect_list("other").alias("others"))  # three at most
    dealt = members.join(near.select(own_key("comp"), "level", "others"), ["comp", "level"]).selectExpr("node", "copies", "comp", "level", "pmod(xxhash64(node), element_at(filter(others, x -> x.level = level), 1).blocks) as block", "others")
    # a pair of blocks is named by its lesser block (level, block) and its greater; equal blocks meet once
    pairs = """flatten(transform(others, o -> transform(sequence(0, o.blocks - 1), b ->
        if(o.level > level or (o.level = level and b >= block),
           struct(comp as comp, level as l1, cast(block as int) as b1, o.level as l2, b as b2, 0 as side),
           struct(comp as comp, o.level as l1, b as b1, level as l2, cast(block as int) as b2, 1 as side)))))"""
    dealt = dealt.selectExpr("node", "copies", "aggregate(others, 0, (s, o) -> s + o.blocks) > 1 as several", f"{pairs} as pairs")
    dealt = materialise(dealt, "jaccard-dealt")
    key = ["comp", "l1", "b1", "l2", "b2"]
    group = "comp:long,l1:int,b1:int,l2:int,b2:int,side:int"
    pair_type = f"array<struct<{group},place:int,partners:binary>>"
    # of several blocks: the groups in which a node has a pair that survives
    met = dealt.filter("several").join(nodes.select("node", "minima").hint("merge"), "node").select("node", "minima", "pairs")
    met = met.mapInArrow(_low_bytes, f"node long, minima binary, pairs array<struct<{group}>>").select("node", "minima", F.explode("pairs").alias("pair")).select("node", "minima", "pair.*")
    met = met.groupBy(*key).applyInPandas(_minima_pair(least), f"node long, pair {pair_type[6:-1]}").groupBy("node").agg(F.collect_list("pair").alias("pairs"))  # its own blocks and those opposite
    several = dealt.filter("several").select("node", "copies").join(met.hint("merge"), "node").select("node", "copies", "pairs")
    alone = "transform(pairs, p -> named_struct('comp', p.comp, 'l1', p.l1, 'b1', p.b1, 'l2', p.l2, 'b2', p.b2, 'side', p.side, 'place', 0, 'partners', cast(null as binary))) as pairs"
    meeting = several.withColumn("several", F.lit(True)).unionByName(dealt.filter("not several").selectExpr("node", "copies", alone, "several"))
    # minima go on where they haven't met yet
    dealt = meeting.join(nodes.select("node", "minima").hint("merge"), "node").withColumn("minima", F.when(~F.col("several"), F.col("minima"))).drop("several")
    sets = dealt.join(sets, "node")
    sets = sets.select("node", "copies", "shingles", "minima", F.explode("pairs").alias("pair")).select("node", "copies", "shingles", "minima", "pair.*")
    found = sets.groupBy(*key).applyInPandas(_block_pair(threshold, least), "node long, root long, texts long, links long")
    found = materialise(found, "jaccard-links")
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "jaccard-classes")
    counts = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("links").alias("links"))
    linked = materialise(nodes.select("node", "first_id").join(parts, "node").join(counts, "node", "left"), "jaccard-linked")
    heads = linked.groupBy("component").agg(F.min(F.struct("first_id", "node")).alias("head"))
    linked = linked.join(heads.select(own_key("component"), "head"), "component").select("node", F.col("head.first_id").alias("class_id"), F.col("head.node").alias("class_node"), "texts", "links")
    result = nodes.select("node", "first_id", "copies").join(linked, "node", "left").selectExpr(
        "node", "coalesce(class_id, first_id) as class_id", "coalesce(class_node, node) as class_node", "coalesce(links, 0) + copies - 1 as n_links", "coalesce(texts, 0) as n_text_links", "copies as n_copies"
    )
    result = materialise(result, "jaccard-result")
    # texts with more than a HOT_TEXTS-th of all rows, of which there are fewer than HOT_TEXTS, meet their rows without a shuffle
    rows = result.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    hot = F.col("n_copies") * HOT_TEXTS > F.lit(rows)
    keyed, many = signed.select("doc_id", "node"), F.broadcast(result.filter(hot))
    rest = keyed.join(F.broadcast(result.filter(hot).select("node")), "node", "left_anti").join(result.filter(~hot), "node")
    return keyed.join(many, "node").unionByName(rest)


def join_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """One row a document: doc_id, class_id, n_links, n_text_links, n_copies.

    class_id is the least doc_id that chains of links (or equality) lead to; n_links counts the other rows linked to
    this one, equal texts included; n_text_links the other texts linked to its text; n_copies the rows of its text.
    A null text counts as empty; texts without words are equal to each other but not linked to anything else. Rows with
    a null doc_id are neither judged nor matched and come back with a null class and no links. Repeated rows count as
    copies; rows of one doc_id with different texts are judged each by its own text. Other columns are ignored, and an
    empty table gives no rows. Results are exact up to collisions of 64-bit fingerprints. Thresholds under 0.8 need more
    bands for the same recall.
    """
    judged = _judged(docs, shingle, threshold, tolerance, block, small).select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")
    apart = docs.filter("doc_id is null").selectExpr("cast(null as long) as doc_id", "cast(null as long) as class_id", "0L as n_links", "0L as n_text_links", "1L as n_copies")
    return judged.union(apart)


def keep_first_of_class(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, small: int = SMALL) -> DataFrame:
    """The rows of docs, all columns, that are the first of their class; rows with a null doc_id stay.

    The first is the text of least doc_id (of several texts of that doc_id, the one of least digest). Of its repeated rows one stays.
    """
    rows = _judged(docs, shingle, threshold, tolerance, block, small).select("doc_id", "node", ((F.col("doc_id") != F.col("class_id")) | (F.col("node") != F.col("class_node"))).alias("gone"))
    marks = rows.groupBy("doc_id", "node").agg(F.max("gone").alias("_gone"), F.count("*").alias("n")).filter("_gone or n > 1")
    marks = materialise(marks.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), "_gone"), "jaccard-marks")
    keys = (docs["doc_id"].cast("long") == marks["_doc"]) & (text_digest(docs["text"]) == marks["_node"])
    kept = docs.join(marks.hint("merge"), keys, "left_anti")
    several = marks.filter("not _gone")
    if several.isEmpty():
        return kept
    once = docs.join(several.select("_doc", "_node"), keys).dropDuplicates(["_doc", "_node"]).select(*[docs[c] for c in docs.columns])
    return kept.union(once)
