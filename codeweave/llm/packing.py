"""Packing tokenized documents into sequences of `window` ids by non-negative least squares over length combinations.

1. Texts are tokenized where they lie; a document's ids plus the end id are cut at multiples of the window, so all but
   the last piece fill a window. The result is one narrow row a piece, stored.
2. Piece lengths are counted in bins of `grain` ids, rounded up: `window / grain` numbers, whatever the corpus.
3. Every combination of up to three bins that fills a window is a strategy. Active-set non-negative least squares
   (Lawson and Hanson 1974) finds repeat counts that match the histogram; they are rounded down.
4. What the rounded counts leave is packed greedily on the histogram: longest first, best fit.
5. The recipe is applied where the pieces lie: a piece's rank within its bin picks its sequence. Ranks come from counts
   by (bin, salt), and there are salts by the number of pieces, so a bin with most of them is numbered by many tasks.

Rounding up to bins costs less than `grain` ids of padding a piece, at the end of a sequence: pieces lie gapless.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

WINDOW, GRAIN, END_ID = 2048, 8, 1
#: Salts of a bin at least, and rows of a salt from which on there are more.
SALTS, SALT_ROWS = 256, 1_000_000
#: Counts by bin and salt that may be broadcast.
MAX_CELLS = 1_000_000
#: Texts of more characters go to the slower library, whose memory doesn't grow with one match.
LONG_TEXT = 1_000_000

_encoders: dict[str, object] = {}


def encoder(name: str):
    """text -> numpy uint32 ids of the byte-level vocabulary `name`, special tokens' strings read as such.

    tiktoken with the same vocabulary and pattern gives the ids that tokenizers gives (tested), in a fifth of the time.
    """
    if name not in _encoders:
        import base64

        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        slow = Tokenizer.from_file(files.path(f"{name}.json"))
        special = {x.content: i for i, x in slow.get_added_tokens_decoder().items()}
        fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = set(special)

        def encode(text: str) -> np.ndarray:
            if len(text) > LONG_TEXT:
                return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            return np.asarray(fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), dtype=np.uint32)

        _encoders[name] = encode
    return _encoders[name]


def _piece_batches(name: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            for at in range(0, len(rows), 100_000):
                columns = zip(*rows[at : at + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def strategies(bins: np.ndarray, full: int) -> np.ndarray:
    """All (a, b, c), a >= b >= c >= 0, of the given bin numbers and 0 with a + b + c = full, a > 0."""
    have = np.zeros(full + 1, dtype=bool)
    have[bins] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(1, full + 1), np.arange(full + 1), indexing="ij")
    c = full - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[a] & have[b] & have[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(columns: np.ndarray, target: np.ndarray, max_steps: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |A x - target|: column k of A counts the numbers in columns[k] (0 counts for nothing).

    Active set method on the normal equations; at most as many x are above 0 as target has entries.
    """
    n, m = len(columns), len(target)
    x = np.zeros(n)
    if not n:
        return x

    def dense(ks: np.ndarray) -> np.ndarray:
        out = np.zeros((m, len(ks)))
        for j in range(columns.shape[1]):
            np.add.at(out, (columns[ks, j], np.arange(len(ks))), columns[ks, j] > 0)
        return out

    def gain(r: np.ndarray) -> np.ndarray:
        r = np.append(0.0, r[1:])
        return r[columns].sum(axis=1)

    active: list[int] = []
    scale = max(1.0, float(np.abs(target).max()))
    for _ in range(max_steps or 3 * m):
        slope = gain(target - (dense(np.array(active)) @ x[active] if active else 0))
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-7 * scale:
            break
        active.append(best)
        while active:
            a = dense(np.array(active))
            z = np.linalg.lstsq(a, target, rcond=None)[0]
            if (z > 1e-12 * scale).all():
                x[active] = z
                break
            low = z <= 1e-12 * scale
            now = x[active]
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-300))
            now = now + min(1.0, step) * (z - now)
            now[low & (now <= 1e-9 * scale)] = 0
            if not (now == 0).any():
                now[np.flatnonzero(low)[np.argmin(now[low])]] = 0
            x[active] = now
            active = [k for k, v in zip(active, now, strict=True) if v > 0]
    return x


def best_fit(counts: np.ndarray, full: int) -> list[tuple[tuple[int, ...], int]]:
    """Greedy packing of a histogram: the longest first, each into the fullest sequences that have room."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []
    for size in range(full, 0, -1):
        left = int(counts[size])
        while left:
            space = min((s for s, open_ in room.items() if s >= size and open_), default=None)
            if space is None:
                fits = max(1, full // size)
                many = max(1, left // fits) if left >= fits else 1
                each = min(fits, left)
                entry, used = ((size,) * each, many), each * many
                space = full
            else:
                pieces, have = room[space].pop()
                each = min(space // size, left)
                many = max(1, min(have, left // each))
                if have > many:
                    room[space].append((pieces, have - many))
                entry, used = (pieces + (size,) * each, many), each * many
            left -= used
            rest = space - each * size
            (done if rest == 0 else room[rest]).append(entry)
    return done + [x for open_ in room.values() for x in open_]


def recipe(counts: np.ndarray, full: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, repeats) that place exactly counts[b] pieces of each bin b."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    found = strategies(np.flatnonzero(left), full)
    repeats = np.floor(nnls(found, left.astype(float)) + 1e-6).astype(np.int64)
    out = []
    for k in np.argsort(-repeats, kind="stable"):
        bins = tuple(int(b) for b in found[k] if b)
        need = {b: bins.count(b) for b in bins}
        many = int(min([repeats[k], *(left[b] // n for b, n in need.items())]))
        if many > 0:
            out.append((bins, many))
            for b, n in need.items():
                left[b] -= n * many
    return out + best_fit(left, full)


def _assign_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, froms, bases, places = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("bin").to_numpy().astype(np.int64) << 48) + rank, side="right") - 1
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("bin", "rank")}
            columns |= {"sequence_id": pa.array(bases[at] + rank - froms[at]), "place": pa.array(places[at])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks by bin: (bin << 48) + first rank, first rank, first sequence and place in the sequence."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for bins, many in plan:
        for place, b in enumerate(bins):
            rows.append((b, taken[b], base, place))
            taken[b] += many
        base += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_piece_batches(vocabulary, window, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", window: int = WINDOW, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id is kept as such, and repeated rows are packed each. Equal
    lengths are ranked by (doc_id, start, checksum), so the result doesn't depend on partitions. An empty table gives no
    rows. Other columns are ignored. sequence_id counts from 0 without gaps.
    """
    if window % grain:
        raise ValueError("window must be a multiple of grain")
    spark = docs.sparkSession
    rows = materialise(pieces(docs, vocabulary, window, end_id), "packing-pieces")
    salts = max(SALTS, -(-rows.count() // SALT_ROWS))
    rows = rows.withColumn("bin", F.ceil(F.col("length") / grain).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = rows.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(window // grain + 1, dtype=np.int64)
    for r in cells.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most window / grain rows
        counts[r["bin"]] = r["n"]
    shared = spark.sparkContext.broadcast(slots(recipe(counts, window // grain)))
    before = cells.selectExpr("bin", "salt", "sum(n) over (partition by bin order by salt rows between unbounded preceding and current row) - n as before")
    ranked = rows.selectExpr("*", "row_number() over (partition by bin, salt order by doc_id, start, ids_crc32, doc_tokens) - 1 as own")
    ranked = ranked.join(bounded_broadcast(before, MAX_CELLS), ["bin", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank")
    placed = ranked.mapInArrow(_assign_batches(shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    offset = "coalesce(sum(length) over (partition by sequence_id order by place rows between unbounded preceding and 1 preceding), 0) as offset"
    return placed.selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
