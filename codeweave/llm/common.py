"""Helpers shared by the corpus operators: word hashing over Arrow batches, bounded broadcasts, cut lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components, materialise, own_key, shared_dir  # noqa: F401

U64 = np.uint64
#: Bytes of text hashed at once: the numpy temporaries are a few dozen times this.
SLICE_BYTES = 1 << 20


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it is counted to have max_rows rows at most, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _is_word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words of everything but space and the five control characters that are white space in ASCII.
BLANK_SEPARATED = _is_word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ASCII letters and digits and of every character beyond ASCII.
ALNUM = _is_word_table(bytes(x for x in range(128) if not chr(x).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        grown = np.full(size, base, dtype=U64)
        grown[0] = 1
        have = _powers[base] = np.cumprod(grown, dtype=U64)
    return have[:n]


BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (BYTE_BASE, WORD_BASE)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of values[start:end], through prefix sums."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(values * _power_table(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _power_table(_INVERSE[base], n + 1)[starts]


def hash_runs(word_hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the word sequences [start, end)."""
    return mix(_ranges(word_hashes, WORD_BASE, starts, ends) + (ends - starts).astype(U64) * U64(0x632BE59BD9B4E019))


#: Byte strings from this length on are hashed one by one: of kilobytes, polynomials modulo 2**64 have known collisions.
LONG_BYTES = 512


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte strings data[start:end]."""
    sizes = ends - starts
    out = mix(_ranges(data.astype(U64) + U64(1), BYTE_BASE, starts, ends) + sizes.astype(U64))
    for i in np.flatnonzero(sizes >= LONG_BYTES):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


class Words:
    """The words of a slice of texts: byte spans, text index and 64-bit hash of each; bounds[i]:bounds[i+1] are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray):
        offsets = offsets - offsets[0]
        word = is_word[data]
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before[cuts] = False
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        after[cuts - 1] = False
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        folded = fold[data]
        self.hashes = byte_hashes(folded, self.starts, self.ends)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of whole texts of about limit bytes."""
    data, offsets = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1]
        at = to


def words_of(column: pa.Array, is_word: np.ndarray = BLANK_SEPARATED, fold: np.ndarray = SAME) -> Iterator[tuple[int, int, Words]]:
    for first, end, data, offsets in slices(column):
        yield first, end, Words(data, offsets, is_word, fold)


def first_of_key(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order sorted by keys (the first is the most significant), and which rows of that order begin a new key."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new
