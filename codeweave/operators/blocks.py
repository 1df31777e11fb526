"""Blocks of token sets, packed into one row each, that meet inside a task.

Equal sets of a block are one. Two sets of a and b tokens with t or more in common, both in one order of the tokens, share k of the first
a - t + k and b - t + k, for every k up to t: the k-th common token stands there. In the order from the rarest on, these prefixes hold few
tokens that many sets have, so sets meet by their prefixes, and only pairs that share k of them are counted on the whole sets. A score of
`near` needs a t that follows from a and b and grows with both, so prefixes hold for a class of neighbouring sizes on either side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa

#: Cells of counts, matches of prefixes, tokens of counted pairs, flags of tokens and pairs found that are held at a time.
CELLS, MATCHES, ENTRIES, FLAGS, FOUND = 1 << 18, 1 << 18, 1 << 22, 1 << 23, 1 << 20
#: Sizes of a class differ by this factor at most; prefixes share max(LEAST_COMMON, COMMON * t) tokens (t at most); counts are dense from so many matches a pair.
CLASS, LEAST_COMMON, COMMON, DENSE = 1.35, 3, 0.06, 0.35
PACKED = "ids binary, vocabulary binary, cells binary, n_cells long"


def packed(ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> dict:
    """One row (see PACKED) of sets of 64-bit hashes, set by set in tokens, in ascending order of size.

    The vocabulary is in descending order of frequency. A cell is a set's place times the vocabulary's size, plus a token's place; the
    sorted cells travel as compressed differences, first all their lowest bytes, then all the next.
    """
    by = np.argsort(sizes, kind="stable")
    vocabulary, token, df = np.unique(tokens[ranges((np.cumsum(sizes) - sizes)[by], sizes[by])], return_inverse=True, return_counts=True)
    order = np.argsort(-df, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    cells = np.sort(np.repeat(np.arange(len(by)), sizes[by]) * len(order) + place[token])
    steps = np.diff(cells, prepend=0).astype(_step(len(order)))
    planes = steps.view(np.uint8).reshape(-1, steps.itemsize).T
    squeezed = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return {"ids": ids[by].astype(np.int64).tobytes(), "vocabulary": vocabulary[order].astype(np.int64).tobytes(), "cells": squeezed, "n_cells": len(cells)}


def _step(words: int) -> np.dtype:
    return np.dtype(np.uint32 if words < 1 << 31 else np.int64)


def pack(ids: np.ndarray, tokens: list[np.ndarray]) -> pd.DataFrame:
    """packed() of a list of sets."""
    return pd.DataFrame([packed(ids, np.fromiter(map(len, tokens), np.int64, len(tokens)), np.concatenate(tokens))])


def merged(rows: Iterable[Mapping]) -> dict:
    """One packed row of the sets of several."""
    parts = [Block(row) for row in rows]
    return packed(*(np.concatenate(x) for x in zip(*((p.ids, p.sizes, p.vocabulary[p.token]) for p in parts), strict=True)))


class Block:
    """A packed row: ids, vocabulary, sizes by set, and the cells' tokens, set by set; starts[i]:starts[i+1] are those of set i."""

    def __init__(self, row: Mapping | pd.Series):
        self.ids, self.vocabulary = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vocabulary"], np.int64)
        kind = _step(len(self.vocabulary))
        planes = np.frombuffer(pa.decompress(row["cells"], int(row["n_cells"]) * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
        steps = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
        cells = np.cumsum(steps, dtype=np.int64)
        self.set = (cells // len(self.vocabulary)).astype(np.int32)
        self.token = (cells - self.set.astype(np.int64) * len(self.vocabulary)).astype(np.int32)
        self.sizes = np.bincount(self.set, minlength=len(self.ids))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._distinct: tuple[np.ndarray, np.ndarray] | None = None

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each set, the same in any block and order of its tokens."""
        mixed = self.vocabulary.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed * mixed)[self.token], dtype=np.uint64)])
        return (sums[self.starts[1:]] - sums[self.starts[:-1]]).view(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The sets ascending by size, equal ones (by size and hash) side by side, and where each begins."""
        if self._distinct is None:
            own = self.hashes()
            by = np.lexsort((own, self.sizes))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (own[by][1:] != own[by][:-1]) | (np.diff(self.sizes[by]) != 0)
            self._distinct = by, np.flatnonzero(new)
        return self._distinct


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def least_shared(a: float | np.ndarray, b: float | np.ndarray, near: float, weights: tuple[float, float]) -> np.ndarray:
    """The common tokens that sets of a and b tokens need for a score of near: the least root of a quadratic, with an allowance for rounding."""
    j, o = weights
    linear, constant = j * a + o * (a + b) + near * a, near * a * (a + b)
    root = (linear - np.sqrt(np.maximum(linear * linear - 4 * o * constant, 0))) / (2 * o)
    return np.ceil(np.maximum(root, near * a) - 1e-6).astype(np.int64)


_END = np.int64(1) << 61


class _Side:
    """The distinct sets of a block, ascending by size, with the tokens that the other block has too, as `rank` numbers them.

    token[starts[i] : starts[i] + shared[i]] are those of set i, in order; members[first[i] : first[i] + copies[i]] are its places in the block.
    """

    def __init__(self, block: Block, rank: np.ndarray):
        self.members, self.first = block.distinct()
        self.copies = np.diff(np.append(self.first, len(block.ids)))
        chosen = self.members[self.first]
        self.sizes = block.sizes[chosen]
        # tokens that the other block lacks, and copies, are sorted to the end
        number = np.full(len(block.ids), _END)
        number[chosen] = np.arange(len(chosen)) << 32
        key = number[block.set]
        key += np.where(rank < 0, _END, rank)[block.token]
        key.sort()
        ends = np.searchsorted(key, np.arange(len(chosen) + 1) << 32)
        self.token = (key[: ends[-1]] & 0xFFFFFFFF).astype(np.int32)
        self.starts, self.shared = ends[:-1], np.diff(ends)

    def classes(self) -> list[tuple[int, int]]:
        """Ranges of sets of neighbouring sizes."""
        at = [0]
        while at[-1] < len(self.sizes):
            at.append(int(np.searchsorted(self.sizes, self.sizes[at[-1]] * CLASS, side="right")))
        return list(zip(at, at[1:], strict=False))

    def places(self, i: np.ndarray) -> np.ndarray:
        return self.members[ranges(self.first[i], self.copies[i])]


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of neighbours whose sizes come to `most` at most, or of a single one."""
    held = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def _common(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, flags: np.ndarray, tokens: int) -> np.ndarray:
    """How many tokens the sets i of x and j of y have in common, pair by pair; flags: zeros, and zeros again afterwards."""
    by = np.argsort(i, kind="stable")
    i, j = i[by], j[by]
    number = np.cumsum(np.diff(i, prepend=i[:1]) != 0)  # sets of x, which are flagged so many at a time
    out = np.empty(len(i), dtype=np.int64)
    first, most = 0, max(1, len(flags) // tokens)
    while first < len(i):
        end = int(np.searchsorted(number, number[first] + most))
        rows = i[first:end][np.diff(i[first:end], prepend=-1) != 0]
        put = np.repeat(np.arange(len(rows)) * tokens, x.shared[rows]) + x.token[ranges(x.starts[rows], x.shared[rows])]
        flags[put] = 1
        for part in _portions(y.shared[j[first:end]], ENTRIES):
            at = slice(first + part.start, first + part.stop)
            sizes = y.shared[j[at]]
            get = np.repeat((number[at] - number[first]) * tokens, sizes) + y.token[ranges(y.starts[j[at]], sizes)]
            out[by[at]] = np.add.reduceat(flags[get], np.cumsum(sizes) - sizes, dtype=np.int64)
        flags[put] = 0
        first = end
    return out


def _meetings(token: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray, tokens: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, how many) of the prefixes, one after the other in token and other, that share k tokens or more."""
    wide = len(other_sizes)
    posted = (np.sort(other.astype(np.int64) << 32 | np.repeat(np.arange(wide), other_sizes)) & 0xFFFFFFFF).astype(np.int32)
    df = np.bincount(other, minlength=tokens)
    posting = np.cumsum(df) - df
    met = np.flatnonzero(df[token])
    row, token = np.repeat(np.arange(len(sizes)), sizes)[met], token[met]
    matches = np.bincount(row, weights=df[token], minlength=len(sizes)).astype(np.int64)
    ends = np.searchsorted(row, np.arange(len(sizes) + 1))
    dense = matches.sum() > DENSE * wide * len(sizes)
    # cells of a portion are numbered in 32 bits
    for part in _portions(np.full(len(sizes), wide), CELLS) if dense else _portions(np.maximum(matches, (MATCHES * wide >> 30) + 1), MATCHES):
        at = slice(ends[part.start], ends[part.stop])
        if at.start == at.stop:
            continue
        cells = (np.repeat(((row[a] - part.start) * wide).astype(np.int32), df[token[a]]) + posted[ranges(posting[token[a]], df[token[a]])] for a in _within(at, df[token[at]]))
        if dense:
            shared = sum(np.bincount(c, minlength=(part.stop - part.start) * wide) for c in cells)
            cell = np.flatnonzero(shared >= k)
            many = shared[cell]
        else:
            run = np.concatenate(list(cells))
            run.sort()
            first = np.flatnonzero(run[k - 1 :] == run[: max(len(run) - k + 1, 0)])
            first = first[np.diff(run[first], prepend=-1) != 0]
            cell = run[first]
            many = np.searchsorted(run, cell, side="right") - first
        left = cell // wide
        yield left + part.start, cell - left * wide, many


def _within(at: slice, sizes: np.ndarray) -> Iterator[slice]:
    for part in _portions(sizes, ENTRIES):
        yield slice(at.start + part.start, at.start + part.stop)


def met(left: Block, right: Block, near: float, weights: tuple[float, float], equal: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left places, right places, scores) of the pairs of two blocks that reach near, about FOUND pairs at a time; with or without those of equal sets."""
    j, o = weights
    _, mine, theirs = np.intersect1d(left.vocabulary, right.vocabulary, assume_unique=True, return_indices=True)
    tokens = len(mine)
    if not tokens:
        return
    order = np.argsort(np.bincount(left.token, minlength=len(left.vocabulary))[mine] * np.bincount(right.token, minlength=len(right.vocabulary))[theirs])
    sides = []
    for block, at in ((left, mine), (right, theirs)):
        rank = np.full(len(block.vocabulary), -1)
        rank[at[order]] = np.arange(tokens)
        sides.append(_Side(block, rank))
    x, y = sides
    flags = np.zeros(max(FLAGS, tokens), dtype=np.uint8)
    opposite = y.classes()
    for l0, l1 in x.classes():
        for r0, r1 in opposite:
            a, b = x.sizes[l0:l1], y.sizes[r0:r1]
            at_a, at_b = least_shared(a, b[0], near, weights), least_shared(a[0], b, near, weights)
            if at_a[0] > min(a[-1], b[-1]):
                continue
            k = int(min(at_a[0], max(LEAST_COMMON, at_a[0] * COMMON)))
            # tokens that only one side has come first, so a prefix is so much shorter without them
            fore, other = (np.where(n - t >= 0, n - t + k, 0) for n, t in ((x.shared[l0:l1], at_a), (y.shared[r0:r1], at_b)))
            token, posted = (z.token[ranges(z.starts[f:e], n)] for z, f, e, n in ((x, l0, l1, fore), (y, r0, r1, other)))
            for left_at, right_at, many in _meetings(token, fore, posted, other, tokens, k):
                # what prefixes share and what may follow; the less of the two rests follows for the set whose prefix ends first
                need = least_shared(a[left_at], b[right_at], near, weights)
                good = (many - k + np.maximum(at_a[left_at], at_b[right_at]) >= need) & (need <= np.minimum(x.shared[l0 + left_at], y.shared[r0 + right_at]))
                left_at, right_at = left_at[good], right_at[good]
                if not len(left_at):
                    continue
                # the tokens of the smaller sets are looked up
                n = _common(x, l0 + left_at, y, r0 + right_at, flags, tokens) if a[-1] >= b[0] else _common(y, r0 + right_at, x, l0 + left_at, flags, tokens)
                score = j * (n / (a[left_at] + b[right_at] - n)) + o * (n / a[left_at])
                good = np.flatnonzero((score >= near) & (equal | (n < a[left_at]) | (n < b[right_at])))
                yield from _copied(x, l0 + left_at[good], y, r0 + right_at[good], score[good])


def _copied(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of places of each pair of sets."""
    for at in _portions(x.copies[i], FOUND):
        left, right, value = x.places(i[at]), np.repeat(j[at], x.copies[i[at]]), np.repeat(score[at], x.copies[i[at]])
        for to in _portions(y.copies[right], FOUND):
            n = y.copies[right[to]]
            yield np.repeat(left[to], n), y.places(right[to]), np.repeat(value[to], n)


def meet(left: Block, right: Block, near: float, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of met() at once."""
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *met(left, right, near, weights), strict=True))
