"""Weighted acyclic automata that map sequences of labels to counts, in arrays.

A state is a run of arcs in order of their labels; an arc has a label, the count of the sequence that ends with it (0 if it is a
prefix only) and the state behind it. Automata are built from sorted sequences, the deepest states first: states with the
same arcs are registered once, so sequences share their beginnings and their ends. Labels are 64-bit numbers above 0.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .common import U64, mix

_NONE = -1


def sort_rows(rows: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of rows (ascending by column, from the left), after the keys in `first`."""
    return np.lexsort((*rows.T[::-1], *first[::-1]))


def combine(rows: np.ndarray, weights: np.ndarray, by: np.ufunc = np.add, group: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(rows, weights) sorted, equal rows (of one group) as one with combined weights; and their groups, if given."""
    keys = () if group is None else (group,)
    order = sort_rows(rows, *keys)
    rows, weights, keys = rows[order], weights[order], tuple(k[order] for k in keys)
    if len(rows):
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new)
        rows, weights, keys = rows[at], by.reduceat(weights, at), tuple(k[at] for k in keys)
    return (rows, weights, *keys)


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest type: its size, their number, themselves."""
    top = int(values.max()) if len(values) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
    return np.array([size, len(values)], dtype="<u4").tobytes() + values.astype(f"<u{size}").tobytes()


class CountTransducer:
    """first[s]:first[s + 1] are the arcs of state s; the root is the last state."""

    def __init__(self, first: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray, width: int):
        self.first, self.label, self.weight, self.target, self.width = first, label, weight, target, width

    @classmethod
    def build(cls, rows: np.ndarray, weights: np.ndarray) -> CountTransducer:
        """From distinct sequences in order (rows, filled up with 0 behind) and their counts."""
        m, width = rows.shape
        length = (rows != 0).sum(axis=1)
        change = np.zeros((width + 1, m), dtype=bool)  # by d: rows whose first d labels differ from the row before
        change[:, :1] = True
        for d in range(width):
            change[d + 1, 1:] = change[d, 1:] | (rows[1:, d] != rows[:-1, d])
        labels, counts, targets, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        states, behind = 0, np.full(m, _NONE)
        for d in range(width - 1, -1, -1):
            at = np.flatnonzero((length > d) & change[d + 1])
            owner = np.cumsum(change[d])[at]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(at) else np.zeros(0, np.int64)
            if not len(heads):
                continue
            label, count = rows[at, d], np.where(length[at] == d + 1, weights[at], 0)
            target = behind[np.cumsum(change[d + 1])[at] - 1]
            arc = mix(label + mix(count.astype(U64) * U64(0x9E3779B97F4A7C15) + (target + 2).astype(U64)))
            many = np.diff(np.append(heads, len(at)))
            _, keep, state = np.unique(np.add.reduceat(mix(arc), heads) + many.astype(U64), return_index=True, return_inverse=True)
            arcs = _runs(heads[keep], many[keep])
            labels.append(label[arcs])
            counts.append(count[arcs])
            targets.append(target[arcs])
            sizes.append(many[keep])
            behind = np.full(m, _NONE)
            behind[owner[heads] - 1] = states + state
            states += len(keep)
        return cls(np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(labels), np.concatenate(counts), np.concatenate(targets), width)

    @classmethod
    def union(cls, parts: Iterable[CountTransducer], by: np.ufunc = np.add, least: int = 0) -> CountTransducer:
        """All sequences with their combined counts, those of `least` at least."""
        paths = [p.paths() for p in parts]
        width = max((r.shape[1] for r, _ in paths), default=1)
        rows = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r, _ in paths]) if paths else np.zeros((0, width), U64)
        rows, weights = combine(rows, np.concatenate([w for _, w in paths]) if paths else np.zeros(0, np.int64), by)
        return cls.build(rows[weights >= least], weights[weights >= least])

    def _expand(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs, which of states each belongs to)."""
        many = self.first[states + 1] - self.first[states]
        return _runs(self.first[states], many), np.repeat(np.arange(len(states)), many)

    def _root(self) -> np.ndarray:
        return np.full(min(1, len(self.first) - 1), len(self.first) - 2)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequences, counts) by length, each length in order."""
        rows, states, out = np.zeros((len(self._root()), 0), dtype=U64), self._root(), [(np.zeros((0, self.width), U64), np.zeros(0, np.int64))]
        while len(states):
            arcs, owner = self._expand(states)
            rows = np.column_stack([rows[owner], self.label[arcs]])
            said = self.weight[arcs] > 0
            out.append((np.pad(rows[said], ((0, 0), (0, self.width - rows.shape[1]))), self.weight[arcs][said]))
            go = self.target[arcs] != _NONE
            rows, states = rows[go], self.target[arcs][go]
        return np.concatenate([r for r, _ in out]), np.concatenate([w for _, w in out])

    def _step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc with the label out of each state, or -1."""
        low, end = self.first[states], self.first[states + 1]
        high = end.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = open_ & (self.label[np.minimum(mid, len(self.label) - 1)] < labels)
            low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
        hit = (low < end) & (self.label[np.minimum(low, len(self.label) - 1)] == labels)
        return np.where(hit, low, _NONE)

    def compose(self, other: CountTransducer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequences, own counts, the other's counts) of the sequences that both have: pairs of states are followed together."""
        width = max(self.width, other.width)
        both = min(len(self._root()), len(other._root()))
        rows, a, b = np.zeros((both, 0), dtype=U64), self._root()[:both], other._root()[:both]
        out = [(np.zeros((0, width), U64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        while len(a):
            mine, owner = self._expand(a)
            theirs = other._step(b[owner], self.label[mine])
            mine, owner, theirs = mine[theirs != _NONE], owner[theirs != _NONE], theirs[theirs != _NONE]
            rows = np.column_stack([rows[owner], self.label[mine]])
            said = (self.weight[mine] > 0) & (other.weight[theirs] > 0)
            out.append((np.pad(rows[said], ((0, 0), (0, width - rows.shape[1]))), self.weight[mine][said], other.weight[theirs][said]))
            go = (self.target[mine] != _NONE) & (other.target[theirs] != _NONE)
            rows, a, b = rows[go], self.target[mine][go], other.target[theirs][go]
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))

    def counts_of(self, rows: np.ndarray) -> np.ndarray:
        """The count of each sequence, 0 where it has none."""
        out = np.zeros(len(rows), dtype=np.int64)
        length = (rows != 0).sum(axis=1)
        at = np.arange(len(rows)) if len(self._root()) else np.zeros(0, np.int64)
        states = np.full(len(at), len(self.first) - 2)
        for d in range(rows.shape[1]):
            go = length[at] > d
            at, states = at[go], states[go]
            arc = self._step(states, rows[at, d])
            at, arc = at[arc != _NONE], arc[arc != _NONE]
            ends = length[at] == d + 1
            out[at[ends]] = self.weight[arc[ends]]
            go = self.target[arc] != _NONE
            at, states = at[go], self.target[arc][go]
        return out

    def to_bytes(self) -> bytes:
        return bytes([self.width]) + b"".join(_packed(x) for x in (np.diff(self.first), self.label, self.weight, self.target + 1))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        parts, at = [], 1
        for _ in range(4):
            size, n = np.frombuffer(data, dtype="<u4", count=2, offset=at)
            parts.append(np.frombuffer(data, dtype=f"<u{size}", count=n, offset=at + 8))
            at += 8 + int(size) * int(n)
        many, label, weight, target = parts
        return cls(np.append(0, np.cumsum(many.astype(np.int64))), label.astype(U64), weight.astype(np.int64), target.astype(np.int64) - 1, data[0])


def _runs(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... many[0] numbers; then those of the next, and so on."""
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
