"""Token counts by a count-only Viterbi over a unigram vocabulary.

The best segmentation has the highest sum of piece scores. Aho-Corasick enumerates the vocabulary's matches by end; the
dynamic programme carries, for each character, only the best score and its number of pieces. Tie rules are those of
the public sentencepiece library: of equal sums the one found first stays, and edges into a character are met by start,
so the longest last piece wins; a start where no one-character piece matches gets an unknown edge of one character, at
the lowest score less 10; unknown characters count one piece for each byte (byte fallback). Sums are double precision,
where the library's are single: beside this vocabulary's sentinel scores of -1e9 single precision loses all other differences.

Texts are normalised as the vocabulary's model says: a blank in front, blanks as U+2581. No piece of the vocabulary has
U+2581 after another character (checked on loading), so no piece crosses the place before a run of blanks, nor an ASCII
character that no piece has (a line feed, say), and the segmentation of a text is that of its chunks: such a character, or a
run of blanks with what follows up to the next. A slice's chunks are told apart by 64-bit fingerprints and length. Each
distinct chunk is solved once, all new ones of a slice in one pass of the automaton over them, set apart by NULs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_hashes, mix, slices

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Chunks of more bytes are not remembered, and a memory of more entries is begun anew.
LONG_CHUNK, MOST_KEPT = 200, 500_000
#: Bytes of text whose chunks are told apart together.
SLICE = 2 << 20

_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and scores of a sentencepiece model, read as unigrams."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self._build(scores)

    @classmethod
    def of(cls, scores: dict[str, float]) -> Vocabulary:
        out = cls.__new__(cls)
        out._build(scores)
        return out

    def _build(self, scores: dict[str, float]) -> None:
        import ahocorasick

        if any(BLANK in piece.lstrip(BLANK) for piece in scores):
            raise ValueError("a piece has a blank after another character")
        self.matches = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        self.single = {piece: score for piece, score in scores.items() if len(piece) == 1}
        self.unknown = min(scores.values(), default=0.0) - 10.0
        used = set().union(*scores) | {" "}
        self.free = np.zeros(256, dtype=bool)
        self.free[[c for c in range(128) if chr(c) not in used]] = True
        self.known: dict[tuple[int, int], tuple[float, int, int]] = {}

    def solve_all(self, chunks: list[str]) -> list[tuple[float, int, int]]:
        """solve() for many texts. Those of known characters only go through the automaton together."""
        out: list = [None] * len(chunks)
        odd = set("".join(chunks)) - self.single.keys()
        plain = [i for i, c in enumerate(chunks) if not odd or odd.isdisjoint(c)]
        for i in set(range(len(chunks))) - set(plain):
            out[i] = self.solve(chunks[i])
        text = "\0".join([chunks[i] for i in plain])
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (size, score) in self.matches.iter(text):  # of one end, the longest first
            start = end + 1 - size
            total = best[start] + score
            end += 1
            if not count[end] or total > best[end]:
                best[end] = total
                count[end] = count[start] + 1
        at = 0
        for i in plain:
            at += len(chunks[i])
            out[i] = (best[at], count[at], 0)
            at += 1
        return out

    def solve(self, text: str) -> tuple[float, int, int]:
        """(best score, pieces, unknown characters) of a normalised text."""
        n = len(text)
        best, count, lost = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (size, score) in self.matches.iter(text):
            ends[end + 1].append((size, score))
        for end in range(1, n + 1):
            top = None
            for size, score in sorted(ends[end], reverse=True):
                total = best[end - size] + score
                if top is None or total > top:
                    top, at, unknown = total, end - size, 0
            if text[end - 1] not in self.single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, at, unknown = total, end - 1, 1
            best[end] = top
            count[end] = count[at] + (len(text[end - 1].encode()) if unknown else 1)
            lost[end] = lost[at] + unknown
        return best[n], count[n], lost[n]


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _count_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    blank, free = data == 0x20, v.free[data]
    start = blank | free
    start[1:] &= ~blank[:-1] | free[1:]
    start[1:] |= free[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    text = np.searchsorted(offsets, starts, side="right") - 1
    head = starts == offsets[text]  # a chunk at a text's start has one blank more
    prints = mix(byte_hashes(data, starts, ends) + head.astype(U64) * U64(0x9E3779B97F4A7C15))
    unique, first, inverse = np.unique(prints, return_index=True, return_inverse=True)
    if len(v.known) > MOST_KEPT:
        v.known.clear()
    raw = data.tobytes()
    keys = list(zip(unique.tolist(), (ends - starts)[first].tolist(), strict=True))
    found = [v.known.get(k) for k in keys]
    new = [i for i, f in enumerate(found) if f is None]
    at = first[new]
    chunks = [(BLANK if h else "") + raw[a:b].decode("utf-8", "replace").replace(" ", BLANK) for a, b, h in zip(starts[at].tolist(), ends[at].tolist(), head[at].tolist(), strict=True)]
    for i, result in zip(new, v.solve_all(chunks), strict=True):
        found[i] = result
        if keys[i][1] <= LONG_CHUNK:
            v.known[keys[i]] = result
    results = np.array(found, dtype=float).reshape(-1, 3)
    each = results[inverse]
    return tuple(np.bincount(text, weights=each[:, j], minlength=n) for j in range(3))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            parts = [_count_slice(v, data, offsets) for _, _, data, offsets in slices(batch.column("text"), SLICE)]
            score, count, lost = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(score)], names=["doc_id", "n_tokens", "n_unknown", "score"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters), score of each row of docs; null and empty texts have none.

    path: a sentencepiece model file on every executor; by default the installed public one of 32,000 pieces. Every row
    gives one row, repeated ones too; other columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count_batches(path), "doc_id long, n_tokens long, n_unknown long, score double")
