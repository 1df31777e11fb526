"""Alignment of two tokenizers over the same texts, and the corpus-wide counts of the id pairs it links.

Side A reads a blank and the text by a byte-level vocabulary, side B the text by a piece vocabulary that puts a blank in front
itself; so both spell the same bytes. In each batch pandas.merge_asof, keyed by document, finds for each token's start the
other side's covering token; both directions together are the pairs of tokens whose bytes overlap. Bytes where a token of each side ends cut
the tokens into groups.

A pair of ids counts the documents that hold it linked. Links are stored once, as distinct pairs with their number for each document;
pairs are counted with map-side combining. The counted pairs go back to the documents as a broadcast table if they are counted
to be at most MAX_PAIRS, else by a shuffled join, which AQE may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices
from .packing import LONG_TEXT

BYTES, PIECES = "byte_bpe_50k", "piece_bpe_32k.model"
#: Bytes of text aligned at once.
SLICE = 1 << 20
#: Counted pairs that may be broadcast: 17 bytes each.
MAX_PAIRS = 2_000_000
LINK = "a int, b int, n int"
_SEPARATORS = (",", "|", ";", "")

_sides: dict[str, Side] = {}


class Side:
    """A tokenizer without special tokens: encode() texts to ids; spelt[i] are the bytes of id i."""

    def __init__(self, encode, spelt: list[bytes]):
        self.encode, self.spelt = encode, spelt
        self.sizes = np.array([len(x) for x in spelt], dtype=np.int64)
        #: ids as text, with each separator behind
        self.names = np.array([[f"{i}{s}" for i in range(len(spelt))] for s in _SEPARATORS], dtype=object)

    def tokens(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; None where they don't spell a blank and the text."""
        out = []
        for text, ids in zip(texts, self.encode(texts), strict=True):
            whole = b"".join(map(self.spelt.__getitem__, ids))
            out.append(np.asarray(ids, dtype=np.int64) if whole == b" " + text.encode() else None)
        return out


def byte_side(name: str = BYTES) -> Side:
    """The byte-level vocabulary `name`: tiktoken gives the ids of tokenizers; texts of LONG_TEXT characters and more go to the latter."""
    if name not in _sides:
        import base64

        import public_tokenizers as files
        import tiktoken
        from tokenizers import Tokenizer

        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        spelt = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelt[i] = token
        fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(files.path(f"{name}.json"))
        slow.encode_special_tokens = True
        _sides[name] = Side(lambda texts: [fast.encode_ordinary(" " + t) if len(t) < LONG_TEXT else slow.encode(" " + t, add_special_tokens=False).ids for t in texts], spelt)
    return _sides[name]


def piece_side(name: str = PIECES) -> Side:
    """The sentencepiece model `name`: U+2581 spells a blank, <0xHH> the byte."""
    if name not in _sides:
        import public_tokenizers as files
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=files.path(name))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        _sides[name] = Side(lambda texts: model.encode(texts, num_threads=1), spelt)
    return _sides[name]


def covering(tokens: pd.DataFrame, others: pd.DataFrame) -> np.ndarray:
    """For each of tokens (doc, at: first byte, ascending) the row of the token of `others` of that document that covers its start."""
    found = pd.merge_asof(tokens, others.assign(row=np.arange(len(others))), on="at", by="doc")
    return found["row"].to_numpy().astype(np.int64)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) of the tokens that overlap: both directions, those that start together once."""
    in_b, in_a = covering(a, b), covering(b, a)
    late = a["at"].to_numpy()[in_a] < b["at"].to_numpy()
    return np.append(np.arange(len(a)), in_a[late]), np.append(in_b, np.flatnonzero(late))


def _spans(side: Side, ids: list[np.ndarray]) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
    """(ids, doc and first byte, end byte) of the tokens of all texts, one after the other."""
    flat = np.concatenate(ids)
    ends = np.cumsum(side.sizes[flat])
    doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    return flat, pd.DataFrame({"doc": doc, "at": ends - side.sizes[flat]}), ends


def align_texts(texts: list[str], a: Side, b: Side) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups and links of each text; none of them where a side doesn't spell the text."""
    n = len(texts)
    both = [(i, x, y) for i, x, y in zip(range(n), a.tokens(texts), b.tokens(texts), strict=True) if texts[i] and x is not None and y is not None]
    count = np.zeros((4, n), dtype=np.int64)
    groups = [""] * n
    links = np.zeros((3, 0), dtype=np.int64)
    cuts = np.zeros(n + 1, dtype=np.int64)
    if both:
        at, ids_a, ids_b = (list(x) for x in zip(*both, strict=True))
        at = np.array(at)
        flat_a, span_a, end_a = _spans(a, ids_a)
        flat_b, span_b, end_b = _spans(b, ids_b)
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        # both sides' tokens by group, A's first
        many_a, many_b = (np.bincount(g, minlength=len(cut)) for g in (group_a, group_b))
        place_a = np.arange(len(flat_a)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(flat_b)) + np.cumsum(many_a)[group_b]
        total = len(flat_a) + len(flat_b)
        group, side, names = np.zeros(total, np.int64), np.zeros(total, np.int8), np.empty(total, dtype=object)
        group[place_a], group[place_b], side[place_b] = group_a, group_b, 1
        doc = np.zeros(total, np.int64)
        doc[place_a], doc[place_b] = span_a["doc"], span_b["doc"]
        behind = np.full(total, 3)
        behind[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1]))
        names[place_a], names[place_b] = a.names[behind[place_a], flat_a], b.names[behind[place_b], flat_b]
        bounds = np.searchsorted(doc, np.arange(len(both) + 1))
        for k, i in enumerate(at.tolist()):
            groups[i] = "".join(names[bounds[k] : bounds[k + 1]].tolist())
        row_a, row_b = overlaps(span_a, span_b)
        owner = span_a["doc"].to_numpy()[row_a]
        for j, x in enumerate((span_a["doc"], span_b["doc"], np.searchsorted(bounds, np.searchsorted(group, np.arange(len(cut))), side="right") - 1, owner)):
            count[j, at] = np.bincount(x, minlength=len(both))
        width = len(b.spelt)
        keys, times = np.unique((owner * len(a.spelt) + flat_a[row_a]) * width + flat_b[row_b], return_counts=True)
        links = np.stack([keys // width % len(a.spelt), keys % width, times])
        cuts[at + 1] = np.bincount(keys // width // len(a.spelt), minlength=len(both))
        cuts = np.cumsum(cuts)
    pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in links], names=["a", "b", "n"])
    return {x: pa.array(c) for x, c in zip(("n_a", "n_b", "n_groups", "n_links"), count, strict=True)} | {"groups": pa.array(groups, pa.string()), "links": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs)}


def _align_batches(byte_name: str, piece_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_side(byte_name), piece_side(piece_name)
        for batch in batches:
            for first, end, _, _ in slices(batch.column("text"), SLICE):
                some = batch.slice(first, end - first)
                columns = {"doc_id": some.column("doc_id")} | align_texts([t or "" for t in some.column("text").to_pylist()], a, b)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def align(docs: DataFrame, byte_name: str = BYTES, piece_name: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, links of each row of docs.

    groups: the ids of each group, as a1,a2|b1;a3|b2,b3. links: distinct linked id pairs (a, b) with the number n of their
    links. Null and empty texts, and those whose bytes a side doesn't spell, have zeros, an empty string and no links. Every row gives
    one, repeated ones and those without doc_id too; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_align_batches(byte_name, piece_name), f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<{LINK}>>")


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(a, b, documents, best) of each id pair: the documents that hold it linked, and whether no pair of the same a has more."""
    pairs = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("documents"))
    pairs = materialise(pairs, "alignment-pairs")
    most = pairs.groupBy("a").agg(F.max("documents").alias("most"))  # a row for each id of the vocabulary at most
    return pairs.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _look_up_batches(shared, width: int = 1 << 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, documents, best = shared.value
        for batch in batches:
            links = batch.column("links")
            rows, many = links.flatten(), np.diff(links.offsets.to_numpy())
            a, b, n = (rows.field(c).to_numpy().astype(np.int64) for c in ("a", "b", "n"))
            at = np.searchsorted(keys, a * width + b)
            owner = np.repeat(np.arange(len(batch)), many)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "links"}
            for name, values in (("n_best", best[at] * n), ("count_sum", documents[at] * n)):
                sums = np.zeros(len(batch), dtype=np.int64)
                np.add.at(sums, owner, values)
                columns[name] = pa.array(sums)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def align_and_count(docs: DataFrame, byte_name: str = BYTES, piece_name: str = PIECES, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each row of docs.

    n_best: links whose pair is best (see count_pairs); count_sum: the sum over links of their pair's documents. groups_sha256 is
    the hash of align()'s groups, empty without tokens. An empty table gives no rows; for the rest see align().
    """
    aligned = align(docs, byte_name, piece_name).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    aligned = materialise(aligned.withColumn("row", F.monotonically_increasing_id()), "alignment")
    pairs = materialise(count_pairs(aligned), "alignment-counts")
    narrow = aligned.drop("links")
    if pairs.limit(max_pairs + 1).count() <= max_pairs:
        table = pairs.select((F.col("a").cast("long") * F.lit(1 << 32) + F.col("b")).alias("key"), "documents", F.col("best").cast("long").alias("best")).orderBy("key").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "documents", "best")))
        kept = [f for f in narrow.schema.fields if f.name != "row"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
        return aligned.drop("row").mapInArrow(_look_up_batches(shared), f"{schema}, n_best long, count_sum long")
    linked = aligned.select("row", F.explode("links").alias("l")).select("row", "l.*").join(pairs, ["a", "b"])
    sums = linked.groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("n")).alias("n_best"), F.sum(F.col("documents") * F.col("n")).alias("count_sum"))
    return narrow.join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])
