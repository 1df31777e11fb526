import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from codeweave.llm import packing as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .helpers import documents, odd_texts


def test_round_trip(spark):
    rows = odd_texts() + [(900, "<|endoftext|> within <|endoftext|>"), (901, "word " * 3000)]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = P.pack(documents(spark, rows).repartition(3)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        ids, at = [*slow.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= sum(r.length for r in got) / 2048 + 3


def test_both_libraries_at_the_border():
    """Texts just under and over LONG_TEXT characters go to different libraries, which give the same ids."""
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    base = "Straße 12, año <|endoftext|> l'été 日本\n\n  x1 " * 30_000
    for size in (P.LONG_TEXT - 3, P.LONG_TEXT + 3):
        text = base[:size]
        assert len(text) == size and P.encoder("byte_bpe_50k")(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=33, max_size=33))
def test_recipe_places_every_piece(counts):
    counts = np.array([0, *counts[1:]])
    plan = P.recipe(counts, 32)
    placed = np.zeros(33, dtype=int)
    for bins, many in plan:
        assert sum(bins) <= 32 and many > 0
        for b in bins:
            placed[b] += many
    assert (placed == counts).all()
    used = sum(m for _, m in plan)
    assert used <= np.ceil((counts * np.arange(33)).sum() / 32) * 1.5 + 2


def test_little_padding_on_many_lengths():
    r = np.random.default_rng(0)
    counts = np.bincount(np.minimum(256, r.lognormal(4, 0.8, 60_000).astype(int) + 1), minlength=257)
    used = sum(m for _, m in P.recipe(counts, 256))
    assert used <= 1.01 * (counts * np.arange(257)).sum() / 256 + 2


def test_nnls_matches_a_known_solution():
    columns = np.array([[2, 1, 1], [3, 1, 0], [4, 0, 0], [2, 2, 0]])
    x = np.array([5.0, 2.0, 7.0, 0.0])
    target = np.zeros(5)
    for k, v in zip(columns, x):
        for b in k:
            if b:
                target[b] += v
    assert np.allclose(P.nnls(columns, target), x)


def test_empty_and_null(spark):
    assert P.pack(documents(spark, [])).count() == 0
    got = P.pack(documents(spark, [(None, None), (1, ""), (1, "")])).collect()
    assert len(got) == 3 and {r.length for r in got} == {1} and {r.sequence_id for r in got} == {0}


def test_salts_grow_with_the_rows(spark, monkeypatch):
    """More salts than the least: every sequence is still whole and gapless."""
    monkeypatch.setattr(P, "SALTS", 2)
    monkeypatch.setattr(P, "SALT_ROWS", 5)
    rows = [(i % 50 if i % 3 else None, "some words " * (i % 40)) for i in range(300)]
    got = P.pack(documents(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) == 300 and sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= P.WINDOW
