import random

import public_tokenizers
import sentencepiece
from codeweave.llm import token_counts as C
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import documents, odd_texts


def unigram_model(tmp_path):
    """The public vocabulary marked as a unigram model, so that the library itself decodes it as one.

    Its sentinel scores of -1e9 are raised: beside them the library's single-precision sums lose all other differences.
    """
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(public_tokenizers.path(C.MODEL), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for piece in m.pieces:
        piece.score = max(piece.score, -40_000)
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_against_the_library(tmp_path):
    path = unigram_model(tmp_path)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), C.Vocabulary(path)
    r = random.Random(1)
    words = ["the", "theanthon", "erheit", "keitpf", "queción", "naïve", "x1", "12345", "zzz", "Ωmega", "日本語", "😀"]
    for _ in range(300):
        t = " ".join(r.choice(words) for _ in range(r.randint(1, 3)))
        score, n, _ = own.solve(C.BLANK + t.replace(" ", C.BLANK))
        assert n == len(library.encode(t)), t


def brute(v, text):
    """Best score and count by all segmentations' prefixes, without the automaton."""
    n = len(text)
    best, count = [0.0] + [None] * n, [0] * (n + 1)
    for start in range(n):
        ends = [e for e in range(start + 1, min(n, start + 40) + 1) if text[start:e] in v["scores"]]
        options = [(e, v["scores"][text[start:e]], 1) for e in ends]
        if text[start] not in v["scores"]:
            options.append((start + 1, v["unknown"], len(text[start].encode())))
        for e, score, pieces in options:
            if best[e] is None or best[start] + score > best[e]:
                best[e], count[e] = best[start] + score, count[start] + pieces
    return best[n], count[n]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4).filter(lambda p: "▁" not in p.lstrip("▁")), st.integers(-9, -1), min_size=1, max_size=12), st.text("abc▁é", min_size=1, max_size=20))
def test_ties_against_brute_force(pieces, text):
    v = C.Vocabulary.of({k: float(s) for k, s in pieces.items()})
    score, count, _ = v.solve(text)
    assert (score, count) == brute({"scores": {k: float(s) for k, s in pieces.items()}, "unknown": v.unknown}, text)


def test_chunks_add_up_to_whole_texts(spark):
    rows = odd_texts() + [(700, "  two  blanks "), (701, "tab\tand\nline")]
    v = C.vocabulary(public_tokenizers.path(C.MODEL))
    got = {r.doc_id: r for r in C.count_tokens(documents(spark, rows)).collect()}
    for i, t in rows:
        if not t:
            assert (got[i].n_tokens, got[i].score) == (0, 0)
        elif len(t) < 10_000:
            score, n, lost = v.solve(C.BLANK + t.replace(" ", C.BLANK))
            assert got[i].n_tokens == n and got[i].n_unknown == lost and abs(got[i].score - score) <= 1e-9 * abs(score), t
    assert C.count_tokens(documents(spark, [])).count() == 0
