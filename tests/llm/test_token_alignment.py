import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from codeweave.llm import token_alignment as ta
from tokenizers import Tokenizer

from .helpers import documents, odd_texts


def byte_table():
    """The byte-level alphabet: printable bytes spell themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def plain():
    """text -> ([(id, bytes)], [(id, bytes)]) by the named files' own libraries."""
    slow, alphabet = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), byte_table()
    slow.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def run(text):
        a = [(i, bytes(alphabet[c] for c in slow.id_to_token(i))) for i in slow.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in model.encode(text):
            p = model.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()))
        whole = b" " + text.encode()
        ok = text and b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole
        return (a, b) if ok else ([], [])

    return run


def spans(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def brute(rows, plain):
    found = []
    for doc, text in rows:
        a, b = (spans(x) for x in plain(text or ""))
        links, j = [], 0
        for s, e, i in a:
            while j < len(b) and b[j][1] <= s:
                j += 1
            links += [(i, y) for t, u, y in b[j : j + e - s + 1] if t < e and s < u]
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, ia, ib = [], 0, 0
        for end in ends:
            x, y = [], []
            while ia < len(a) and a[ia][1] <= end:
                x.append(a[ia][2])
                ia += 1
            while ib < len(b) and b[ib][1] <= end:
                y.append(b[ib][2])
                ib += 1
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        found.append((doc, len(a), len(b), len(ends), links, ";".join(groups)))
    count = Counter(p for r in found for p in set(r[4]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return Counter((d, na, nb, ng, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, ls, g in found)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ROWS = [(i, t) for i, t in odd_texts() if len(t or "") < 20_000] + [
    (None, "no id, 𝔘nicode ﬁ ½ and\ttabs  two blanks"), (7, "same id"), (7, "same id"), (900, "<|endoftext|> is text, <s> and </s> too <0x41>"), (901, "line\r\nline x\x00y"), (902, " leading"), (903, "▁ the mark itself"),
]


@pytest.mark.parametrize("most", [ta.MAX_PAIRS, 3])
def test_against_brute_force(spark, plain, most):
    """Both ways back of the counted pairs."""
    got = ta.align_and_count(documents(spark, ROWS).repartition(3), max_pairs=most)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute(ROWS, plain)


def test_groups_and_links(spark, plain):
    r = ta.align(documents(spark, [(1, "tokenization straddles")])).first()
    a, b = plain("tokenization straddles")
    assert [int(i) for g in r.groups.split(";") for i in g.split("|")[0].split(",")] == [i for i, _ in a]
    assert [int(i) for g in r.groups.split(";") for i in g.split("|")[1].split(",")] == [i for i, _ in b]
    assert sum(x.n for x in r.links) == r.n_links and r.n_groups == len(r.groups.split(";"))


def test_long_texts_take_the_other_library(spark, plain, monkeypatch):
    text = "some words, 12 numbers and ünïcode " * 40
    assert [list(x) for x in ta.byte_side().tokens([text])] == [[i for i, _ in plain(text)[0]]]
    monkeypatch.setattr(ta, "LONG_TEXT", 10)
    assert [list(x) for x in ta.byte_side().tokens([text])] == [[i for i, _ in plain(text)[0]]]


def test_empty_table(spark):
    for most in (ta.MAX_PAIRS, -1):
        assert ta.align_and_count(documents(spark, []), max_pairs=most).collect() == []
