import hashlib
import re
from collections import Counter

from codeweave.llm import decontamination as D

from .helpers import documents, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, length=10):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(length, len(w))
        for s in range(len(w) - n + 1) if w and i is not None else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    found |= windows[k]
                    hit[s : s + n] = [1] * n
        out[d] = (len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)
    return out


def test_against_brute_force(spark):
    rows = odd_texts()
    item = " ".join((rows[3][1] + " " + rows[4][1]).split()[:25])
    rows += [(500, item[20:].upper() + "! tail"), (501, "İstanbul ÉTÉ " + item), (502, item), (503, item), (504, item + " " + item)]
    items = [(1, item), (2, "one"), (10, "a-b c"), (3, None), (4, "..."), (None, "alpha"), (5, "İstanbul ÉTÉ"), (6, item), (6, item), (7, "emoji 😀 here")]
    got = D.decontaminate(documents(spark, rows).repartition(3), spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, p string"))
    got = got.collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(rows, items)
    assert {r.doc_id: set(r.near_items) for r in got} == brute_near(rows, items)


def brute_near(rows, items, terms=3, within=20):
    """Items whose rarest distinct words stand within so many words of a document."""
    split = lambda t: WORD.findall((t or "").translate(LOW))
    texts = {d: split(t) for d, t in rows}
    count = Counter(w for d, ws in texts.items() if d is not None for w in ws)
    out = {d: set() for d in texts}
    for i in {i for i, _ in items if i is not None}:
        own = {w for j, t in items if j == i for w in split(t)}
        rarest = {w for _, w in sorted((count[w], w) for w in own)[:terms]}
        for d, ws in texts.items():
            last = {}
            for at, w in enumerate(ws):
                if w in rarest:
                    last[w] = at
                    if d is not None and len(last) == len(rarest) and min(last.values()) > at - within:
                        out[d].add(str(i))
    return out


def test_empty_tables_and_null_ids(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = documents(spark, [(1, "x a b c y"), (None, "a b c"), (None, "d"), (2, None)])
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in D.decontaminate(docs, items).collect()) == [(-1, 1, 0), (-1, 3, 0), (1, 5, 3), (2, 0, 0)]
    assert D.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0
    assert D.decontaminate(docs.limit(0), items).count() == 0
    kept = D.drop_contaminated(docs, items)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 2] and kept.columns == docs.columns


def test_proximity(spark):
    items = spark.createDataFrame([(1, "rare odd queer the")], "item_id long, text string")
    docs = documents(spark, [(1, "odd the the rare the queer"), (2, "odd " + "the " * 40 + "rare queer"), (3, "rare odd queer")])
    found = D.proximity_matches(docs, items, terms=3, within=10).join(docs.select("doc_id", D.row_key(docs["doc_id"], docs["text"]).alias("key")), "key").select("doc_id", "pos").collect()
    assert sorted(map(tuple, found)) == [(1, 5), (3, 2)]


def test_rows_of_one_doc_id_are_judged_each_by_its_text(spark):
    """Two texts with ten hit words each at other places, and one row twice: a row for each."""
    item = " ".join(f"w{i}" for i in range(10))
    texts = [item + " tail", "head words here " + item, item + " tail"]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [(7, t) for t in texts] + [(8, "clean"), (8, item)])
    got = D.decontaminate(docs, items).select("doc_id", "n_words", "n_hit").collect()
    assert sorted(map(tuple, got)) == [(7, 11, 10), (7, 11, 10), (7, 13, 10), (8, 1, 0), (8, 10, 10)]
    assert [(r.doc_id, r.text) for r in D.drop_contaminated(docs, items).collect()] == [(8, "clean")]


def test_texts_of_one_item_are_not_mixed(spark):
    """An item with two texts: a stretch with words of both at their places is no window of either."""
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    mixed = [x if i % 2 else y for i, (x, y) in enumerate(zip(a, b, strict=True))]
    items = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b))], "item_id long, text string")
    rows = [(1, " ".join(mixed)), (2, " ".join(a[1:11])), (3, " ".join(b) + " x"), (4, " ".join(a[:6] + b[6:]))]
    got = D.decontaminate(documents(spark, rows), items).select("doc_id", "n_hit").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 10), (3, 12), (4, 0)]


def test_a_passage_many_times_in_a_long_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = " filler ".join([item] * 300)
    got = D.decontaminate(documents(spark, [(1, text), (2, text[9:])]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {k: v[1] for k, v in brute([(1, text), (2, text[9:])], [(1, item)]).items()}
