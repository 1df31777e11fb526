from codeweave.operators import classify, ingest, link, lookup, pages, reference_docs

LINKS = [
    (0, "ON", "A001", "alpha beta gamma delta", "001.000"), (1, "ON", "A002", "alpha beta gamma", "001.000"), (2, "BC", "101", "alpha beta gamma delta", "001.000"), (3, "YT", "1001", "alpha beta gamma delta epsilon", "001.000"),
    (4, "BC", "102", "", "001.000"), (5, "YT", "1002", "", "001.000"), (6, "ON", "A003", "zeta", ""), (7, "BC", "103", "omega", "002.000"),
]


def fees(spark, rows):
    return spark.createDataFrame([(*r, "") for r in rows], "record_id long, province string, fsc_code string, fsc_fn string, NGS_code string, fsc_description string")


def test_linking(spark):
    for dense in (False, True):
        got = {r.record_id: r.top_key for r in link.link(fees(spark, LINKS), dense).collect()}
        assert got == {0: "001.000_0001", 2: "001.000_0001", 3: "001.000_0001", 4: "001.000_0002", 5: "001.000_0002", 1: "001.000_0003", 6: "NOMAP_ON_A003", 7: "002.000_0001"}
    keyed = link.link(fees(spark, LINKS))
    assert tuple(link.group_sizes(keyed).first()) == (5, 2, 3, 3)
    assert [r.top_key for r in link.sample_groups(keyed).collect()] == ["001.000_0001", "001.000_0002"]


def greedy_checker(rows):
    """Nested loops in plain Python: the fold as it is told in words."""
    stop = set(__import__("codeweave.functions.text", fromlist=["x"]).STOP_LOOKUP)
    tokens = {r[0]: {w for w in __import__("re").findall("[a-z0-9]+", r[3].lower()) if len(w) > 2 and w not in stop} for r in rows}
    keys, where = {}, {r[0]: r for r in rows}
    for bucket in sorted({r[4] for r in rows}):
        own = [r for r in rows if r[4] == bucket]
        order = list(dict.fromkeys(r[1] for r in own))
        pairs = []
        for x in range(len(order)):
            for y in range(x + 1, len(order)):
                for a in (r for r in own if r[1] == order[x]):
                    for b in (r for r in own if r[1] == order[y]):
                        s, t = tokens[a[0]], tokens[b[0]]
                        n = len(s & t)
                        score = 0.05 if not s and not t else 0.02 if not s or not t else 0.4 * (n / len(s | t)) + 0.6 * (n / len(s))
                        if score >= (0.55 if s and t else 0.03):
                            pairs.append((score, a[0], b[0]))
        pairs.sort(key=lambda p: -p[0])
        group, members = {}, []
        for _, a, b in pairs:
            if a in group and b in group:
                continue
            if a not in group and b not in group:
                members.append({where[a][1], where[b][1]})
                group[a] = group[b] = len(members)
            else:
                g, new = (group[a], b) if a in group else (group[b], a)
                if where[new][1] not in members[g - 1]:
                    members[g - 1].add(where[new][1])
                    group[new] = g
        n = len(members)
        for r in own:
            if r[0] not in group:
                n += 1
                group[r[0]] = n
            keys[r[0]] = f"{bucket}_{group[r[0]]:04d}"
    return keys


def test_linking_against_a_plain_checker(spark):
    import random

    r = random.Random(2)
    words = [f"word{i}" for i in range(9)]
    rows = [(i, r.choice(["ON", "BC", "YT"]), f"c{i}", " ".join(r.sample(words, r.randint(0, 4))), r.choice(["001.000", "002.000"])) for i in range(150)]
    want = greedy_checker(rows)
    for dense in (False, True):
        assert {x.record_id: x.top_key for x in link.link(fees(spark, rows), dense).collect()} == want


def test_rounds_against_one_fold(spark):
    """Rounds of joins to the last pair give the groups that one task gives."""
    import random

    r = random.Random(4)
    records = spark.createDataFrame([(i, r.choice(["ON", "BC", "YT", "NL"])) for i in range(60)], "record_id long, province string")
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(300)})
    pairs = spark.createDataFrame([("b" if a % 2 else "c", a, b, "1-2", r.randint(1, 20) / 20) for a, b in pairs if a % 2 == b % 2], "bucket string, left_id long, right_id long, prov_pair string, score double")
    groups = [sorted(map(tuple, link.greedy_groups(pairs, records, last, bands, fold).collect())) for last, bands, fold in ((0, 5, 10**6), (20, 3, 10**6), (0, 2, 30), (10**6, 1, 1))]
    assert groups[0] == groups[1] == groups[2] == groups[3] and len(groups[0]) > 20


def test_a_chain_is_folded_in_few_rounds(spark, monkeypatch):
    """10,000 pairs of descending scores, each with a record of the one before: a round for each band."""
    rounds = []
    plain = link.connected_components
    monkeypatch.setattr(link, "connected_components", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    n = 10_000
    records = spark.range(n + 1).selectExpr("id as record_id", "case id % 4 when 0 then 'ON' when 1 then 'BC' when 2 then 'YT' else 'NL' end as province")
    pairs = spark.range(n).selectExpr("'b' as bucket", "id as left_id", "id + 1 as right_id", "'1-2' as prov_pair", "1 - id / 20000 as score")
    got = sorted(map(tuple, link.greedy_groups(pairs, records, last_pairs=0, bands=4).collect()))
    assert len(rounds) <= 20 and got == sorted(map(tuple, link.greedy_groups(pairs, records).collect()))
    # the first four records of each run have four provinces
    assert len(got) == n and max(g for _, _, g in got) == n // 4


def test_pairs_are_stored_once(spark, monkeypatch):
    """Beyond one task's pairs, no second table and no shuffle holds all pairs: bands are read from the first, and members looked up there."""
    from codeweave.operators import records as rec

    import random

    r = random.Random(8)
    records = spark.createDataFrame([(i, ["ON", "BC", "YT"][i % 3]) for i in range(90)], "record_id long, province string")
    rows = [("b", a, b, f"{a % 3}-{b % 3}", r.randint(1, 9) / 10) for a in range(90) for b in range(90) if a % 3 < b % 3]
    pairs = spark.createDataFrame(rows, "bucket string, left_id long, right_id long, prov_pair string, score double")
    want = sorted(map(tuple, link.greedy_groups(pairs, records).collect()))
    held, plans = [], []

    def kept(module, name):
        plain = getattr(module, name)

        def run(df, table):
            if table == "link-band":
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            out = plain(df, table)
            held.append((table, (out if name == "materialise" else out[0]).count()))
            return out

        monkeypatch.setattr(module, name, run)

    for module, name in ((link, "stored"), (link, "materialise"), (rec, "materialise")):
        kept(module, name)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, link.greedy_groups(pairs, records, last_pairs=100, bands=8).collect()))
        shuffled = [p for p in plans if "SortMergeJoin LeftOuter" in p or "SortMergeJoin [left_id" in p or "SortMergeJoin [right_id" in p]
        monkeypatch.setattr(link, "MAP_MEMBERS", 0, raising=False)
        again = sorted(map(tuple, link.greedy_groups(pairs, records, last_pairs=100, bands=8).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == again == want and len(want) == 90
    assert plans and not shuffled
    assert [t for t, n in held if n == len(rows)] == ["link-pairs"] * 2


def test_best_by_tokens_both_ways(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    left = spark.createDataFrame([(i, r.sample(words, r.randint(0, 9))) for i in range(600)], "id long, tokens array<string>")
    right = spark.createDataFrame([(f"c{i % 17}", i, r.sample(words, r.randint(0, 6))) for i in range(20)], "other string, ord int, tokens array<string>")
    small, large = ({x.id: (x.other, x.score, x.shared) for x in classify.best_by_tokens(left, right, max_cells=n).collect()} for n in (10**6, 0))
    assert small == large and len(small) > 500
    assert classify.best_by_tokens(left, right.limit(0)).count() == 0


def test_roles(spark):
    roles = spark.createDataFrame([("ON", "B", ["073.000"], 1), ("BC", "B", ["075.000"], 2), ("ON", "C", [], 3)], "province string, role_code string, ngs_codes array<string>, ord int")
    codes = spark.createDataFrame([("ON", "B"), ("BC", "B"), ("NL", "B"), ("ON", "C"), ("ON", "")], "province string, role string")
    assert {(r.province, r.role): r.role_ngs for r in classify.role_lookup(codes, roles).collect()} == {("ON", "B"): "073.000", ("BC", "B"): "075.000", ("NL", "B"): "075.000", ("ON", "C"): None, ("ON", ""): None}


def test_cascade(spark):
    rows = [
        (0, "ON", "A001B", "plain words", "", "", ""), (1, "ON", "A002", "general assessment and consultation", "", "", ""), (2, "YT", "0615", "ambulance transfer overnight", "", "", ""),
        (3, "BC", "00158", "unknowable", "", "RADIOLOGY", ""), (4, "BC", "00159", "unknowable", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "record_id long, province string, fsc_code string, fsc_fn string, fsc_description string, fsc_section string, fsc_chapter string")
    categories = spark.createDataFrame([("002.000", "Consultation", "", 0), ("090.000", "Ambulance", "transfer of patients", 1), ("091.000", "Ambulance", "transfer of patients", 2)], "ngs_code string, ngs_label string, ngs_description string, ord int")
    roles = spark.createDataFrame([("ON", "B", ["073.000"], 1)], "province string, role_code string, ngs_codes array<string>, ord int")
    got = {r.record_id: r for r in classify.cascade(df, categories, roles).collect()}
    assert [got[i].match_method for i in range(5)] == ["role_code_table", "keyword_rule", "text_similarity", "section_fallback", ""]
    assert [got[i].NGS_code for i in range(5)] == ["073.000", "002.000", "090.000", "080.000", ""]
    assert got[1].NGS_label == "Consultation" and got[2].match_score == round(0.35 * 2 / 4 + 0.65 * 2 / 3, 4) and got[2].NGS_rationale == "Shared terms: ambulance, transfer"
    assert [got[i].match_score for i in (0, 1, 3, 4)] == [1.0, 0.9, 0.2, 0.0] and got[0].NGS_rationale == "Role code 'B' maps to NGS 073.000"


def lookups(spark):
    rows = [(i, p, c, f, "", "", "", "", n, lab) for i, p, c, f, n, lab in [
        (0, "ON", "K040", "knee repair", "001.000", ""), (1, "BC", "9", "nothing", "", ""), (2, "BC", "8", "knee", "001.000", ""), (3, "BC", "7", "knee repair", "002.000", ""), (4, "BC", "6", "other", "", ""), (5, "ON", "Z1", "unrelated thing", "NOMAP", ""),
    ]]
    return spark.createDataFrame(rows, "record_id long, province string, fsc_code string, fsc_fn string, fsc_description string, fsc_section string, fsc_subsection string, fsc_chapter string, NGS_code string, NGS_label string")


def test_lookup_by_tokens(spark):
    api = lookup.Lookup(lookups(spark))
    got = [(r["rank"], r.record_id, r.sim_score, r.ngs_match, r.score_method) for r in api.search(" k040", "ON", "BC", 3).orderBy("rank").collect()]
    assert got == [(1, 3, 1.0, False, "jaccard"), (2, 2, 0.5, True, "jaccard"), (3, 1, 0.0, False, "jaccard")]
    assert api.search("missing", "ON", "BC").count() == 0
    assert [(r.record_id, r.sim_score) for r in api.search("Z1", "ON", "BC", 3).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0), (3, 0.0)]
    batch = api.search_batch(spark.createDataFrame([("ON", "k040"), ("ON", "Z1")], "province string, fsc_code string"), "BC", 3)
    assert sorted((r.anchor_id, r["rank"], r.record_id) for r in batch.collect()) == [(0, 1, 3), (0, 2, 2), (0, 3, 1), (5, 1, 1), (5, 2, 2), (5, 3, 3)]
    assert [r.record_id for r in api.fuzzy_search("KNEE", "BC").collect()] == [2, 3] and api.fuzzy_search("k", "BC", 0).count() == 0
    assert [r.province for r in api.provinces().collect()] == ["ON", "BC"] and api.all_codes_for_province("BC").count() == 4


def test_lookup_by_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.6, 0.8]), (4, [1.0, 0.0])], "record_id long, embedding array<float>")
    api = lookup.Lookup(lookups(spark), vectors)
    assert [(r.record_id, round(r.sim_score, 4)) for r in api.search("K040", "ON", "BC").orderBy("rank").collect()] == [(4, 1.0), (2, 0.6)]
    batch = api.search_batch(spark.createDataFrame([("ON", "k040"), ("ON", "none")], "province string, fsc_code string"), "BC", 2).orderBy("rank").collect()
    assert [(r.anchor_id, r.record_id, round(r.sim_score, 4)) for r in batch] == [(0, 4, 1.0), (0, 2, 0.6)]


def test_batch_by_vectors_in_blocks(spark, monkeypatch):
    import numpy as np
    from codeweave.operators import cells

    monkeypatch.setattr(cells, "BLOCK", 10)

    r = np.random.default_rng(3)
    x, y = r.normal(size=(7, 4)), r.normal(size=(50, 4)).round(1)
    frame = lambda m, name: spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())] + [(99, None)], f"{name} long, embedding array<double>")
    got = {(r.anchor_id, r["rank"]): r.record_id for r in lookup.batch_by_vectors(frame(x, "anchor_id"), frame(y, "record_id"), 3).collect()}
    assert got == {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(np.lexsort((np.arange(50), -(y @ x[i])))[:3])}


def test_windows(spark):
    p = spark.createDataFrame([("d", i, f"t{i}") for i in range(20) if i != 5] + [("e", 0, "only")], "doc string, page int, text string")
    w = pages.page_windows(p, "doc", "page")
    by = {}
    for r in w.collect():
        by.setdefault((r.doc, r.start), []).append(r.page)
    assert {k: (min(v), max(v)) for k, v in by.items()} == {("d", 0): (0, 7), ("d", 6): (6, 13), ("d", 12): (12, 19), ("d", 18): (18, 19), ("e", 0): (0, 0)}
    assert sorted(r.start for r in pages.windows_with_new_pages(w, "doc").filter("doc = 'd'").collect()) == [0, 6, 12]
    texts = {(r.doc, r.start): r.text for r in pages.window_texts(w, p, "doc", "page", "text").collect()}
    assert texts[("d", 18)] == "t18\nt19" and texts[("d", 0)].split("\n")[5] == ""


def test_first_codes(spark):
    df = spark.createDataFrame([("ON", " k040 ", 0), ("ON", "K040", 1), ("ON", "", 2), ("ON", None, 3)], "province string, fsc_code string, seq int")
    assert [(r.fsc_code, r.seq) for r in ingest.first_codes(df, ["seq"]).collect()] == [("K040", 0)]


def test_meta(spark):
    rows = [("n", "1", ""), ("n", None, ""), ("", None, "d"), ("", "1", "")]
    df = spark.createDataFrame([(*r, "c" * 40, "", "s", 3, None) for r in rows], "fsc_fn string, price string, fsc_description string, fsc_chapter string, fsc_section string, fsc_subsection string, page int, entry_x0 double")
    got = ingest.with_meta(df).collect()
    assert [r.fsc_confidence for r in got] == ["high", "medium", "low", "very_low"]
    assert got[0].fsc_rationale == "chapter: " + "c" * 35 + "; subsection: s; price: 1" and got[0].fsc_key_observations == "Page 3 | x0="


def test_tables_of_documents(spark):
    rows = [("a", "a", "b"), ("x", "x", "y"), ("", "", ""), ("p", "q", "q")]
    df = spark.createDataFrame([(1, [list(r) for r in rows])], "ord int, cells array<array<string>>")
    assert [dict(r.cells) for r in reference_docs.table_rows(df).orderBy("row_no").collect()] == [{"a": "x", "b": "y"}, {"a": "p", "b": "q"}]


def test_windowed_json(spark):
    raw = spark.createDataFrame([("ON", 0, '{"chapter":"C","codes":[{"fsc_code":"K1","section":"own"},{"fsc_code":"K2","chapter":""}]}'), ("ON", 6, "{broken")], "province string, start int, raw string")
    w = ingest.parsed_windows(raw)
    assert {r.start: len(r.codes) for r in w.collect()} == {0: 2, 6: 0}
    assert sorted((r.fsc_code, r.chapter, r.section) for r in ingest.window_codes(w).collect()) == [("K1", "C", "own"), ("K2", "C", "")]


def test_record_ids(spark):
    df = spark.createDataFrame([("YT", 1), ("ON", 2), ("BC", 1), ("ON", 1)], "province string, at int")
    assert [(r.record_id, r.province, r.at) for r in ingest.with_record_ids(df, ["at"]).orderBy("record_id").collect()] == [(0, "ON", 1), (1, "ON", 2), (2, "BC", 1), (3, "YT", 1)]


def test_export(spark):
    df = spark.createDataFrame([("K1", "ANCHOR", None, "ON", 3), ("K1", "MATCH", 0.25, "BC", None)], "anchor_code string, row_type string, sim_score double, province string, page int")
    got = ingest.export_rows(df, "2024-01-31").collect()
    assert got[0].asDict().keys() == dict.fromkeys(ingest.EXPORT).keys() and [r.sim_score for r in got] == ["1.000", "0.250"] and [r.page for r in got] == ["3", ""]


def test_packed_blocks_find_every_pair():
    """Blocks of sets of all sizes against all pairs of sets; a packed block takes half of its hashes' bytes at most."""
    import numpy as np
    from codeweave.functions import scores
    from codeweave.operators import blocks

    r = np.random.default_rng(3)
    hashes = r.integers(-(2**63), 2**63 - 1, 3000)
    pick = lambda n: hashes[np.unique((3000 * r.random(n) ** 3).astype(int))]
    left = [pick(int(n)) for n in r.integers(1, 90, 150)]
    right = [np.unique(np.concatenate([r.permutation(x)[: max(1, int(len(x) * r.uniform(0.3, 1)))], pick(int(r.integers(1, 60)))])) for x in left]
    packed = [blocks.pack(np.arange(len(x)), x) for x in (left, right)]
    i, k, score = blocks.meet(*(blocks.Block(p.iloc[0]) for p in packed), 0.55, scores.LOOKUP)
    x, y = (blocks.Block(p.iloc[0]) for p in packed)
    got = {(int(x.ids[a]), int(y.ids[b])): s for a, b, s in zip(i, k, score, strict=True)}
    want = {}
    for a, s in enumerate(left):
        for b, t in enumerate(right):
            n = len(np.intersect1d(s, t))
            if 0.4 * (n / (len(s) + len(t) - n)) + 0.6 * (n / len(s)) >= 0.55:
                want[a, b] = 0.4 * (n / (len(s) + len(t) - n)) + 0.6 * (n / len(s))
    assert got == want and len(want) > 100
    many = [pick(200) for _ in range(1000)]
    assert len(blocks.pack(np.arange(1000), many).loc[0, "cells"]) < sum(map(len, many)) * 4


def test_few_pairs_are_counted_whole(monkeypatch):
    """Sets that share frequent words only are not counted on their whole sets, and copies of a set are counted once; all pairs are found, some at a time."""
    import numpy as np
    from codeweave.functions import scores
    from codeweave.operators import blocks

    r = np.random.default_rng(11)
    frequent, rare = r.integers(-(2**63), 2**63 - 1, 60), r.integers(-(2**63), 2**63 - 1, 50_000)
    base = [np.unique(np.concatenate([r.choice(frequent, 40), r.choice(rare, int(n))])) for n in r.integers(60, 120, 300)]
    left = [base[i] for i in (*range(200), *[7] * 40)]
    right = [*base[150:], *[base[7]] * 30, *(np.append(base[i], rare[i]) for i in range(5))]
    counted, plain = [], blocks._common
    monkeypatch.setattr(blocks, "_common", lambda x, i, *rest: counted.append(len(i)) or plain(x, i, *rest))
    monkeypatch.setattr(blocks, "FOUND", 100)
    x, y = (blocks.Block(blocks.pack(np.arange(len(sets)), sets).iloc[0]) for sets in (left, right))
    parts = list(blocks.met(x, y, 0.55, scores.LOOKUP))
    got = {(int(x.ids[a]), int(y.ids[b])): score for part in parts for a, b, score in zip(*part, strict=True)}
    want = {}
    for a, s in enumerate(left):
        for b, t in enumerate(right):
            n = len(np.intersect1d(s, t))
            if 0.4 * (n / (len(s) + len(t) - n)) + 0.6 * (n / len(s)) >= 0.55:
                want[a, b] = 0.4 * (n / (len(s) + len(t) - n)) + 0.6 * (n / len(s))
    assert got == want and len(want) > 41 * 30 and sum(len(a) for a, _, _ in parts) == len(want)
    assert sum(counted) < 200 and len(parts) > 10 and max(len(a) for a, _, _ in parts) <= 100


def test_blocks_of_sizes_give_the_same_pairs(spark):
    """Many small blocks, one block, and the join by rarest tokens: the same pairs."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, r.choice(["ON", "BC", "YT"]), r.choice("ab"), r.sample(words[: r.choice([6, 40])], r.randint(0, 6))) for i in range(200)]
    records = spark.createDataFrame(rows, "record_id long, province string, bucket string, tokens array<string>")
    found = [sorted((*p[:4], round(p[4], 9)) for p in df.collect()) for df in (link.bucket_pairs(records), link.bucket_pairs_dense(records), link.bucket_pairs_dense(records, block=500))]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_blocks_meet_without_a_shuffle(spark):
    """Packed blocks aren't copied through a shuffle to the blocks opposite; pairs name their provinces, which the fold needs no join for."""
    import random

    r = random.Random(6)
    rows = [(i, r.choice(["ON", "BC", "YT"]), r.choice("ab"), r.sample([f"w{k}" for k in range(12)], r.randint(0, 6))) for i in range(120)]
    records = spark.createDataFrame(rows, "record_id long, province string, bucket string, tokens array<string>")
    pairs = link.bucket_pairs_dense(records, block=500, every_blank=False)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    where = {row[0]: row[1] for row in rows}
    assert all((p.left_prov, p.right_prov) == (where[p.left_id], where[p.right_id]) for p in pairs.collect())
    groups = [sorted(map(tuple, link.greedy_groups(p, records).collect())) for p in (pairs, link.bucket_pairs(records, every_blank=False))]
    assert groups[0] == groups[1] and len(groups[0]) > 50


def test_equal_sets_pair_by_rank(spark):
    """For the fold, copies of a set have a pair for each rank, not for each two of them; groups are those of all pairs."""
    import random

    r = random.Random(12)
    copies = [("ON", 30), ("BC", 20), ("YT", 25)]
    sets = [(p, ["w1", "w2", "w3"]) for p, n in copies for _ in range(n)] + [(r.choice(["ON", "BC", "YT"]), r.sample([f"w{k}" for k in range(6)], r.randint(0, 5))) for _ in range(40)]
    r.shuffle(sets)
    # in any order of its tokens a set is the same
    records = spark.createDataFrame([(i, p, "a", r.sample(t, len(t))) for i, (p, t) in enumerate(sets)], "record_id long, province string, bucket string, tokens array<string>")
    pairs = link.bucket_pairs_dense(records, block=800, every_blank=False)
    rows = pairs.collect()
    tokens = {i: frozenset(t) for i, (_, t) in enumerate(sets)}
    alike = [p for p in rows if tokens[p.left_id] == tokens[p.right_id] == {"w1", "w2", "w3"}]
    assert {p.score for p in alike} == {1.0} and len(alike) < 90
    assert all((p.score == 1.0) == (tokens[p.left_id] == tokens[p.right_id]) for p in rows if tokens[p.left_id])
    groups = [sorted(map(tuple, link.greedy_groups(p, records).collect())) for p in (pairs, link.bucket_pairs(records))]
    assert groups[0] == groups[1] and len(groups[0]) > 75


def test_bands_follow_what_is_undecided(spark, monkeypatch):
    """Bands begin small and grow while little of them is undecided; each stops reading at its scores, and no lists go to Python."""
    import random

    r = random.Random(13)
    records = spark.createDataFrame([(i, ["ON", "BC", "YT"][i % 3]) for i in range(120)], "record_id long, province string")
    rows = [("b", a, b, f"{a % 3}-{b % 3}", r.random()) for a in range(120) for b in range(120) if a % 3 < b % 3]
    pairs = spark.createDataFrame(rows, "bucket string, left_id long, right_id long, prov_pair string, score double")
    want = sorted(map(tuple, link.greedy_groups(pairs, records).collect()))
    undecided, plans, kinds, plain, store = [], [], [], link._fold_band, link.stored
    monkeypatch.setattr(link, "_fold_band", lambda *a: undecided.append((out := plain(*a))[2]) or out)
    monkeypatch.setattr(link, "stored", lambda df, name: (name == "link-band" and (plans.append(df._jdf.queryExecution().executedPlan().toString()), kinds.extend(k for _, k in df.dtypes))) and None or store(df, name))
    monkeypatch.setattr(link, "LEAST_BAND", 100)
    got = sorted(map(tuple, link.greedy_groups(pairs, records, last_pairs=300, bands=4).collect()))
    # of 4,800 pairs, a first band of a quarter would be undecided as a whole
    assert got == want and undecided[0] <= 400 and len(undecided) < 12 and max(undecided) <= 600
    assert all("PushedFilters: [IsNotNull(score)" in p and "ThanOrEqual(score," in p for p in plans) and not any("array" in k for k in kinds)


def test_parts_of_blocks_merge_into_the_block(monkeypatch):
    """Parts packed by several tasks, a few tokens at a time, hold what one block of all records holds, in less than half of its hashes' bytes."""
    import numpy as np
    import pyarrow as pa
    from codeweave.operators import blocks

    r = np.random.default_rng(7)
    hashes = r.integers(-(2**63), 2**63 - 1, 2000)
    sets = [np.unique(hashes[(2000 * r.random(int(n)) ** 3).astype(int)]) for n in r.integers(1, 300, 900)]
    kinds = pa.schema([("bucket", pa.string()), ("place", pa.int32()), ("province", pa.string()), ("block", pa.int32()), ("record_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    rows = [{"bucket": "a", "place": 1, "province": "ON", "block": i % 2, "record_id": i, "tokens": x.tolist()} for i, x in enumerate(sets)]
    batch = pa.RecordBatch.from_pylist(rows, kinds)
    monkeypatch.setattr(link, "PACK_TOKENS", 20_000)
    parts = pa.Table.from_batches(link._packed_parts(iter([batch.slice(0, 0), *(batch.slice(i, 100) for i in range(0, 900, 100))]))).to_pandas()
    assert len(parts) > 4 and sum(len(x) for c in ("ids", "vocabulary", "cells") for x in parts[c]) < 8 * sum(map(len, sets)) / 2
    for block, own in parts.groupby("block"):
        row = link._merged_block(("a", 1, "ON", block), own).iloc[0]
        ids = np.arange(block, 900, 2)
        assert (row["least"], row["most"]) == (min(len(sets[i]) for i in ids), max(len(sets[i]) for i in ids))
        one = blocks.Block(row)
        assert sorted(one.ids) == sorted(ids) and (np.diff(one.sizes) >= 0).all()
        for k, i in enumerate(one.ids):
            assert np.array_equal(np.sort(one.vocabulary[one.token[one.starts[k] : one.starts[k + 1]]]), sets[i])
        assert len(row["vocabulary"]) == 8 * len(np.unique(np.concatenate([sets[i] for i in ids])))
    assert not list(link._packed_parts(iter([])))


def test_token_sets_are_shuffled_packed(spark, monkeypatch):
    """The shuffle into blocks carries packed parts, not a record's tokens; without broadcasts by Spark's own estimate too."""
    import random

    r = random.Random(9)
    rows = [(i, r.choice(["ON", "BC", "YT"]), r.choice("ab"), r.sample([f"w{k}" for k in range(12)], r.randint(0, 6))) for i in range(120)]
    records = spark.createDataFrame(rows, "record_id long, province string, bucket string, tokens array<string>").repartition(5)
    plans, plain = {}, link.materialise
    monkeypatch.setattr(link, "materialise", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and plain(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = sorted((*p[:4], round(p[4], 9)) for p in link.bucket_pairs_dense(records, block=200).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plans["link-blocks"].split("\n")
    above = plan[: next((i for i, line in enumerate(plan) if "MapInArrow" in line), 0)]
    assert sum("Exchange hashpartitioning" in line for line in above) == 1 and "SortMergeJoin" not in plans["link-blocks"]
    assert found == sorted((*p[:4], round(p[4], 9)) for p in link.bucket_pairs(records).collect()) and len(found) > 100


def test_samples_shuffle_records_once(spark):
    """Groups of two to four records of several provinces; a province that is null counts as none, and records go through one shuffle."""
    rows = [("a", "ON", "1"), ("a", "BC", "2"), ("b", "ON", "3"), ("b", None, "4"), ("c", "ON", "5"), ("c", "ON", "6"), *(("d", p, "7") for p in "vwxyz"), ("e", "ON", "9"), ("e", "ON", "8"), ("e", "YT", "7")]
    got = link.sample_groups(spark.createDataFrame(rows, "top_key string, province string, fsc_code string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert [(r.top_key, r.n, r.provinces, [tuple(m) for m in r.members]) for r in got.collect()] == [("a", 2, 2, [("BC", "2"), ("ON", "1")]), ("e", 3, 2, [("ON", "8"), ("ON", "9"), ("YT", "7")])]
    assert dict(got.dtypes)["provinces"] == "bigint" and plan.count("Exchange hashpartitioning") == 1


def test_keys_are_numbered_without_tokens(spark, monkeypatch):
    """Single records are numbered and joined as narrow rows: their tokens have done their work in the pairs."""
    from codeweave.operators import records
    from codeweave.plans import queries

    seen, store = [], records.materialise
    monkeypatch.setattr(records, "materialise", lambda df, name: seen.append(df.columns) or store(df, name))
    assert queries.QUERIES["top_keys"](spark, "/root/testdata/sf0.001").count() == 200
    assert seen and not any("tokens" in columns for columns in seen)
