import io
import zipfile

import numpy as np
import pytest
from codeweave.operators import cells, ingest, lookup, substrings
from pyspark.sql import functions as F

ROWS = [
    (0, "ON", "A001", "Knee arthroplasty revision", "001.000", "Knees"), (1, "ON", "A002", "Hip arthroplasty", "001.000", ""), (2, "BC", "101", "arthroplasty of the knee", "001.000", ""),
    (3, "BC", "102", "Revision of hip", "002.000", ""), (4, "BC", "a001", "Unrelated", "NOMAP", ""), (5, "YT", "2001", "Knee", "", ""), (6, "ON", "a001", "later duplicate", "009.000", ""),
]


def records(spark):
    df = spark.createDataFrame(ROWS, "record_id long, province string, fsc_code string, fsc_fn string, NGS_code string, NGS_label string")
    return df.withColumns({c: F.lit("") for c in ("fsc_description", "fsc_section", "fsc_subsection", "fsc_chapter")})


def categories(spark):
    return spark.createDataFrame([("001.000", "Old name", "old", 0), ("001.000", "Joints", "All joints", 1), ("002.000", "Hips", None, 2)], "ngs_code string, ngs_label string, ngs_description string, ord int")


def test_codes_are_sorted(spark):
    assert [r.fsc_code for r in lookup.Lookup(records(spark)).all_codes_for_province("BC").collect()] == ["101", "102", "a001"]


@pytest.mark.parametrize("query, province, want", [
    ("arthro", None, [0, 1, 2]), ("ARTHRO", "ON", [0, 1]), ("a0", None, [0, 1, 4, 6]), ("  ", None, []), ("", "ON", []), ("A001", None, [0, 4, 6]), (" knee ", "BC", [2]), ("nowhere", None, []), ("of ", None, [2, 3]), ("revision of", None, [3]),
])
def test_fuzzy_search_by_scan_and_by_index(spark, query, province, want):
    api = lookup.Lookup(records(spark))
    assert [r.record_id for r in api.fuzzy_search(query, province).collect()] == want
    assert [r.record_id for r in lookup.search_text(records(spark), query, province).collect()] == want
    assert [r.record_id for r in api.fuzzy_search(query, province, 2).collect()] == want[:2]


def test_index_verifies_a_few_candidates_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(substrings, "AT_ONCE", 3)
    names = [f"{'abcd' if i % 3 else 'bcdabc'} x{i}" for i in range(60)] + [None, "𝔘ni abcd", "ABCDE"]
    df = spark.createDataFrame([(i, "ON", "K1", n) for i, n in enumerate(names)], "record_id long, province string, fsc_code string, fsc_fn string")
    index = substrings.SubstringIndex.build(df)
    for q in ("abcd", "cda", "𝔘ni", "bcdabc x3", "k1"):
        want = [r.record_id for r in lookup.search_text(df, q, None, 25).collect()]
        assert [r.record_id for r in index.search(q, None, 25).collect()] == want and want
    assert index.candidates("cda").count() < 25
    scan = index.postings.filter(F.col("gram").isin("cda"))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in scan or "EqualTo(gram" in scan


def test_category_of_the_anchor(spark):
    one = lookup.Lookup(records(spark), categories=categories(spark)).search("a001", "ON", "BC").first()
    assert (one.anchor_code, one.anchor_label, one.anchor_description) == ("A001", "Joints", "All joints")
    assert lookup.Lookup(records(spark)).search("A001", "ON", "BC").first().anchor_label == "Knees"
    assert lookup.Lookup(records(spark), categories=categories(spark)).search("2001", "YT", "BC").first().anchor_label == ""
    assert lookup.Lookup(records(spark)).search("A009", "ON", "BC").count() == 0


def test_an_anchor_without_a_vector_is_an_error(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in (0, 2, 3)], "record_id long, embedding array<double>")
    api = lookup.Lookup(records(spark), vectors)
    assert [r.record_id for r in api.search("A001", "ON", "BC").collect()] == [2, 3]
    for missing in (lambda: api.search("A002", "ON", "BC"), lambda: api.search_batch(spark.createDataFrame([("ON", "A002")], "province string, fsc_code string"), "BC")):
        with pytest.raises(LookupError):
            missing()
    assert api.search("Z", "ON", "BC").count() == 0
    assert lookup.top_by_vectors(spark.createDataFrame([(None,)], "embedding array<double>"), vectors).count() == 0


def test_export_of_searches(spark):
    api = lookup.Lookup(records(spark), categories=categories(spark))
    anchors = spark.createDataFrame([("ON", " a002"), ("ON", "A001"), ("ON", "none")], "province string, fsc_code string")
    rows = api.export(anchors, "BC", 2).orderBy("anchor_id", "rank").collect()
    assert [(r.anchor_code, r.row_type, r["rank"], r.record_id) for r in rows] == [("A001", "ANCHOR", 0, 0), ("A001", "MATCH", 1, 2), ("A001", "MATCH", 2, 3), ("A002", "ANCHOR", 0, 1), ("A002", "MATCH", 1, 2), ("A002", "MATCH", 2, 3)]
    shown = ingest.export_rows(api.export(anchors, "BC", 2).orderBy("anchor_id", "rank"), "2024-01-31").collect()
    assert shown[0].sim_score == "1.000" and shown[1].sim_score == f"{rows[1].sim_score:.3f}" and {r.score_method for r in shown} == {"jaccard"} and rows[1].ngs_match and not rows[2].ngs_match


@pytest.mark.parametrize("clusters, n, block", [(12, 5, 4096), (3, 7, 40), (400, 3, 4096)])
def test_cells_against_brute_force(spark, monkeypatch, clusters, n, block):
    """Vectors in clusters, many equal ones, some anchors far from all; ties by id. Cells drop out where vectors are clustered."""
    monkeypatch.setattr(cells, "CELL_ROWS", 10)
    monkeypatch.setattr(cells, "BLOCK", block)
    r = np.random.default_rng(clusters)
    x = (r.normal(size=(clusters, 8)) * 5)[r.integers(0, clusters, 600)] + 0.05 * r.normal(size=(600, 8))
    x[100:180] = x[100]
    q = np.concatenate([x[:30] + 0.01 * r.normal(size=(30, 8)), r.normal(size=(10, 8)), np.zeros((1, 8)), x[100:101]])
    to = lambda m, key: spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())] + [(10_000, None)], f"{key} long, embedding array<double>")
    index = cells.VectorCells.build(to(x, "record_id"))
    found, visited = index.search(to(q, "anchor_id").filter("embedding is not null"), n)
    got = {}
    for row in found.orderBy("anchor_id", "rank").collect():
        got.setdefault(row.anchor_id, []).append((row.record_id, row.sim_score))
    for i, v in enumerate(q):
        s = x @ v
        best = np.lexsort((np.arange(len(x)), -s.round(9)))[:n]
        assert np.allclose([y for _, y in got[i]], s[best]) and len({k for k, _ in got[i]}) == n
        assert {k for k, y in got[i] if y > s[best[-1]] + 1e-9} == {int(k) for k in best if s[k] > s[best[-1]] + 1e-9}
    seen = sum(r.visited for r in visited.collect())
    assert seen <= len(q) * len(index.centres)
    if clusters == 12:
        assert seen < 0.5 * len(q) * len(index.centres)


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([], "record_id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "anchor_id long, embedding array<double>")
    assert lookup.batch_by_vectors(some, none).count() == 0
    assert lookup.batch_by_vectors(some.limit(0), none.union(spark.createDataFrame([(1, [1.0, 0.0])], none.schema))).count() == 0
    assert [tuple(r) for r in lookup.batch_by_vectors(some, none.union(spark.createDataFrame([(7, [1.0, 0.5])], none.schema))).collect()] == [(1, 7, 2.0, 1)]


def test_substring_index_reads_records_once(spark, tmp_path):
    """Postings are written by the tasks that read the records, in runs sorted by gram, with every gram of code and name in the search's case."""
    from codeweave.operators import substrings

    names = ["Ab\x00c", "Élan 中文字", "\U0001d400bcd", None, "ab", "abab"]
    records = spark.createDataFrame([(i, "ON", f"k{i}9", n) for i, n in enumerate(names)], "record_id long, province string, fsc_code string, fsc_fn string").coalesce(1)
    index = substrings.SubstringIndex.build(records)
    want = {(g, i) for i, n in enumerate(names) for x in (f"K{i}9", (n or "").lower()) for g in (x[j : j + 3] for j in range(len(x) - 2))}
    rows = [(r.gram, r.record_id) for r in index.postings.collect()]
    assert set(rows) == want and len(rows) == len(want) and [r[0] for r in rows] == sorted(r[0] for r in rows)
    assert [r.record_id for r in index.search("文字").collect()] == [1] and [r.record_id for r in index.search("BAB").collect()] == [5]
    codes = substrings.gram_codes("xabcabc")
    assert substrings.gram_texts(codes) == ["xab", "abc", "bca", "cab", "abc"]


def test_single_precision_travels_as_it_is(spark):
    """Vectors of floats stay floats in cells and visits; scores are in double precision all the same."""
    from codeweave.operators.cells import VectorCells

    rows = [(i, [0.1 * i, 1.0 / (i + 1)]) for i in range(30)]
    e = spark.createDataFrame(rows, "record_id long, embedding array<float>")
    wide = e.withColumn("embedding", F.col("embedding").cast("array<double>"))
    cells = VectorCells.build(e)
    anchors = e.withColumnRenamed("record_id", "anchor_id")
    assert cells.rows.schema["embedding"].dataType.simpleString() == cells._visits(anchors, 3, True).schema["embedding"].dataType.simpleString() == "array<float>"
    want = VectorCells.build(wide).search(wide.withColumnRenamed("record_id", "anchor_id"), 3)[0]
    assert sorted(cells.search(anchors, 3)[0].collect()) == sorted(want.collect())
