from codeweave.operators import layout, records
from pyspark.sql import functions as F

ON = [
    ("CONSULTATIONS AND VISITS", 170, 18), ("FAMILY PRACTICE", 43, 12), ("K040", 43, 12), ("Group counselling per unit", 70, 12), ("72.90", 400, 12), ("Note: maximum one", 70, 12), ("second line", 70, 12), ("6", 390, 12),
    ("# S207 Appendectomy.......... 12.34", 32, 12),
]


def lines(spark, province, rows, page=200):
    return spark.createDataFrame([(province, page, i, t, float(x) if x is not None else None, float(s) if s else None) for i, (t, x, s) in enumerate(rows)], "province string, page int, line_no int, text string, x0 double, font_size double")


def parsed(df):
    return {r.fsc_code: r for r in layout.post_process(layout.parse_layout(df)).collect()}


def test_on(spark):
    got = parsed(lines(spark, "ON", ON))
    k, s = got["K040"], got["S207"]
    assert k.fsc_chapter == s.fsc_chapter == "A – Consultations and Visits" and k.fsc_section == s.fsc_section == "FAMILY PRACTICE"
    assert (k.fsc_fn, k.price, k.fsc_notes, k.fsc_description) == ("Group counselling per unit", "72.90", "Note: maximum one", "second line")
    assert (s.fsc_fn, s.price) == ("Appendectomy", "12.34")
    assert parsed(lines(spark, "ON", ON, page=829)) == {}


def test_on_margin_line_fills_the_name_and_keeps_waiting(spark):
    """The margin line names the record; the indented one after it goes to the description without its price."""
    got = parsed(lines(spark, "ON", [("K041", 43, 12), ("Margin name", 50, 12), ("Indented text 9.99", 70, 12), ("More 8.88", 70, 12), ("lead", 20, 12)]))["K041"]
    assert (got.fsc_fn, got.fsc_description, got.price) == ("Margin name", "Indented text More 8.88 lead", None)
    got = parsed(lines(spark, "ON", [("K042", 43, 12), ("Indented text 9.99", 70, 12), ("5.00", 360, 12), ("margin", 50, 12)]))["K042"]
    assert (got.fsc_fn, got.fsc_description, got.price) == ("Indented text", "margin", "9.99")


def test_on_drops(spark):
    rows = [("stray before any code", 70, 12), ("K043 Name", 43, 12), ("May 2024", 70, 12), ("2024 (effective", 70, 12), ("GP8", 70, 12), ("NOT ALLOCATED", 70, 12), ("A SECTION HEADING", 40, 12), ("after the heading", 70, 12)]
    got = parsed(lines(spark, "ON", rows))
    assert set(got) == {"K043"} and got["K043"].fsc_description == "" and got["K043"].fsc_section == ""


def test_bc(spark):
    rows = [
        ("Medical Services Commission Diagnostic", 60, 9), ("Big Section", 70, 12), ("(A) Sub", 90, 10), ("00158 ", 70, 10), ("First line 42.50", 120, 10), ("small note", 120, 9), ("i) item", 120, 10), ("more", 120, 10),
        ("1-2", 70, 10), ("Anes.", 300, 10), ("T1234 Named 5.00", 70, 10), ("77.00", 420, 10), ("Next Section", 70, 11), ("lost", 120, 10), ("B00001 x", 81, 10),
    ]
    got = parsed(lines(spark, "BC", rows))
    assert set(got) == {"00158", "T1234"} and got["T1234"].price == "5.00"
    # a code between 80 and 82 is taken as a sub-section, and lines after a section heading belong to no record
    assert got["T1234"].fsc_description == ""


def test_bc_records(spark):
    rows = [("Medical Services Commission Diagnostic", 60, 9), ("Big Section", 70, 12), ("(A) Sub", 90, 10), ("00158 ", 70, 10), ("First line 42.50", 120, 10), ("small note", 120, 9), ("i) item", 120, 10), ("more", 120, 10), ("77.00", 420, 10)]
    got = parsed(lines(spark, "BC", rows))["00158"]
    assert (got.fsc_fn, got.price, got.fsc_notes, got.fsc_description) == ("First line", "42.50", "small note i) item", "more")
    assert (got.fsc_chapter, got.fsc_section, got.fsc_subsection) == ("Diagnostic", "Big Section", "(A) Sub")


def test_yt(spark):
    rows = [
        ("Chapter One", 40, 16), ("ALL CAPS", 50, 10), ("Sub title:", 50, 10), ("0615", 40, 9), ("Name 4.50", 95, 9), ("1. a note", 95, 9), ("text", 95, 9), ("33.00", 360, 9), ("Page 12", 95, 9), ("0616 Other $1.00", 40, 9),
        ("Chapter Two", 40, 16), ("0617 Third", 40, 9),
    ]
    got = parsed(lines(spark, "YT", rows))
    a = got["0615"]
    assert (a.fsc_chapter, a.fsc_section, a.fsc_subsection, a.fsc_notes, a.fsc_description) == ("Chapter One", "ALL CAPS", "Sub title", "1. a note", "text")
    assert (a.fsc_fn, a.price) == ("Name", "33.00")  # the name keeps its price until post-processing, when there is one already
    assert (got["0616"].fsc_fn, got["0616"].price) == ("Other", "1.00")
    assert (got["0617"].fsc_chapter, got["0617"].fsc_section, got["0617"].fsc_subsection) == ("Chapter Two", "", "")


def test_dedup(spark):
    rows = [("ON", "K040", "", None, "c1", 0), ("ON", "K040", "x", "1.00", "c2", 1), ("ON", "K040", "y", "2.00", "c3", 2)]
    df = spark.createDataFrame(rows, "province string, code string, fn string, price string, chapter string, at int")
    assert tuple(records.dedup_coalesce(df, ["province", "code"], "at", ["fn", "price"]).select("fn", "price", "chapter").first()) == ("x", "1.00", "c1")
    assert records.dedup_first(df, ["province", "code"], ["at"]).first().chapter == "c1"


def test_spans(spark):
    rows = [(1, 0, 0, 0, " ", 1.0, 2.0, 9.0, "f0"), (1, 0, 0, 1, "Vis", 5.126, 2.0, 10.0, "f1"), (1, 0, 0, 2, "it", 9.0, 2.0, 12.0, "f2"), (1, 0, 1, 0, "  ", 1.0, 2.0, 9.0, "f")]
    got = layout.spans_to_lines(spark.createDataFrame(rows, "page int, block int, line int, span int, text string, x0 double, y0 double, size double, font string")).collect()
    assert [(r.text, r.x0, r.font_size, r.font) for r in got] == [("Visit", 5.13, 12.0, "f1")]


def test_carry_forward_resets(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, ""), (3, None), (4, "b")], "n int, e string").withColumn("g", F.lit(1))
    assert [r.v for r in df.select("n", records.carried(F.col("e"), ["g"], ["n"]).alias("v")).orderBy("n").collect()] == ["a", "a", "", "", "b"]


def test_ranges_of_pages_give_the_rows_of_one_pass(spark):
    """A document of eight pages, cut into eight ranges, three and one: records, names, prices and headings go on across them."""
    import random

    r = random.Random(8)
    kinds = {
        "ON": [("K%03d Title", 43, 12), ("K%03d", 43, 12), ("text here 4.50", 70, 12), ("Note: one", 70, 12), ("margin words", 50, 12), ("9.99", 400, 12), ("BIG CHAPTER WORDS", 100, 18), ("SMALL HEADING", 40, 12)],
        "BC": [("%05d Title", 70, 10), ("%05d", 70, 10), ("text here 4.50", 120, 10), ("i) item", 120, 10), ("small", 120, 9), ("77.00", 450, 10), ("Medical Services Commission Diagnostic", 60, 9), ("A Section", 70, 12), ("Sub", 100, 10)],
        "YT": [("%04d Title", 40, 9), ("%04d", 40, 9), ("text here 4.50", 95, 9), ("note a", 95, 9), ("5.00", 400, 9), ("HUGE", 50, 14), ("UPPER HEAD", 50, 9), ("Sub head:", 50, 9)],
    }
    rows = []
    for province, choices in kinds.items():
        for page in range(8):
            for line in range(r.choice([1, 2, 3, 12])):
                text, x0, size = r.choices(choices, [1, 1, 5, 3, 2] + [1] * (len(choices) - 5))[0]
                rows.append((province, page, line, text % r.randint(0, 999) if "%" in text else text, float(x0), float(size)))
    df = spark.createDataFrame(rows, "province string, page int, line_no int, text string, x0 double, font_size double")
    whole = sorted(map(repr, layout.parse_layout(df, range_pages=100).collect()))
    assert len(whole) > 10
    for pages in (1, 3):
        assert sorted(map(repr, layout.parse_layout(df, range_pages=pages).collect())) == whole


def test_windows_hold_one_range_or_summaries(spark):
    """No window is partitioned by the document alone but the scan over summaries."""
    df = lines(spark, "ON", ON)
    plan = layout._parts(layout.classify_on(layout._prepared(df, 12)), ["province"], 2)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("rng" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in windows)


def test_a_document_key_and_page_may_be_null(spark):
    df = lines(spark, "ON", ON).withColumn("file", F.lit(None).cast("string")).withColumn("page", F.lit(None).cast("int"))
    df = df.withColumn("province", F.lit("BC")).unionByName(df)
    got = layout.parse_layout(df, ["file", "province"]).filter("province = 'ON'").collect()
    assert got == [] or {r.file for r in got} == {None}
    df = lines(spark, "ON", ON).withColumn("file", F.lit(None).cast("string"))
    assert {r.fsc_code for r in layout.parse_layout(df, ["file", "province"]).collect()} == {"K040", "S207"}


def test_texts_only_where_they_are_used(spark):
    """Bodies are made for body lines alone, and only these and code lines take theirs further."""
    rows = [("BC", 1, i, *x) for i, x in enumerate([("00100 Visit 12.00", 70.0, 10.0), ("NOTE: one", 120.0, 10.0), ("İ) two", 120.0, 10.0), ("IV) three", 120.0, 10.0), ("A Section", 70.0, 12.0)])]
    df = spark.createDataFrame(rows, "province string, page int, line_no int, text string, x0 double, font_size double")
    got = layout.classify_bc(layout._prepared(df, 10)).orderBy("line_no").collect()
    assert [(r.kind, r.body, r.rest) for r in got] == [("code", None, "Visit 12.00"), ("body", "NOTE: one", None), ("body", "İ) two", None), ("body", "IV) three", None), ("close", None, None)]
    assert [(r.note, r.can_name) for r in got[1:4]] == [(True, False), (False, True), (True, True)]
