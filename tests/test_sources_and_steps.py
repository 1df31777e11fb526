import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from codeweave.plans import steps, xlsx
from codeweave.operators import ingest, reference_docs
from codeweave.sources import clients, docx, pdf, tables
from codeweave.streaming import ingest as streaming

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style=None):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def write_docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')


@pytest.fixture
def body(spark, tmp_path):
    write_docx(
        tmp_path / "a.docx",
        paragraph("Consultations", "H1") + paragraph("intro") + paragraph("001.000 Major consultation") + paragraph("long") + paragraph("text") + paragraph("002.000 Consultation") + paragraph("Surgery", "H1") + paragraph("lost")
        + paragraph("043.000 Appendectomy") + paragraph("Ontario") + paragraph("The fee code has a role code NGS 073.000 for surgical assistance")
        + table(("Role Code", "Role Code", "Description", "Notes"), ("B", "B", "assist", "see 073.000"), ("", "", "", "")) + paragraph("British Columbia", "H1")
        + table(("CCP Modifier", "Description", "NGS Category"), ("A1", "some", "001.000 or 002.000")) + table(("FSC Code", "Fee Code"), ("A001B", "A001")) + table(("x", "y"), ("1", "2")),
    )
    docx.register(spark)
    return spark.read.format("docx_body").load(str(tmp_path / "a.docx"))


def test_docx(body):
    got = reference_docs.categories(body).orderBy("ord").collect()
    assert [(r.ngs_code, r.ngs_label, r.ngs_section) for r in got] == [("001.000", "Major consultation", "Consultations"), ("002.000", "Consultation", "Consultations"), ("043.000", "Appendectomy", "Surgery")]
    assert got[0].ngs_description == "long text" and got[1].ngs_description == ""
    routed = reference_docs.routed_tables(body)
    assert [(r.province, r.role_code, r.ngs_codes) for r in reference_docs.role_tables(routed).collect()] == [("ON", "B", ["073.000"])]
    assert [(r.province, r.ccp_code, r.ngs_codes) for r in reference_docs.ccp_map(routed).collect()] == [("BC", "A1", ["001.000", "002.000"])]
    assert [(r.province, r.trigger) for r in reference_docs.example_rules(routed).collect()] == [("BC", "FSC=A001B => fee=A001 role=")]
    rules = {(r.province, r.rule_type, tuple(r.ngs_codes)) for r in reference_docs.province_rules(body).collect()}
    assert rules == {("ALL", "role_code", ("073.000",)), ("ON", "fsc_structure", ())}


def fake_pdf(path, first, last):
    for page in range(first, last + 1):
        yield page, 0, 0, 0, f"{path} {page}", 1.0, 2.0, 9.0, "f"


def test_pdf(spark, monkeypatch):
    pdf.register(spark)
    import sys
    import types

    module = types.ModuleType("fake_pdf_backend")
    module.spans = fake_pdf
    monkeypatch.setitem(sys.modules, "fake_pdf_backend", module)
    reader = pdf.PdfSpans({"path": "f", "pages": "7", "per_partition": "3", "backend": "fake_pdf_backend:spans"}).reader(None)
    parts = reader.partitions()
    assert [p.value for p in parts] == [("f", 1, 3), ("f", 4, 6), ("f", 7, 7)] and [r[4] for p in parts for r in reader.read(p)] == [f"f {i}" for i in range(1, 8)]


def test_retries():
    calls, pauses = [], []

    def failing(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return x + 1

    assert clients.with_retries(failing, sleep=pauses.append)(1) == 2 and pauses == [10.0, 20.0]
    calls.clear()
    with pytest.raises(OSError):
        clients.with_retries(failing, attempts=2, sleep=pauses.append)(1)


def test_clients(spark):
    todo = spark.createDataFrame([("ON", i) for i in range(10)], "province string, page int")
    got = clients.read_pages(todo.repartition(1), lambda province, numbers: [f"{province}{n}/{len(numbers)}" for n in numbers]).collect()
    assert {r.page: r.markdown for r in got}[0] == "ON0/8" and len(got) == 10
    texts = spark.createDataFrame([("ON", 0, "x" * 30_000), ("ON", 6, "bad")], "province string, start int, text string")
    out = clients.extract_windows(texts, lambda prompt: json.dumps({"codes": [{"fsc_code": str(len(prompt))}]}) if prompt != "bad" else "no json").collect()
    assert {r.start: [c.fsc_code for c in r.codes] for r in out} == {0: [str(24_000 + len(ingest.MARKER))], 6: []}
    v = clients.embed(spark.createDataFrame([(1, "a b"), (2, None)], "record_id long, text string"), "text").collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-6 and len(v) == 2


def test_scans(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"page": 3, "lines": [{"text": "a", "x0": 1.5}, {"text": "b"}]}]))
    got = tables.layout_lines(spark, str(tmp_path / "p.json"), "ON").collect()
    assert [(r.province, r.page, r.line_no, r.text, r.x0) for r in got] == [("ON", 3, 0, "a", 1.5), ("ON", 3, 1, "b", None)]


def test_steps(spark, tmp_path, body):
    root = str(tmp_path / "root")
    rows = [("ON", 1, 0, "K040 Ambulance transfer 5.00", 43.0, 12.0), ("BC", 1, 0, "00158 Ambulance transfer", 70.0, 10.0), ("YT", 1, 0, "0615 Appendectomy", 40.0, 9.0)]
    spark.createDataFrame(rows, "province string, page int, line_no int, text string, x0 double, font_size double").write.parquet(f"{root}/layout_lines")
    body.write.parquet(f"{root}/docx_body")
    first = steps.run(spark, root)
    assert first == {"parse": "done", "parse-codes": "waiting", **dict.fromkeys(("categories", "roles", "ccp", "rules", "map", "link", "embed", "export"), "done")}
    assert set(steps.run(spark, root).values()) == {"skipped", "waiting"} and steps.run(spark, root, force=True, only=["link"]) == {"link": "done"}
    linked = {r.fsc_code: r for r in spark.read.parquet(f"{root}/linked").collect()}
    assert spark.read.parquet(f"{root}/export_rows").columns == ingest.EXPORT and set(spark.read.parquet(f"{root}/embeddings").columns) == {"record_id", "province", "fsc_code", "embedding"}
    assert linked["0615"].NGS_code == "043.000" and linked["K040"].price == "5.00" and linked["K040"].top_key.startswith("NOMAP_ON_")


def test_two_documents(spark, tmp_path):
    """Files are worked on side by side: each table has its own file's province and rows, and the first category of a code is the first file's."""
    table_of = lambda role: table(("Role Code", "Description", "Notes"), (role, "assist", "see 073.000"))
    write_docx(tmp_path / "a.docx", paragraph("Consultations", "H1") + paragraph("001.000 First") + paragraph("Ontario") + table_of("B"))
    write_docx(tmp_path / "b.docx", paragraph("Other", "H1") + paragraph("more") + paragraph("001.000 Second") + paragraph("Yukon") + table_of("C") + paragraph("002.000 Only") + paragraph("tail"))
    docx.register(spark)
    body = spark.read.format("docx_body").load(f"{tmp_path}/a.docx,{tmp_path}/b.docx")
    roles = reference_docs.role_tables(reference_docs.routed_tables(body)).collect()
    assert sorted((r.province, r.role_code) for r in roles) == [("ON", "B"), ("YT", "C")]
    got = {r.ngs_code: (r.ngs_label, r.ngs_section, r.ngs_description) for r in reference_docs.categories(body).collect()}
    assert got == {"001.000": ("First", "Consultations", "Ontario"), "002.000": ("Only", "Other", "tail")}


def test_high_pages_and_the_choice_of_source(spark, tmp_path):
    """Line order holds on page 5000, and the layout makes fee_codes with and without force where both inputs are there."""
    root = str(tmp_path / "root")
    rows = [("ON", page, 0, f"K040 Page {page} {page}.00", 43.0, 12.0) for page in (800, 9)] + [("BC", 5000, 0, "00158 Far", 70.0, 10.0), ("BC", 4999, 5, "00158 Near", 70.0, 10.0)]
    spark.createDataFrame(rows, "province string, page int, line_no int, text string, x0 double, font_size double").write.parquet(f"{root}/layout_lines")
    raw = [("ON", 0, 0, "z1", "From pages", "", "", "", "")]
    spark.createDataFrame(raw, "province string, page_start int, pos int, fsc_code string, fsc_fn string, fsc_description string, price string, chapter string, section string").write.parquet(f"{root}/raw_codes")
    for force in (False, True):
        done = steps.run(spark, root, force)
        assert done["parse"] == "done" and done["parse-codes"] == "waiting"
        assert {(r.fsc_code, r.page, r.fsc_fn) for r in spark.read.parquet(f"{root}/fee_codes").collect()} == {("K040", 9, "Page 9"), ("00158", 4999, "Near")}
    said = []
    assert steps.run(spark, root, True, ["parse", "parse-codes"], "pages", say=said.append) == {"parse": "waiting", "parse-codes": "done"}
    assert [r.fsc_fn for r in spark.read.parquet(f"{root}/fee_codes").collect()] == ["From pages"] and "'raw': 1" in said[0]


def test_page_path_as_steps(spark, tmp_path):
    import types

    root = str(tmp_path / "root")
    spark.createDataFrame([("ON", 7), ("BC", 3)], "province string, n int").write.parquet(f"{root}/page_counts")
    gone = str(tmp_path / "gone")
    services = types.SimpleNamespace(
        read=lambda province, numbers: [f"{province} K{n:03d}" for n in numbers], delete=lambda province: open(gone, "a").write(province) and 1 / 0,
        extract=lambda prompt: json.dumps({"codes": [{"fsc_code": w, "fsc_fn": "name"} for w in prompt.split() if w.startswith("K")]}),
    )
    done = steps.run(spark, root, services=services, provinces=["ON"])
    assert done["read"] == done["extract"] == done["parse-codes"] == "done" and done["repair"] == "0 windows again" and open(gone).read() == "ON"
    assert spark.read.parquet(f"{root}/fee_codes").filter("province = 'ON'").count() == 7
    assert "read" not in steps.run(spark, root, services=services, skip_ocr=True) and spark.read.parquet(f"{root}/ocr_pages").count() == 7


def test_workbook(spark):
    df = spark.createDataFrame([("K1", "ANCHOR", None, "ON", True), ("K1", "MATCH", 0.25, "BC", False)], "anchor_code string, row_type string, sim_score double, province string, same boolean")
    data = xlsx.workbook(ingest.export_rows(df.coalesce(1), "2024-01-31"))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "1.000" in sheet and "0.250" in sheet and 'ref="A1:Z3"' in sheet


def test_stream(spark, tmp_path):
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    os.makedirs(src)
    for n, pages in enumerate(([0, 1], [1, 2])):
        with open(f"{src}/{n}.json", "w") as f:
            f.writelines(json.dumps({"province": "ON", "page": p, "markdown": f"m{n}"}) + "\n" for p in pages)
        q = streaming.start(spark, src, table, mark, availableNow=True)
        q.awaitTermination(60)
    assert {(r.page, r.markdown) for r in spark.read.parquet(table).collect()} == {(0, "m0"), (1, "m0"), (2, "m1")}


def test_workbooks_from_executors(spark, tmp_path):
    """A file for each group of anchors, written by tasks; a failed job leaves none."""
    from codeweave.sources import workbook

    workbook.register(spark)
    path = str(tmp_path / "books")
    rows = [(a, k, "ANCHOR" if not k else "MATCH", 0.5 if k else None, "BC" if k else "ON", k == 1, f"K{a} <&> {k}") for a in range(7) for k in range(3)]
    df = spark.createDataFrame(rows, "anchor_id long, rank int, row_type string, sim_score double, province string, ngs_match boolean, anchor_code string").repartition(5)
    workbook.write(df, f"file://{path}", "2024-01-31", anchors_a_file=3)
    files = sorted(f for f in os.listdir(path) if f.endswith(".xlsx"))
    assert files == ["group-000000.xlsx", "group-000001.xlsx", "group-000002.xlsx"] and not [f for f in os.listdir(path) if f not in files and f != "_SUCCESS"]
    seen = []
    for f in files:
        with zipfile.ZipFile(f"{path}/{f}") as z:
            assert z.testzip() is None
            sheet = z.read("xl/worksheets/sheet1.xml").decode()
        import xml.etree.ElementTree as ET

        cells = [[c.findtext(".//{*}t") for c in r] for r in ET.fromstring(sheet).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")]
        assert cells[0] == xlsx.TITLES and f'ref="A1:Z{len(cells)}"' in sheet
        seen += [(c[0], c[1], c[2]) for c in cells[1:]]
    assert seen == [(f"K{a} <&> {k}", "ANCHOR" if not k else "MATCH", "1.000" if not k else "0.500") for a in range(7) for k in range(3)]
    with pytest.raises(Exception):
        bad = df.withColumn("anchor_code", F.when(F.col("anchor_id") == 6, F.raise_error(F.lit("stop"))).otherwise(F.col("anchor_code")))
        workbook.write(bad, f"file://{path}2", "2024-01-31", anchors_a_file=3)
    assert not [f for f in (os.listdir(path + "2") if os.path.isdir(path + "2") else []) if f.endswith(".xlsx")]


def test_docx_bodies_from_any_file_system(spark, tmp_path):
    """Two files of a folder, read through Spark's own file source."""
    from codeweave.sources import docx

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:r><w:t>text {name}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    got = docx.bodies(spark, f"file://{tmp_path}").collect()
    assert sorted((os.path.basename(r.file), r.ord, r.kind, r.text) for r in got) == [("a.docx", 0, "p", "text a"), ("a.docx", 1, "tbl", None), ("b.docx", 0, "p", "text b"), ("b.docx", 1, "tbl", None)]
    assert {str(r.cells) for r in got if r.kind == "tbl"} == {"[['cell']]"}


def pages_backend(path, first, last):
    for page in range(first, last + 1):
        yield page, 0, 0, 0, f"{os.path.basename(path)} {page}", 1.0, 2.0, 9.0, "f"


def test_pdf_page_ranges_are_pushed_down(spark, tmp_path):
    from codeweave.sources import pdf

    pdf.register(spark)
    df = spark.read.format("pdf_spans").option("path", "x.pdf,y.pdf").option("backend", "tests.test_sources_and_steps:pages_backend").option("pages", "100,40").option("per_partition", 10).load()
    assert df.rdd.getNumPartitions() == 14
    some = df.filter("page >= 35 and page < 52")
    assert some.rdd.getNumPartitions() == 3
    assert sorted((r.text, r.page) for r in some.select("text", "page").collect()) == sorted([(f"x.pdf {p}", p) for p in range(35, 52)] + [(f"y.pdf {p}", p) for p in range(35, 41)])
    assert sorted(r.page for r in df.filter("page = 7").collect()) == [7, 7]


def test_counts_come_from_the_writing_job(spark, tmp_path, body):
    """What steps tell is observed while they write; only the groups' sizes are read again."""
    root, said = str(tmp_path / "root"), {}
    rows = [("ON", 1, 0, "K040 Ambulance transfer 5.00", 43.0, 12.0), ("ON", 1, 1, "K041", 43.0, 12.0), ("BC", 1, 0, "00158 Ambulance transfer", 70.0, 10.0)]
    spark.createDataFrame(rows, "province string, page int, line_no int, text string, x0 double, font_size double").write.parquet(f"{root}/layout_lines")
    body.write.parquet(f"{root}/docx_body")
    steps.run(spark, root, say=lambda line: said.__setitem__(*line.split(": ", 1)))
    assert eval(said["parse"]) == {"ON": {"raw": 2, "missing_fn": 1, "missing_price": 1, "unique_codes": 2}, "BC": {"raw": 1, "missing_fn": 0, "missing_price": 1, "unique_codes": 1}}
    mapped = eval(said["map"])
    assert mapped["total"] == sum(mapped["methods"].values()) == 3 and eval(said["embed"]) == {"rows": 3} and "groups" in said["link"]


def test_vectors_are_read_again(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "record_id long, embedding array<float>")
    steps._whole_vectors(good, {"rows": 2})
    for bad, n in ((good, 3), (good.union(spark.createDataFrame([(3, [1.0])], good.schema)), 3)):
        with pytest.raises(ValueError):
            steps._whole_vectors(bad, {"rows": n})
