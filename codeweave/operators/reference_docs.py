"""Reference documents (ordered paragraphs and tables) to dimension tables: sections, categories, routed tables, province rules.

A document's parts have `file` and `ord`, their order in it; a body without `file` is one document. Everything is carried, joined
and numbered within a file, so files are worked on side by side. `ord` of a result is (file, ord) or (file, ord, row_no), an
order over all files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from .records import carried, dedup_first, ordered_concat, segment


def by_file(body: DataFrame) -> DataFrame:
    return body if "file" in body.columns else body.withColumn("file", F.lit(""))


def adjacent_dedup(cells: Column) -> Column:
    """An array without elements equal to the one before them."""
    return F.filter(cells, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(cells, i - 1)))


def header_map(header: Column, row: Column) -> Column:
    """Cells by header; the shorter side decides, and of equal headers the last wins."""
    n = F.least(F.size(header), F.size(row))
    pairs = F.arrays_zip(F.slice(header, F.lit(1), n).alias("k"), F.slice(row, F.lit(1), n).alias("v"))
    last = F.filter(pairs, lambda p, i: F.array_position(F.reverse(F.transform(pairs, lambda q: q["k"])), p["k"]) == F.size(pairs) - i)
    return F.map_from_entries(last)


def table_rows(tables: DataFrame) -> DataFrame:
    """(file, ord, row_no, cells): rows of (file, ord, cells array<array<string>>) by their headers; the header row and blank rows apart."""
    rows = by_file(tables).select("file", "ord", F.transform("cells", adjacent_dedup).alias("cells")).filter("size(cells) > 0")
    rows = rows.select("file", "ord", F.col("cells")[0].alias("header"), F.posexplode("cells").alias("row_no", "row")).filter("row_no > 0 and exists(row, c -> c <> '')")
    return rows.select("file", "ord", "row_no", header_map(F.col("header"), F.col("row")).alias("cells"))


def table_kind(headers: Column) -> Column:
    """ccp, role or fsc, the first that a header names; null for other tables."""
    has = lambda *words: F.exists(headers, lambda h: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(h), w)), True))
    return rules.first_hit([(has("ccp", "modifier"), F.lit("ccp")), (has("role"), F.lit("role")), (has("fsc"), F.lit("fsc"))], F.lit(None).cast("string"))


def sections(paragraphs: DataFrame, heading: Column, opens: str, by: Sequence[str] = ("file",)) -> DataFrame:
    """Ordered paragraphs (by, ord, text) to rows (by, ord, section, code, label, description); by names one document.

    A heading ends the open row and names the section; text of the form `opens` (groups: code, label) opens a row; other text is
    added to the open row's description. Text without an open row is dropped.
    """
    p = paragraphs.withColumn("_heading", heading).withColumn("_opens", ~F.col("_heading") & F.col("text").rlike(opens))
    order = ["ord"]
    p = p.withColumn("section", carried(F.when(F.col("_heading"), F.col("text")), by, order)).withColumn("_seg", segment(F.col("_heading") | F.col("_opens"), by, order))
    first = F.col("_opens")
    rows = p.groupBy(*by, "_seg").agg(
        F.max(F.when(first, F.regexp_extract("text", opens, 1))).alias("code"), F.max(F.when(first, F.regexp_extract("text", opens, 2))).alias("label"), F.max("section").alias("section"),
        ordered_concat(F.when(~first & ~F.col("_heading"), F.col("text")), F.col("ord")).alias("description"), F.min("ord").alias("ord"),
    )
    return rows.filter("code is not null").select(*by, "ord", "section", "code", "label", "description")


#: How a category row opens.
CATEGORY_OPENS = r"^(\d{3}\.\d{3})\s+(.*)$"


def categories(body: DataFrame) -> DataFrame:
    """ngs_code, ngs_label, ngs_section, ngs_description, ord from document paragraphs (file, ord, style, text); the first of each code."""
    p = by_file(body).filter("kind = 'p'").withColumn("text", text.norm(text.text_or_blank("text"))).filter("text <> ''")
    rows = sections(p, F.col("style").startswith("Heading"), CATEGORY_OPENS)
    first = dedup_first(rows, ["code"], ["file", "ord"])
    return first.selectExpr("code as ngs_code", "label as ngs_label", "section as ngs_section", "description as ngs_description", "struct(file, ord) as ord")


def with_province(body: DataFrame) -> DataFrame:
    """Document parts (file, ord, kind, text, ...) with the province that the last heading before them in their file names, ALL before any."""
    named = rules.first_hit([(F.col("text") == k, F.lit(v)) for k, v in rules.PROVINCE_HEADINGS.items()], F.lit(None).cast("string"))
    parts = by_file(body).withColumn("text", text.norm(text.text_or_blank("text")))
    event = F.when(F.col("kind") == "p", named)
    return parts.withColumn("names_province", event.isNotNull()).withColumn("province", carried(event, ["file"], ["ord"], "ALL"))


#: What marks a paragraph as a rule on how codes are built.
STRUCTURE_WORDS = ["fsc code", "fee code", "leading zero", "role code", "first four", "first three", "fifth digit", "padded"]


def province_rules(body: DataFrame) -> DataFrame:
    """province, rule_type, trigger, ngs_codes, detail of the paragraphs: roles for all provinces, structure of codes for one."""
    p = with_province(body).filter("kind = 'p' and text <> '' and not names_province and not startswith(coalesce(style, ''), 'Heading')")
    low, ngs = F.lower("text"), text.named_category_codes(F.col("text"))
    none = F.array().cast("array<string>")
    structure = low.rlike("|".join(STRUCTURE_WORDS))
    made = F.filter(F.array(
        F.when(low.contains("surgical assistance"), F.struct(F.lit("ALL").alias("province"), F.lit("role_code").alias("rule_type"), F.lit("surgical assistance role code").alias("trigger"), ngs.alias("ngs_codes"))),
        F.when(low.rlike("anesthesia|anaesthesia") & (F.size(ngs) > 0), F.struct(F.lit("ALL").alias("province"), F.lit("role_code").alias("rule_type"), F.lit("anesthesia role code").alias("trigger"), ngs.alias("ngs_codes"))),
        F.when(structure, F.struct(F.col("province").alias("province"), F.lit("fsc_structure").alias("rule_type"), F.left("text", F.lit(80)).alias("trigger"), none.alias("ngs_codes"))),
    ), lambda r: r.isNotNull())
    return p.select(F.struct("file", "ord").alias("ord"), F.col("text").alias("detail"), F.explode(made).alias("r")).select("r.*", "detail", "ord")


def routed_tables(body: DataFrame) -> DataFrame:
    """(file, ord, row_no, province, kind, cells): the rows of the tables that are of a known kind."""
    at = ["file", "ord"]
    place = with_province(body).filter("kind = 'tbl'").select(*at, "province")
    rows = table_rows(body.filter("kind = 'tbl'")).join(place, at)
    kinds = rows.groupBy(*at).agg(table_kind(F.map_keys(F.min_by("cells", "row_no"))).alias("kind"))
    return rows.join(kinds.filter("kind is not null"), at).select(*at, "row_no", "province", "kind", "cells")


def _row_order() -> Column:
    """A table row's place in the order over all files."""
    return F.struct("file", "ord", "row_no").alias("ord")


def _cell(*names: str) -> Column:
    return F.coalesce(*[text.nonblank(F.col("cells").getItem(n)) for n in names], F.lit(""))


def ccp_map(routed: DataFrame) -> DataFrame:
    r = routed.filter("kind = 'ccp'").select(_row_order(), "province", _cell("CCP Modifier", "CCP modifier").alias("code"), _cell("Description", "Provincial Modifier and Notes", "Provincial Modifier").alias("desc"), _cell("NGS Category", "NGS Category.1").alias("raw"))
    r = r.withColumn("ngs_codes", text.category_codes(F.col("raw"))).filter("code <> '' and (size(ngs_codes) > 0 or desc <> '')")
    return r.select("ord", "province", text.norm(F.col("code")).alias("ccp_code"), text.norm(F.col("desc")).alias("ccp_desc"), "ngs_codes", text.norm(F.col("raw")).alias("raw_ngs"))


def role_tables(routed: DataFrame) -> DataFrame:
    """province, role_code, description, ngs_codes, notes and ord, the order in which the last row of a role wins."""
    code, desc, notes = _cell("Role Code"), _cell("Description"), _cell("Notes")
    r = routed.filter("kind = 'role'").withColumn("_c", code).filter("_c <> ''")
    return r.select("province", text.norm(F.col("_c")).alias("role_code"), text.norm(desc).alias("description"), text.category_codes(F.concat(notes, F.lit(" "), desc)).alias("ngs_codes"), text.norm(notes).alias("notes"), _row_order())


def example_rules(routed: DataFrame) -> DataFrame:
    fsc, fee, role = _cell("FSC Code"), _cell("Fee Code"), _cell("Role Code")
    r = routed.filter("kind = 'fsc'").filter((fsc != "") | (fee != ""))
    trigger = F.concat(F.lit("FSC="), fsc, F.lit(" => fee="), fee, F.lit(" role="), role)
    return r.select("province", F.lit("fsc_example").alias("rule_type"), trigger.alias("trigger"), F.array().cast("array<string>").alias("ngs_codes"), F.to_json("cells").alias("detail"), _row_order())
