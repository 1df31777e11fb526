"""Positioned lines of fee schedules to records: each province's line classes as CASE columns, the parser's state as windows.

Lines: province, page, line_no, text, x0, font_size (further columns pass unused). A line is of one kind:
code (opens a record), close (heading that ends one), chapter and sub (headings that don't), price, body (continues an
open record) or none. Records are the segments between code and close lines; lines before the first or after a close belong to none.

The parser's state (headings, open record) goes from one range of pages to the next by a segmented prefix scan: ranges are reduced to
parts of records, one summary a range says what it leaves open, and an exclusive scan over the summaries what lay open before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from .graph import materialise
from .records import ordered_concat, up_to_now

#: The first page of the ON indexes.
ON_INDEX_PAGE = 829
#: How lines with a code begin.
ON_CODE, ON_HASH = r"^([A-Z]\d{3,5})\b", r"^#\s+([A-Z]\d{3,5})\b"
BC_CODE, YT_CODE = r"^([A-Z]{0,2}\d{4,6})\b", r"^(\d{4,6})\b"
#: Lines that are no part of the schedule.
ON_SKIP = r"^(Amd|February|March|April|May|June|July|August|September|October|November|December|NOT ALLOCATED)\b|^\d{4}\s*\(effective"
YT_SKIP = r"^(These fees|YHCIP|YWCHSB|Anes|or Proc|Code|Page \d+)"
#: A line that is an amount, and how notes begin.
PRICE_ONLY = r"^\$?\d{1,6}\.\d{2}$"
ON_NOTE = r"^(payment ?rules?|\[?commentary|note:|\d+\.|[a-z]\.|claims ?submission)"
BC_NOTE = r"^(note|(i{1,4}v?|vi{0,3}|ix|x{0,3})\)|\d+\))"
YT_NOTE = r"^(note|\d+\.|[a-z]\.)"
ORDER = ("page", "line_no")
HEADINGS = ("chapter", "section", "sub")
#: Pages of a range.
RANGE_PAGES = 16
FIELDS = ["province", "fsc_code", "fsc_fn", "fsc_chapter", "fsc_section", "fsc_subsection", "fsc_description", "fsc_notes", "fsc_others", "price", "page", "entry_x0"]


def before_index(lines: DataFrame, first_page: int = ON_INDEX_PAGE) -> DataFrame:
    """Lines before the back-of-book index; a plain comparison, so it reaches the scan."""
    return lines.filter(F.col("page") < first_page)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, computed once however often they are used: they come out of a generator, which nothing is pushed through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _prepared(lines: DataFrame, default_size: float) -> DataFrame:
    zero = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(float(d)))
    lines = lines.withColumn("x0", zero("x0", 0)).withColumn("size", zero("font_size", default_size)).withColumnRenamed("text", "_raw")
    return _once(lines, text=text.clean(text.text_or_blank("_raw"))).drop("_raw").filter("text <> ''")


def _mostly_upper(letters: Column | str) -> Column:
    return F.coalesce(text.upper_share(letters) > 0.80, F.lit(False))


def _classified(lines: DataFrame, kind: Column, after: Column) -> DataFrame:
    """Lines with their kind; body lines with their body, code lines with the rest, which follows the code. Others need neither."""
    only = lambda which, c: F.when(F.col("kind") == which, c)
    return _once(_once(lines, kind=kind), body=only("body", text.strip_leaders(F.col("text"))), rest=only("code", text.strip(after)))


def _opened(code: Column) -> Column:
    rest = F.col("rest")
    return F.when(F.col("kind") == "code", F.struct(code.alias("code"), text.without_price(rest).alias("title"), text.price_at_end(rest).alias("price"))).alias("opened")


def classify_on(lines: DataFrame) -> DataFrame:
    t, x, size = F.col("text"), F.col("x0"), F.col("size")
    hashed, plain = (x < 45) & t.rlike(ON_HASH), (x < 60) & t.rlike(ON_CODE)
    heading = ~t.rlike(ON_CODE) & ~t.rlike(ON_HASH) & (F.length(t) > 4) & _mostly_upper(text.letters(t)) & (F.size(F.split(t, " ")) <= 18)
    kind = rules.first_hit([
        (t.rlike(ON_SKIP), F.lit("none")), (hashed | plain, F.lit("code")), (t.rlike(r"^[A-Z]{1,3}\d+\s*$"), F.lit("none")), ((x > 85) & (size >= 14) & heading, F.lit("chapter")),
        ((x < 65) & (size >= 10) & heading, F.lit("close")), ((x > 350) & t.rlike(PRICE_ONLY), F.lit("price")), ((x > 380) & t.rlike(r"^\d{1,2}$"), F.lit("none")),
    ], F.lit("body"))
    after = F.when(hashed, text.strip_leaders(F.regexp_replace(t, ON_HASH, ""))).otherwise(F.regexp_replace(t, ON_CODE, ""))
    code = F.when(hashed, F.regexp_extract(t, ON_HASH, 1)).otherwise(F.regexp_extract(t, ON_CODE, 1))
    note = F.lower("body").rlike(ON_NOTE)
    return _classified(before_index(lines), kind, after).select(
        "*", _opened(code), note.alias("note"), ((x >= 60) & ~note).alias("can_name"), ((x < 60) & ~note).alias("margin"), F.lit(True).alias("splits"),
    ).withColumns({"chapter_event": F.when(F.col("kind") == "chapter", rules.on_chapter(t)), "section_event": F.when(F.col("kind") == "close", t), "sub_event": F.lit(None).cast("string")})


def classify_bc(lines: DataFrame) -> DataFrame:
    t, x, size = F.col("text"), F.col("x0"), F.col("size")
    header = (x < 82) & t.contains("Medical Services Commission")
    kind = rules.first_hit([
        (t.rlike(r"^\d+-\d+$") | t.isin("$", "Anes.", "Level", "Anes"), F.lit("none")), (header, F.lit("chapter")), ((x > 400) & t.rlike(PRICE_ONLY), F.lit("price")), ((size > 10.4) & (x < 82), F.lit("close")),
        ((x > 80) & (x < 115) & (size >= 9.5), F.lit("sub")), ((x > 60) & (x < 82) & (size > 9.5) & (size < 10.4) & t.rlike(BC_CODE), F.lit("code")), (x > 115, F.lit("body")),
    ], F.lit("none"))
    small = size < 9.7
    note = small | F.col("body").rlike(f"(?i){BC_NOTE}")  # no other letter's lower case is one of these
    k = F.col("kind")
    return _classified(lines, kind, F.regexp_replace(t, BC_CODE, "")).select(
        "*", _opened(F.regexp_extract(t, BC_CODE, 1)), note.alias("note"),
        (~small & ~F.col("body").rlike("(?i)^note")).alias("can_name"), F.lit(False).alias("margin"), F.lit(True).alias("splits"),
    ).withColumns({
        "chapter_event": F.when(k == "chapter", rules.first_contained(t, [(c, c) for c in rules.BC_CHAPTERS])), "section_event": F.when(k == "close", t),
        "sub_event": F.when(k == "close", F.lit("")).when(k == "sub", t),
    })


def classify_yt(lines: DataFrame) -> DataFrame:
    t, x, size, upper = F.col("text"), F.col("x0"), F.col("size"), F.col("upper")
    # the letters' cases count nowhere else
    lines = _once(_once(lines, letters=F.when((x <= 55) & (size <= 12), text.letters(t))), upper=_mostly_upper("letters"))
    sub = (x <= 55) & (size <= 12) & ~t.rlike(YT_CODE) & t.rlike(r"\p{L}") & (upper | t.endswith(":"))
    kind = rules.first_hit([
        (t.rlike(YT_SKIP), F.lit("none")), ((x > 350) & t.rlike(PRICE_ONLY), F.lit("price")), (size >= 14, F.lit("close")), (sub, F.lit("close")),
        (x.between(35, 80) & (size < 11) & t.rlike(YT_CODE), F.lit("code")), (x >= 90, F.lit("body")),
    ], F.lit("none"))
    note = F.lower("body").rlike(YT_NOTE)
    closing, big, label = F.col("kind") == "close", size >= 14, F.rtrim(t, F.lit(":"))
    return _classified(lines, kind, F.regexp_replace(t, YT_CODE, "")).select(
        "*", _opened(F.regexp_extract(t, YT_CODE, 1)), note.alias("note"),
        (~note).alias("can_name"), F.lit(False).alias("margin"), F.lit(False).alias("splits"),
    ).withColumns({
        "chapter_event": F.when(closing & big, t), "section_event": F.when(closing & big, F.lit("")).when(closing & upper, label),
        "sub_event": F.when(closing & (big | upper), F.lit("")).when(closing, label),
    })


def _parts(lines: DataFrame, by: Sequence[str], range_pages: int) -> DataFrame:
    """Classified lines to parts: what one record has in one range of pages (`rng`). Ranges are worked on side by side.

    seg names the record by its boundary line; null where the boundary lies before the range. chapter, section and sub are null where
    the range has no event yet.
    """
    lines = lines.filter("kind <> 'none'").withColumn("text", F.when(F.col("kind") == "price", F.col("text"))).withColumn("rng", F.floor(F.coalesce("page", F.lit(-1)) / range_pages))
    here = up_to_now([*by, "rng"], ORDER)
    last = lambda e: F.last_value(e, ignoreNulls=F.lit(True)).over(here)
    boundary = F.when(F.col("kind").isin("code", "close"), F.struct(*ORDER, (F.col("kind") == "code").alias("is_code")))
    lines = lines.select("*", last(boundary).alias("seg"), last(F.col("chapter_event")).alias("chapter"), last(F.col("section_event")).alias("section"), last(F.col("sub_event")).alias("sub"))
    body = (F.col("kind") == "body") & F.coalesce(F.col("seg.is_code"), F.lit(True))
    first = lambda when, *values: F.min(F.when(when, F.struct(*ORDER, *values)))
    province = [] if "province" in by else ["province"]
    return lines.groupBy(*by, "rng", "seg").agg(
        F.max(F.when(F.col("kind") == "code", F.struct(*ORDER, "opened", "x0", "chapter", "section", "sub", *province))).alias("head"),  # one code line a record
        first(body & F.col("can_name"), "body", "splits").alias("waited"), first(body & F.col("margin") & text.nonblank("body").isNotNull(), "body").alias("margin"),
        first(F.col("kind") == "price", F.ltrim(F.col("text"), F.lit("$")).alias("price")).alias("amount"),
        F.collect_list(F.when(body, F.struct(*ORDER, "note", "body"))).alias("texts"), F.max(F.struct(*ORDER, "chapter", "section", "sub")).alias("last"),
    )


def _before(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The state before each range (open record, headings), from an exclusive scan over one summary a range."""
    summaries = parts.groupBy(*by, "rng").agg(F.max("seg").alias("seg"), F.max("last").alias("last"))
    w = Window.partitionBy(*by).orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last_value(c, ignoreNulls=F.lit(True)).over(w)
    return summaries.select(*[F.col(c).alias(f"_{c}") for c in [*by, "rng"]], last("seg").alias("_seg"), F.struct(*[last(f"last.{c}").alias(c) for c in HEADINGS]).alias("_headings"))


def _records(lines: DataFrame, by: Sequence[str], range_pages: int) -> DataFrame:
    """Classified lines to records: parts of each range, what lies open before it, and the parts of one record together."""
    parts = materialise(_parts(lines, by, range_pages), "layout-parts")
    on = F.lit(True)
    for c in [*by, "rng"]:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    parts = parts.join(_before(parts, by), on).withColumn("seg", F.coalesce("seg", "_seg")).filter("seg.is_code")
    headings = [F.coalesce(f"head.{c}", f"_headings.{c}", F.lit("")).alias(c) for c in HEADINGS]
    # a record's first part has its code line
    head = F.max(F.when(F.col("head").isNotNull(), F.struct("head", *headings))).alias("h")
    r = parts.groupBy(*by, "seg").agg(head, *[F.min(c).alias(c) for c in ("waited", "margin", "amount")], F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts"))
    place = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ORDER])
    title = F.col("h.head.opened.title")
    # the line that a pending name waits for, and lines at the margin, which may name the record too
    r = r.withColumns({"waited": F.when(title == "", F.col("waited")), "margin": F.when(title == "", F.col("margin"))})
    r = r.withColumn("value", F.when(F.col("waited.splits"), text.without_price(F.col("waited.body"))).otherwise(F.col("waited.body")))
    unnamed = F.col("waited").isNotNull() & (F.col("margin").isNull() | (place("waited") < place("margin")))
    by_waited = unnamed & text.nonblank("value").isNotNull()
    r = r.withColumns({"name": F.when(by_waited, F.col("value")).otherwise(F.col("margin.body")), "named_at": F.when(by_waited, place("waited")).when(F.col("margin").isNotNull(), place("margin"))})
    split_off = F.when(unnamed & F.col("waited.splits"), text.price_at_end(F.col("waited.body")))
    after = F.least("amount", F.when(split_off.isNotNull(), F.struct("waited.page", "waited.line_no", split_off.alias("price"))))
    at = lambda x: F.struct(*[x[c] for c in ORDER])
    is_waited = lambda x: F.coalesce(F.col("waited").isNotNull() & at(x).eqNullSafe(place("waited")), F.lit(False))
    is_name = lambda x: F.coalesce(F.col("named_at").isNotNull() & at(x).eqNullSafe(F.col("named_at")), F.lit(False))
    joined = lambda keep, value: F.array_join(F.filter(F.transform(F.filter("texts", keep), value), lambda v: v != ""), " ")
    return r.select(
        *[c for c in by if c not in FIELDS], *([] if "province" in by else [F.col("h.head.province").alias("province")]), *[c for c in by if c in FIELDS], F.col("h.head.opened.code").alias("fsc_code"),
        F.coalesce(text.nonblank(title), F.col("name"), F.lit("")).alias("fsc_fn"), F.col("h.chapter").alias("fsc_chapter"), F.col("h.section").alias("fsc_section"), F.col("h.sub").alias("fsc_subsection"),
        joined(lambda x: (~x["note"] | is_waited(x)) & ~is_name(x), lambda x: F.when(is_waited(x), F.col("value")).otherwise(x["body"])).alias("fsc_description"),
        joined(lambda x: x["note"] & ~is_waited(x), lambda x: x["body"]).alias("fsc_notes"), F.lit("").alias("fsc_others"), F.coalesce("h.head.opened.price", after["price"]).alias("price"),
        F.col("h.head.page").alias("page"), F.col("h.head.x0").alias("entry_x0"), F.col("h.head.line_no").alias("line_no"),
    ).select(*[c for c in by if c not in FIELDS], *FIELDS, "line_no")


def parse_layout(lines: DataFrame, by: Sequence[str] = ("province",), range_pages: int = RANGE_PAGES) -> DataFrame:
    """Records of all provinces' lines (ON, BC, YT; others give none), with line_no. by: columns that name one document.

    A document is cut into ranges of pages that are worked on side by side: windows hold the lines of one range, or one summary for
    each range of a document.
    """
    of = lambda p: F.col("province") == p
    on = _records(classify_on(_prepared(lines.filter(of("ON")), 12)), by, range_pages).withColumn("fsc_subsection", F.lit(""))
    bc = _records(classify_bc(_prepared(lines.filter(of("BC")), 10)), by, range_pages)
    yt = _records(classify_yt(_prepared(lines.filter(of("YT")), 9)), by, range_pages)
    return on.unionByName(bc).unionByName(yt)


def post_process(records: DataFrame) -> DataFrame:
    """A price that ends the name moves out of it, chapters get their usual names, and all texts are trimmed."""
    ends = rf"{text.SPACE}+\$?(\d{{1,6}}\.\d{{2}}){text.SPACE}*$"
    found = text.nonblank(F.regexp_extract("fsc_fn", ends, 1))
    out = records.withColumn("price", F.when(found.isNotNull(), F.coalesce(text.nonblank("price"), found)).otherwise(F.col("price")))
    out = out.withColumn("fsc_fn", F.when(found.isNotNull(), F.btrim(F.regexp_replace("fsc_fn", ends, ""), F.lit(" ."))).otherwise(F.col("fsc_fn")))
    out = out.withColumn("fsc_chapter", rules.renamed_chapter(F.col("fsc_chapter")))
    return out.withColumns({c: text.strip(F.col(c)) for c in ("fsc_fn", "fsc_description", "fsc_notes", "fsc_others", "fsc_section", "fsc_subsection", "fsc_chapter")})


def spans_to_lines(spans: DataFrame, by: Sequence[str] = ("page", "block", "line")) -> DataFrame:
    """Text spans to lines: non-blank spans joined as they are; place and font of the first, size of the largest."""
    spans = spans.filter(text.strip(text.text_or_blank("text")) != "")
    at = F.col("span")
    out = spans.groupBy(*by).agg(
        ordered_concat(F.col("text"), at, "").alias("text"), F.round(F.min_by("x0", at), 2).alias("x0"), F.round(F.min_by("y0", at), 2).alias("y0"),
        F.round(F.max("size"), 2).alias("font_size"), F.min_by("font", at).alias("font"),
    )
    return out.withColumn("text", text.strip(F.col("text")))
