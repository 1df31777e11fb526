"""From extracted page windows and documents to canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text
from .records import dedup_first, numbered

CODE_FIELDS = "fsc_code STRING, fsc_fn STRING, fsc_description STRING, price STRING, chapter STRING, section STRING"
WINDOW_RESULT = f"codes ARRAY<STRUCT<{CODE_FIELDS}>>, chapter STRING, section STRING"
MAX_PROMPT, MARKER = 24_000, "\n[TRUNCATED]"


def parsed_windows(raw: DataFrame, json: str = "raw") -> DataFrame:
    """raw with codes, chapter, section read from a JSON text; one that can't be read has no codes and blank headings."""
    parsed = F.from_json(F.col(json), WINDOW_RESULT, {"mode": "PERMISSIVE"})
    out = raw.withColumn("_p", parsed)
    empty = F.array().cast(f"ARRAY<STRUCT<{CODE_FIELDS}>>")
    return out.withColumns({"codes": F.coalesce("_p.codes", empty), "chapter": text.text_or_blank("_p.chapter"), "section": text.text_or_blank("_p.section")}).drop("_p")


def window_codes(windows: DataFrame) -> DataFrame:
    """One row a code of (province, start, codes, chapter, section), with the window's chapter and section where it has none."""
    c = windows.select("province", F.col("start").alias("page_start"), "chapter", "section", F.posexplode("codes").alias("pos", "c"))
    own = lambda f: F.coalesce(text.nonblank(f"c.{f}"), F.col(f)).alias(f)
    return c.select("province", "page_start", "pos", *[F.col(f"c.{f}").alias(f) for f in ("fsc_code", "fsc_fn", "fsc_description", "price")], own("chapter"), own("section"))


def normalised(codes: DataFrame, code: str = "fsc_code") -> DataFrame:
    """Canonical columns of extracted codes; rows whose code is empty before trimming go."""
    rows = codes.filter(text.nonblank(code).isNotNull())
    t = text.text_or_blank
    return rows.select(
        "province", text.canonical_code(F.col(code)).alias("fsc_code"), text.strip(t("fsc_fn")).alias("fsc_fn"), text.strip(t("chapter")).alias("fsc_chapter"), text.strip(t("section")).alias("fsc_section"),
        F.lit("").alias("fsc_subsection"), text.strip(t("fsc_description")).alias("fsc_description"), F.lit("").alias("fsc_notes"), F.lit("").alias("fsc_others"),
        text.strip(F.replace(t("price"), F.lit("$"), F.lit(""))).alias("price"), F.col("page_start").cast("int").alias("page"),
    )


def first_codes(codes: DataFrame, order: list[str]) -> DataFrame:
    """Codes of each province by their canonical form, the first of each; blank codes go."""
    keyed = codes.withColumn("fsc_code", text.canonical_code(F.col("fsc_code"))).filter("fsc_code <> ''")
    return dedup_first(keyed, ["province", "fsc_code"], order)


def with_meta(records: DataFrame) -> DataFrame:
    """Confidence, rationale and observations of each record."""
    t = text.text_or_blank
    piece = lambda name, c, size: F.when(t(c) != "", F.concat(F.lit(f"{name}: "), F.left(t(c), F.lit(size))))
    price = F.when(t("price") != "", F.concat(F.lit("price: "), F.col("price")))
    return records.withColumns({
        "fsc_rationale": F.concat_ws("; ", piece("chapter", "fsc_chapter", 35), piece("section", "fsc_section", 30), piece("subsection", "fsc_subsection", 25), price),
        "fsc_confidence": scores.record_confidence(F.col("fsc_fn"), F.col("price"), F.col("fsc_description")),
        "fsc_key_observations": F.concat(F.lit("Page "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(" | x0="), F.coalesce(F.col("entry_x0").cast("string"), F.lit(""))),
    })


def with_record_ids(records: DataFrame, order: list[str], provinces: tuple[str, ...] = ("ON", "BC", "YT")) -> DataFrame:
    """record_id from 0 in order of province (the known ones first) and `order`."""
    place = F.array_position(F.array(*map(F.lit, provinces)), F.col("province"))
    placed = records.withColumn("_place", F.when(place == 0, 99).otherwise(place))
    return numbered(placed, [], ["_place", "province", *order], "record_id").select("record_id", *records.columns)


EXPORT = [
    "anchor_code", "row_type", "sim_score", "score_method", "province", "fsc_code", "fsc_fn", "fsc_chapter", "fsc_section", "fsc_subsection", "fsc_description", "price", "fsc_rationale", "fsc_confidence",
    "page", "fsc_key_observations", "fsc_notes", "fsc_others", "NGS_code", "NGS_label", "NGS_rationale", "NGS_confidence", "NGS_key_observations", "NGS_notes", "NGS_other", "map_date",
]


def export_rows(found: DataFrame, map_date: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """The 26 text columns of an export, from rows with row_type ANCHOR or MATCH, sim_score, and the record's columns; and those named in `beside` as they are."""
    score = F.when(F.col("row_type") == "ANCHOR", "1.000").otherwise(F.when(F.col("sim_score").isNotNull(), F.format_string("%.3f", "sim_score")).otherwise(""))
    have = found.withColumn("map_date", F.lit(map_date))
    columns = [score.alias(c) if c == "sim_score" else (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have.columns else F.lit("")).alias(c) for c in EXPORT]
    return have.select(*columns, *beside)
