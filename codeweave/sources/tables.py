"""Schemas and scans of the datasets that the steps exchange: explicit types, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "text STRING, x0 DOUBLE, y0 DOUBLE, font_size DOUBLE, font STRING"
LAYOUT_PAGES = f"page INT, lines ARRAY<STRUCT<{LINE}>>"
OCR_PAGES = "index INT, markdown STRING"
FEE_CODES = (
    "province STRING, fsc_code STRING, fsc_fn STRING, fsc_chapter STRING, fsc_section STRING, fsc_subsection STRING, fsc_description STRING, fsc_notes STRING, fsc_others STRING, "
    "price STRING, page INT, entry_x0 DOUBLE"
)
NGS_CATEGORIES = "ngs_code STRING, ngs_label STRING, ngs_section STRING, ngs_description STRING"
ROLE_TABLES = "province STRING, role_code STRING, description STRING, ngs_codes ARRAY<STRING>, notes STRING"
EMBEDDINGS = "record_id BIGINT, province STRING, fsc_code STRING, embedding ARRAY<FLOAT>"


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def lines_of_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """One row a line of layout pages: the keys, page, line_no from 0, and the line's fields."""
    return pages.select(*keys, "page", F.posexplode("lines").alias("line_no", "l")).select(*keys, "page", "line_no", "l.*")


def layout_lines(spark: SparkSession, path: str, province: str) -> DataFrame:
    return lines_of_pages(read_array(spark, path, LAYOUT_PAGES).withColumn("province", F.lit(province)), "province")


def split_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row a line of a text column: the keys, line_no from 0, text."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "text"))


def write_array(df: DataFrame, path: str) -> None:
    """Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def union_sources(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by name; a column that a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
