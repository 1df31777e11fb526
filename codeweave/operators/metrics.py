"""Counts that the steps report, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank, text_or_blank


def method_breakdown(mapped: DataFrame) -> DataFrame:
    """Records by match method, `none` where blank."""
    return mapped.groupBy(F.coalesce(nonblank("match_method"), F.lit("none")).alias("match_method")).agg(F.count("*").alias("n"))


def confidence_columns() -> dict[str, Column]:
    """Aggregates: high, medium, low (very low included), unassigned and all records."""
    c, code = F.col("NGS_confidence"), text_or_blank("NGS_code")
    return {"high": F.count_if(c == "high"), "medium": F.count_if(c == "medium"), "low": F.count_if(c.isin("low", "very_low")), "unassigned": F.count_if(code == ""), "total": F.count("*")}


def confidence_summary(mapped: DataFrame) -> DataFrame:
    """One row of the confidence_columns."""
    return mapped.agg(*[c.alias(name) for name, c in confidence_columns().items()])


def quality_counts(records: DataFrame) -> DataFrame:
    """By province: raw and unique codes, records without name and without price."""
    return records.groupBy("province").agg(
        F.count("*").alias("raw"), F.count_distinct("fsc_code").alias("unique_codes"), F.count_if(text_or_blank("fsc_fn") == "").alias("missing_fn"), F.count_if(text_or_blank("price") == "").alias("missing_price"),
    )


def codes_per_window(codes: DataFrame, by: str = "province") -> DataFrame:
    return codes.filter("page_start is not null").groupBy(by, F.col("page_start").alias("start")).agg(F.count("*").alias("n"))
