"""Sequence operators over ordered lines: carried values, segments, ordered concatenation, first values, de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import nonblank
from .graph import materialise


def up_to_now(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(event: Column, by: Sequence[str], order: Sequence[str], default: str = "") -> Column:
    """The last non-null event up to the row; an event that resets carries an empty string."""
    return F.coalesce(F.last_value(event, ignoreNulls=F.lit(True)).over(up_to_now(by, order)), F.lit(default))


def segment(boundary: Column, by: Sequence[str], order: Sequence[str]) -> Column:
    """The number of boundaries up to the row: rows between two boundaries share it."""
    return F.sum(boundary.cast("int")).over(up_to_now(by, order))


def ordered_concat(value: Column, order: Column, sep: str = " ") -> Column:
    """Aggregate: the non-blank values joined in order."""
    rows = F.sort_array(F.collect_list(F.when(nonblank(value).isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


def first_in_order(value: Column, order: Column) -> Column:
    """Aggregate: the first non-null value in order."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with `name`, the row's number from 0 within `by` in the given order, which must name a unique order.

    Rows are dealt by ranges of (by, order); a range's first number follows from the counts of those before it, so no key's rows
    are gathered: a window holds one range of one key, or one count for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    keys = ", ".join(by) or "0"
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = counts.selectExpr(*[f"{c} as _k_{c}" for c in [*by, "_part"]], f"sum(_n) over (partition by {keys} order by _part) - _n as _before")
    on = F.lit(True)
    for c in [*by, "_part"]:
        on &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    both = dealt.join(before, on)
    inner = ", ".join([*by, "_part"])
    return both.selectExpr(*[f"`{c}`" for c in df.columns], f"_before + row_number() over (partition by {inner} order by {', '.join(order)}) - 1 as {name}")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, which must name a unique order. Aggregated with map-side combining."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return out.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def dedup_coalesce(df: DataFrame, keys: Sequence[str], order: str, fill: Sequence[str]) -> DataFrame:
    """The first row of each key; the columns in fill take the first value that is neither null nor blank, each for itself.

    Aggregated with map-side combining: no key's rows are gathered.
    """
    rest = [c for c in df.columns if c not in keys and c not in fill]
    at = F.col(order)
    filled = []
    for c in fill:
        value = nonblank(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c)
        filled.append(F.coalesce(F.min_by(value, F.when(value.isNotNull(), at)), F.min_by(F.col(c), at)).alias(c))
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_first"), *filled)
    return out.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def last_wins(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """An index key -> value in which the last row in order wins."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))
