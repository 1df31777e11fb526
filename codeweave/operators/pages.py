"""Page windows and resumable work: sliding windows, latest page text, what is left to do, windows to repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_hints, text_or_blank

#: Pages in a window, and from one window's start to the next.
SIZE, STEP = 8, 6


def page_windows(pages: DataFrame, by: str, page: str, size: int = SIZE, step: int = STEP) -> DataFrame:
    """(by, start, page, new): each window's pages, as an equi-join on page numbers; new marks pages no earlier window has.

    A document of n pages (its highest number + 1) has windows from 0, step, 2 step ... below n. Pages that are missing in between
    are listed too, as there may be text for them later.
    """
    counts = pages.groupBy(by).agg((F.max(page) + 1).cast("int").alias("n")).filter("n > 0")
    starts = counts.select(by, "n", F.explode(F.expr(f"sequence(0, n - 1, {step})")).alias("start"))
    covered = starts.select(by, "start", F.explode(F.expr(f"sequence(start, least(start + {size - 1}, n - 1))")).alias("page"))
    return covered.withColumn("new", (F.col("start") == 0) | (F.col("page") >= F.col("start") - step + size))


def windows_with_new_pages(windows: DataFrame, by: str) -> DataFrame:
    """Windows that a pass over pages has to run: those with a page that no earlier one has."""
    return windows.filter("new").select(by, "start").distinct()


def window_texts(windows: DataFrame, pages: DataFrame, by: str, page: str, text: str, sep: str = "\n") -> DataFrame:
    """(by, start, text): the pages' texts joined in order; a missing page is an empty text."""
    have = pages.select(by, F.col(page).cast("int").alias("page"), F.col(text).alias("text"))
    rows = windows.join(have, [by, "page"], "left")
    parts = F.sort_array(F.collect_list(F.struct("page", text_or_blank("text").alias("text"))))
    return rows.groupBy(by, "start").agg(F.array_join(F.transform(parts, lambda r: r["text"]), sep).alias("text"))


def latest_wins(rows: DataFrame, keys: Sequence[str], value: str, version: str) -> DataFrame:
    """The value of the highest version of each key (of equal versions the greatest value)."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(version, value)).alias(value))


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of work without a row of done; nulls in keys never match, so such work is left to do."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def zero_windows(texts: DataFrame, done: DataFrame, codes: DataFrame, by: str, min_hints: int = 10) -> DataFrame:
    """(by, start, hints): done windows without any code although their text has min_hints code-like words or more."""
    empty = done.select(by, "start").distinct().join(codes.filter("start is not null").select(by, "start").distinct(), [by, "start"], "left_anti")
    return texts.join(empty, [by, "start"]).select(by, "start", code_hints(F.col("text")).alias("hints")).filter(F.col("hints") >= min_hints)


