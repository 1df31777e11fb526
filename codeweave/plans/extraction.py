"""The page path to raw codes: pages are read once, windows extracted once, suspicious empty windows once more. Services are the caller's.

Logs under the root (see commits): ocr_pages (province, page, markdown) and done_windows (province, start, attempt, kind, status, and what
the window gave). Each pass works in batches of bounded size; a batch's codes and states become visible together, by one rename,
before the next one starts, so a run that stops repeats one batch of calls at most. A window whose call failed is tried again by
the next pass; a repaired window is not repaired again. raw_codes is written from the log at the end of a pass.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, pages
from ..operators.graph import materialise
from ..operators.records import numbered
from ..sources import clients
from .commits import CommitLog, batch_name

PAGES = "province STRING, page INT, markdown STRING"
WINDOWS = f"province STRING, start INT, attempt INT, kind STRING, status STRING, codes ARRAY<STRUCT<{ingest.CODE_FIELDS}>>, chapter STRING, section STRING"
#: Fixed value: what stands between the pages of a prompt.
PAGE_BREAK = "\n\n---PAGE BREAK---\n\n"


def pages_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/ocr_pages", PAGES)


def windows_log(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/done_windows", WINDOWS)


#: Calls of a batch: what a run that stops pays for twice at most.
BATCH = 256


def _batches(todo: DataFrame, keys: list[str], size: int, calls: int = 1) -> Iterator[DataFrame]:
    """todo in parts of about `size` calls of `calls` rows each, by key; only their number comes to the driver."""
    todo = materialise(todo, "todo")
    parts = -(-todo.count() // (size * calls))
    if parts <= 1:
        yield todo
        return
    dealt = materialise(numbered(todo, [], keys, "_no"), "todo-numbered")
    for at in range(parts):
        yield dealt.filter(F.col("_no").between(at * size * calls, (at + 1) * size * calls - 1)).drop("_no")


def read_missing_pages(spark: SparkSession, root: str, counts: DataFrame, read: Callable[[str, list[int]], list[str]], delete: Callable[[str], None] | None = None, batch: int = BATCH, sign: Callable[[str], str] | None = None) -> None:
    """Read the pages 0 .. n - 1 of counts (province, n) that the log lacks. sign, if given, makes the address that read gets for a province.

    delete, if given, is called with each province once all its pages are there, to remove what the service keeps of it; its errors
    are ignored, as nothing depends on it.
    """
    log = pages_log(spark, root)
    log.recover()
    every = counts.filter("n > 0").select("province", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("page"))
    todo = pages.not_done(every, log.table(), ["province", "page"])
    for part in _batches(todo, ["province", "page"], batch, pages.SIZE):
        log.commit(batch_name(part, ["province", "page"]), clients.read_pages(part, read, sign=sign))
    if delete:

        def remove(rows) -> None:
            for r in rows:
                with contextlib.suppress(Exception):
                    delete(r["province"])

        counts.select("province").distinct().foreachPartition(remove)


def _extract(spark: SparkSession, root: str, texts: DataFrame, extract: Callable[[str], str], kind: str, batch: int) -> None:
    """Batch by batch: call for each window with a text, then make the batch's results visible. Windows of blanks are done without a call."""
    log = windows_log(spark, root)
    before = log.table().groupBy("province", "start").agg(F.max("attempt").alias("last"))
    work = texts.join(before, ["province", "start"], "left").select("province", F.col("start").cast("int").alias("start"), "text", (F.coalesce("last", F.lit(0)) + 1).alias("attempt"))
    none = {"status": F.lit("done"), "codes": F.array().cast(f"ARRAY<STRUCT<{ingest.CODE_FIELDS}>>"), "chapter": F.lit(""), "section": F.lit("")}
    names = [c.split()[0] for c in ("province", "start", "attempt", "kind", "status", "codes", "chapter", "section")]
    for part in _batches(work, ["province", "start"], batch):
        blank = F.regexp_replace("text", f"({PAGE_BREAK.strip()}|[\\s\u00a0])+", "") == ""
        called = clients.extract_windows(part.filter(~blank), extract).join(part.select("province", "start", "attempt"), ["province", "start"])
        both = called.withColumn("kind", F.lit(kind)).select(*names).unionByName(part.filter(blank).withColumns({"kind": F.lit(kind), **none}).select(*names))
        log.commit(batch_name(part, ["province", "start", "attempt"]), both)


def _texts(spark: SparkSession, root: str) -> DataFrame:
    have = pages_log(spark, root).table()
    return pages.window_texts(pages.page_windows(have, "province", "page"), have, "province", "page", "markdown", PAGE_BREAK)


def _done(spark: SparkSession, root: str) -> DataFrame:
    return windows_log(spark, root).table().filter("status = 'done'")


def raw_codes(spark: SparkSession, root: str) -> DataFrame:
    """The codes of each window's last attempt that gave an answer: province, page_start, pos and the code's fields."""
    last = _done(spark, root).groupBy("province", "start").agg(F.max_by(F.struct("codes", "chapter", "section"), "attempt").alias("r")).select("province", "start", "r.*")
    return ingest.window_codes(last).select("province", "page_start", "pos", "fsc_code", "fsc_fn", "fsc_description", "price", "chapter", "section")


def publish(spark: SparkSession, root: str) -> None:
    """Write the table raw_codes from the log, as it stands."""
    raw_codes(spark, root).write.mode("overwrite").parquet(f"{root}/raw_codes")


def extract_missing_windows(spark: SparkSession, root: str, extract: Callable[[str], str], provinces: list[str] | None = None, batch: int = BATCH) -> None:
    """Extract every window of the pages (of the given provinces) that isn't done or whose call failed."""
    windows_log(spark, root).recover()
    todo = pages.not_done(_texts(spark, root), _done(spark, root), ["province", "start"])
    _extract(spark, root, todo.filter(F.col("province").isin(provinces)) if provinces else todo, extract, "first", batch)
    publish(spark, root)


def windows_to_repair(spark: SparkSession, root: str, min_hints: int = 10) -> DataFrame:
    """(province, start, hints): windows that are done without codes, not yet repaired, although their text looks as if it had some."""
    codes, done = raw_codes(spark, root).select("province", F.col("page_start").alias("start")), _done(spark, root)
    done = pages.not_done(done, done.filter("kind = 'repair'"), ["province", "start"])
    return pages.zero_windows(_texts(spark, root), done, codes, "province", min_hints)


def repair(spark: SparkSession, root: str, extract: Callable[[str], str], min_hints: int = 10, provinces: list[str] | None = None, batch: int = BATCH) -> int:
    """Extract those windows (of the given provinces) again, each once; how many there were."""
    windows_log(spark, root).recover()
    again = windows_to_repair(spark, root, min_hints)
    again = materialise(again.filter(F.col("province").isin(provinces)) if provinces else again, "repair")
    _extract(spark, root, _texts(spark, root).join(again.select("province", "start"), ["province", "start"]), extract, "repair", batch)
    publish(spark, root)
    return again.count()


def codes(spark: SparkSession, root: str) -> DataFrame:
    """The first code of each canonical form in each province, in order of windows."""
    return ingest.first_codes(raw_codes(spark, root), ["page_start", "pos"])
