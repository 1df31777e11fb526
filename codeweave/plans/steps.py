"""The batch pipeline: steps that read and write tables of one folder, skipped where their result is there, stopped at the first failure.

    python -m codeweave.plans.steps --root FOLDER [--source layout|pages] [--force] [--only STEP ...] [--province P ...] [--skip-ocr]
        [--min-code-hints N] [--clients MODULE] [--map-date DATE]

Tables are Parquet folders under the root. Inputs: layout_lines or page_counts (province, n), and docx_body. fee_codes comes from one
source: the parsed layout, or the pages' codes. The first that has its input is taken, the layout before the pages, unless
--source names one. MODULE has the functions of the page path's services: read(province, pages), extract(prompt), and, if it likes,
delete(province). Without it the page steps wait. Linking and embedding depend on mapping only. Each step tells what it counted.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, ingest, layout, link, lookup, metrics, records, reference_docs
from ..sources import clients, tables
from . import extraction

#: How a record may have got its category.
METHODS = ("role_code_table", "keyword_rule", "text_similarity", "section_fallback", "none")


@dataclass(frozen=True)
class Counts:
    """What a step tells of its rows: aggregates that the writing job observes, and how they are told."""

    columns: Callable[[], dict[str, Column]]
    told: Callable[[dict], dict] = dict


@dataclass(frozen=True)
class Step:
    name: str
    needs: tuple[str, ...]
    makes: str
    run: Callable[..., DataFrame]
    counts: Counts | None = None
    source: str | None = None
    #: What can't be observed, of the table as it is read again.
    report: Callable[[DataFrame], dict] | None = None
    #: Raises if the table that is read again isn't what the counts say.
    verify: Callable[[DataFrame, dict], None] | None = None


def _parse(lines: DataFrame) -> DataFrame:
    """Records of layout lines; lines of several files (a column `file`) are documents of their own."""
    by = ["province", "file"] if "file" in lines.columns else ["province"]
    at = [*by[1:], "page", "line_no"]
    found = layout.post_process(layout.parse_layout(lines, by)).withColumn("_at", F.struct(*at))
    once = records.dedup_coalesce(found, ["province", "fsc_code"], "_at", ["fsc_fn", "fsc_description", "fsc_notes", "price"])
    return ingest.with_record_ids(once, ["_at", "fsc_code"]).drop("_at", "line_no", *by[1:])


def _from_codes(codes: DataFrame) -> DataFrame:
    first = ingest.first_codes(codes, ["page_start", "pos"])
    rows = ingest.normalised(first).join(first.select("province", "fsc_code", "pos"), ["province", "fsc_code"])
    return ingest.with_record_ids(rows.withColumn("entry_x0", F.lit(None).cast("double")), ["page", "pos"]).drop("pos")


def _embed(mapped: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("fsc_fn", "fsc_description", "fsc_section", "fsc_subsection", "fsc_chapter", "NGS_label")]
    vectors = clients.embed(mapped.select("record_id", text.record_text(*parts, code=F.col("fsc_code")).alias("text")), "text")
    return mapped.select("record_id", "province", "fsc_code").join(vectors, "record_id")


def _rules(body: DataFrame) -> DataFrame:
    """Rules of the paragraphs, and examples of the tables."""
    return reference_docs.province_rules(body).withColumn("ord", F.struct("ord.file", "ord.ord", F.lit(None).cast("int").alias("row_no"))).unionByName(reference_docs.example_rules(reference_docs.routed_tables(body)))


def _export(date: str) -> Callable[[DataFrame], DataFrame]:
    return lambda linked: ingest.export_rows(linked.withColumn("anchor_code", F.col("top_key")).withColumn("row_type", F.lit("ANCHOR")).withColumn("sim_score", F.lit(None).cast("double")), date)


ROWS = Counts(lambda: {"rows": F.count("*")})


def _quality_columns() -> dict[str, Column]:
    """By province; a step's codes are unique in it."""
    out = {}
    for p in (*lookup.PROVINCES, "others"):
        own = F.col("province") == p if p in lookup.PROVINCES else ~F.coalesce(F.col("province").isin(*lookup.PROVINCES), F.lit(False))
        out |= {f"{p} raw": F.count_if(own), f"{p} missing_fn": F.count_if(own & (text.text_or_blank("fsc_fn") == "")), f"{p} missing_price": F.count_if(own & (text.text_or_blank("price") == ""))}
    return out


def _by_province(seen: dict) -> dict:
    out: dict[str, dict] = {}
    for name, n in seen.items():
        p, what = name.split(" ")
        out.setdefault(p, {})[what] = n
    return {p: {**v, "unique_codes": v["raw"]} for p, v in out.items() if v["raw"]}


def _mapped_columns() -> dict[str, Column]:
    method = F.coalesce(text.nonblank("match_method"), F.lit("none"))
    return metrics.confidence_columns() | {f"method {m}": F.count_if(method == m) for m in METHODS}


def _mapped_told(seen: dict) -> dict:
    methods = {k.split(" ", 1)[1]: n for k, n in seen.items() if k.startswith("method ") and n}
    return {**{k: n for k, n in seen.items() if not k.startswith("method ")}, "methods": methods}


QUALITY, MAPPED = Counts(_quality_columns, _by_province), Counts(_mapped_columns, _mapped_told)


def _whole_vectors(again: DataFrame, seen: dict) -> None:
    """All rows are there, with vectors of one length."""
    r = again.agg(F.count("*").alias("rows"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if r["rows"] != seen["rows"] or r["least"] != r["most"] or (r["rows"] and not r["least"]):
        raise ValueError(f"embeddings: {r.asDict()} read again, {seen} written")


def steps(map_date: str = "") -> list[Step]:
    routed = reference_docs.routed_tables
    return [
        Step("parse", ("layout_lines",), "fee_codes", _parse, QUALITY, "layout"),
        Step("parse-codes", ("raw_codes",), "fee_codes", _from_codes, QUALITY, "pages"),
        Step("categories", ("docx_body",), "ngs_categories", reference_docs.categories, ROWS),
        Step("roles", ("docx_body",), "role_tables", lambda body: reference_docs.role_tables(routed(body)), ROWS),
        Step("ccp", ("docx_body",), "ccp_map", lambda body: reference_docs.ccp_map(routed(body)), ROWS),
        Step("rules", ("docx_body",), "province_rules", _rules, ROWS),
        Step("map", ("fee_codes", "ngs_categories", "role_tables"), "mapped", classify.cascade, MAPPED),
        Step("link", ("mapped",), "linked", lambda mapped: ingest.with_meta(link.link(mapped)), report=lambda linked: link.group_sizes(linked).first().asDict()),
        Step("embed", ("mapped",), "embeddings", _embed, ROWS, verify=_whole_vectors),
        Step("export", ("linked",), "export_rows", _export(map_date), ROWS),
    ]


STEPS = steps()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def run_pages(spark: SparkSession, root: str, services, provinces: list[str] | None = None, skip_ocr: bool = False, min_hints: int = 10) -> dict[str, str]:
    """The page path: read the missing pages (unless skip_ocr), extract the missing windows, repair suspicious empty ones."""
    out = {}
    if not skip_ocr and _exists(spark, f"{root}/page_counts"):
        counts = spark.read.parquet(f"{root}/page_counts")
        extraction.read_missing_pages(spark, root, counts.filter(F.col("province").isin(provinces)) if provinces else counts, services.read, getattr(services, "delete", None), sign=getattr(services, "sign", None))
        out["read"] = "done"
    if not _exists(spark, f"{root}/ocr_pages"):
        return {**out, "extract": "waiting", "repair": "waiting"}
    extraction.extract_missing_windows(spark, root, services.extract, provinces)
    again = extraction.repair(spark, root, services.extract, min_hints, provinces)
    return {**out, "extract": "done", "repair": f"{again} windows again"}


def run(
    spark: SparkSession, root: str, force: bool = False, only: list[str] | None = None, source: str | None = None, services=None, provinces: list[str] | None = None, skip_ocr: bool = False, min_hints: int = 10,
    map_date: str = "", say: Callable[[str], None] | None = None,
) -> dict[str, str]:
    """What became of each step: done, skipped (its table is there) or waiting (an input is missing, or another source makes its table).

    An error ends the run. The same source makes fee_codes with and without force.
    """
    out: dict[str, str] = {}
    if services and source != "layout" and not only:
        out |= run_pages(spark, root, services, provinces, skip_ocr, min_hints)
    todo = steps(map_date)
    ready = [s.source for s in todo if s.source and all(_exists(spark, f"{root}/{t}") for t in s.needs)]
    chosen = source or (ready[0] if ready else None)
    for step in todo:
        if only and step.name not in only:
            continue
        made = f"{root}/{step.makes}"
        if (step.source and step.source != chosen) or not all(_exists(spark, f"{root}/{t}") for t in step.needs):
            out[step.name] = "waiting"
        elif _exists(spark, made) and not force:
            out[step.name] = "skipped"
        else:
            rows, seen = step.run(*[spark.read.parquet(f"{root}/{t}") for t in step.needs]), Observation()
            tables.write_array(rows.observe(seen, *[c.alias(name) for name, c in step.counts.columns().items()]) if step.counts else rows, made)
            if step.verify:
                step.verify(spark.read.parquet(made), seen.get)
            out[step.name] = "done"
            if say and (step.counts or step.report):
                say(f"{step.name}: {step.counts.told(seen.get) if step.counts else step.report(spark.read.parquet(made))}")
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--root", required=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--only", nargs="*")
    p.add_argument("--source", choices=["layout", "pages"])
    p.add_argument("--province", nargs="*", help="the page path's provinces; all by default")
    p.add_argument("--skip-ocr", action="store_true", help="take the pages as they are")
    p.add_argument("--min-code-hints", type=int, default=10, help="code-like words from which on an empty window is extracted again")
    p.add_argument("--clients", help="module with read, extract and perhaps delete")
    p.add_argument("--map-date", default="")
    a = p.parse_args(args)
    services = importlib.import_module(a.clients) if a.clients else None
    done = run(SparkSession.builder.getOrCreate(), a.root, a.force, a.only, a.source, services, a.province, a.skip_ocr, a.min_code_hints, a.map_date, print)
    for name, state in done.items():
        print(f"{name}: {state}")


if __name__ == "__main__":
    main()
