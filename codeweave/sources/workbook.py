"""Workbooks written by tasks, through the Python data source API: one file for each group of anchors, none through the driver.

A task writes its groups' files beside their final names and reports them; the job's commit gives them those names, an abort removes
them. Paths are opened with pyarrow's file systems (file, hdfs, s3, ...), on executors and driver alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.graph import materialise
from ..operators.ingest import export_rows
from ..operators.records import numbered
from ..plans.xlsx import write_book

#: Anchors of a file.
ANCHORS_A_FILE = 10_000


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    #: (temporary name, final name) of the files of a task
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.same = options["path"], options.get("same")

    def write(self, iterator: Iterator) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        out = Written()
        for group, rows in groupby(iterator, key=lambda r: r["book"]):
            name = f"{folder}/group-{group:06d}.xlsx"
            part = f"{folder}/_{uuid.uuid4().hex}"
            out.files.append((part, name))
            with system.open_output_stream(part) as file:
                write_book(rows, _Forward(file), self.same)
        return out

    def commit(self, messages) -> None:
        system, folder = _open(self.path)
        for message in messages:
            for part, name in message.files if message else ():
                system.move(part, name)
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages) -> None:
        system, _ = _open(self.path)
        for message in messages:
            for part, _ in message.files if message else ():
                system.delete_file(part)


class _Forward:
    """A stream that can only be written on, for zipfile."""

    def __init__(self, file):
        self.file, self.at = file, 0

    def write(self, data) -> int:
        self.file.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.file.flush()


class Workbooks(DataSource):
    """Options: path, a URI of a folder; same, a boolean column of same-category rows. Rows: the export's columns and `book`, sorted within partitions by it."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def write(found: DataFrame, path: str, map_date: str, anchors_a_file: int = ANCHORS_A_FILE) -> None:
    """Write the rows of Lookup.export (anchor_id, rank, row_type, ...) as workbooks of anchors_a_file anchors each, in order of anchor_id and rank."""
    anchors = materialise(numbered(found.select("anchor_id").distinct(), [], ["anchor_id"], "place"), "workbook-anchors")
    rows = found.join(anchors.select("anchor_id", F.floor(F.col("place") / anchors_a_file).alias("book")), "anchor_id")
    shown = export_rows(rows, map_date, ("book", "anchor_id", "rank", "ngs_match"))
    shown.repartition("book").sortWithinPartitions("book", "anchor_id", "rank").write.format("workbooks").option("path", path).option("same", "ngs_match").mode("append").save()
