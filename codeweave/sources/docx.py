"""A DOCX file as rows, through the Python data source API: spark.read.format("docx_body").load(path)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BODY = "file STRING, ord INT, kind STRING, style STRING, text STRING, cells ARRAY<ARRAY<STRING>>"
_NAMES = ("file", "ord", "kind", "style", "text", "cells")
_TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string())))
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def body_of(file) -> Iterator[tuple]:
    """(ord, kind, style, text, cells) of the body's paragraphs and tables in order; a merged cell repeats in the columns it spans."""
    with zipfile.ZipFile(file) as z:
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        root = ElementTree.fromstring(z.read("word/document.xml"))

    def text(p) -> str:
        return "".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter())

    at = 0
    for e in root.find(f"{_W}body"):
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else "Normal"
            name = names.get(key, key)
            yield at, "p", name[:1].upper() + name[1:], text(e), None
        elif e.tag == f"{_W}tbl":
            rows = []
            for r in e.iter(f"{_W}tr"):
                row = []
                for c in r.findall(f"{_W}tc"):
                    span = c.find(f"{_W}tcPr/{_W}gridSpan")
                    row += ["\n".join(text(p) for p in c.findall(f"{_W}p")).strip()] * int(span.get(f"{_W}val") if span is not None else 1)
                rows.append(row)
            yield at, "tbl", None, None, rows
        else:
            continue
        at += 1


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        for row in body_of(partition.value):
            yield (partition.value, *row)


class DocxBody(DataSource):
    """Options: path, one file or several separated by commas; each file is a partition."""

    @classmethod
    def name(cls) -> str:
        return "docx_body"

    def schema(self) -> str:
        return BODY

    def reader(self, schema):
        return _Reader([p for p in self.options["path"].split(",") if p])


def bodies(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """The rows of all files of a folder, by Spark's own file source: any file system that it reads, each file in a task of its own memory."""

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [(where, *row) for row in body_of(io.BytesIO(content))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=list(_NAMES))

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, BODY)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxBody)
