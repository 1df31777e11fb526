"""PDF pages as text spans, through the Python data source API, by a backend that the caller names.

Options: path, one or several separated by commas; backend, "module:function" importable on the executors; pages, the number of pages of
each; per_partition. Filters on page narrow the ranges that are read. The function
takes (path, first page, last page), pages from 1, and yields (page, block, line, span, text, x0, y0, size, font).
No PDF library is part of this package.
"""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SPANS = "page INT, block INT, line INT, span INT, text STRING, x0 DOUBLE, y0 DOUBLE, size DOUBLE, font STRING"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high = dict(options), 1, None

    def pushFilters(self, filters):
        """Ranges of pages narrow what is read; all filters go on to Spark, as partitions are read whole."""
        for f in filters:
            if getattr(f, "attribute", None) == ("page",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(f.value - isinstance(f, LessThan), self.high if self.high is not None else f.value)
            yield f

    def partitions(self):
        paths, counts = (self.options[x].split(",") for x in ("path", "pages"))
        each, out = int(self.options.get("per_partition", 25)), []
        for path, count in zip(paths, counts, strict=True):
            last = int(count) if self.high is None else min(int(count), self.high)
            out += [InputPartition((path, a, min(a + each - 1, last))) for a in range(self.low, last + 1, each)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is not None:
            module, _, function = self.options["backend"].partition(":")
            yield from getattr(import_module(module), function)(*partition.value)


class PdfSpans(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_spans"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let the session push filters to Python sources, which it refuses by default for readers that take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSpans)
