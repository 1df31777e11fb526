"""Page texts that arrive as files, taken up once each: a file stream whose batches append the pages not yet in the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.pages import not_done

PAGES = "province STRING, page INT, markdown STRING"


def _have(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.schema(PAGES).parquet(table)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], PAGES)
        raise


def append_new_pages(batch: DataFrame, table: str) -> None:
    """Append the pages of a batch that the table lacks; of equal pages in a batch one is taken."""
    keys = ["province", "page"]
    not_done(batch.dropDuplicates(keys), _have(batch.sparkSession, table), keys).write.mode("append").parquet(table)


def start(spark: SparkSession, folder: str, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A query over the JSON files of a folder; trigger as of DataStreamWriter.trigger, e.g. availableNow=True."""
    pages = spark.readStream.schema(PAGES).json(folder)
    return pages.writeStream.foreachBatch(lambda batch, _: append_new_pages(batch, table)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
