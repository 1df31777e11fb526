"""Tables in the shared folder that cut lineage, and connected components on top of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else its context's checkpoint folder.

    Where neither is set, a temporary folder serves if everything runs in one process (local mode, as in tests); a cluster,
    whose executors would write where the driver can't read, is refused.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not there:
        current = context._jsc.sc().getCheckpointDir()
        there = current.get() if current.isDefined() else None
    if not there:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(there)
    return there


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialise(), and the table's path for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives a lost executor."""
    return stored(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_key(name: str) -> Column:
    """A long column as an expression of its own: sums by it are shuffled again before a join by it, so AQE may split the join's hot keys."""
    return F.expr(f"{name} ^ 0L").alias(name)


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as (u, v) longs; component is its least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each links neighbours to the least known
    node, so the number of rounds is logarithmic and no component meets in one task: a star's centre is found by
    a pre-aggregated minimum, then joined back, which AQE may split. Each round is written to the shared folder, and the
    one before it removed.
    """
    spark = edges.sparkSession
    now, path = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(own_key("u"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.select(own_key("u"), "m"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", "m")).distinct()
        last = path
        now, path = stored(small, name)
        discard(spark, last)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
