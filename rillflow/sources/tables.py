"""Input tables, and the view of them as workflow metadata.

The given tables hold no files or jobs, so a fixed mapping supplies them: orders are jobs (rule: order priority,
start: order date), line items are the files that jobs read and write (size: extended price, mtime: ship date,
temporary: returned), parts form a job graph (k feeds 2k and 2k + 1), pages give paths, events are a queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, rule, priority, start."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("rule"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderdate").alias("start"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, path, size, mtime, temp; a job's line items at one part are one file."""
    i = table(spark, sf_dir, "lineitem")
    return i.groupBy(F.col("l_orderkey").alias("job"), F.concat(F.lit("part/"), F.col("l_partkey")).alias("path")).agg(
        F.sum(F.floor("l_extendedprice")).alias("size"), F.max("l_shipdate").alias("mtime"), F.max(F.col("l_returnflag") == "R").alias("temp")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: part k feeds 2k and 2k + 1 where they exist."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"))
    return p.where("dst > 1").select((F.floor(F.col("dst") / 2)).cast("long").alias("src"), "dst")
