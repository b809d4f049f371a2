"""Queue inputs: an unbounded table of items whose accumulated set drives jobs, until a sentinel arrives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rillflow.operators.graph import stored


def accumulate(spark: SparkSession, folder: str, key: str, sentinel: str | None = None, per_batch: int = 1, pattern: str | None = None, home: str | None = None) -> DataFrame:
    """All items of the Parquet files in folder, each once by key, taken in as a stream of micro-batches.

    Batches go to a table keyed by batch, so a batch that is repeated after a failure replaces itself. A row for which the
    SQL condition `sentinel` holds ends the queue: later batches are ignored, and the sentinel itself is not an item.
    home: a shared folder for the items and the stream's state; a call with the same one goes on where the last one ended, with
    the sentinel it met. Without it each call starts anew.
    """
    stored(spark.range(0))  # sets the shared folder
    home = home or f"{spark.sparkContext.getCheckpointDir()}/queue-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{folder}/{pattern}" if pattern else folder).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    stream = (source.option("pathGlobFilter", pattern) if pattern else source).parquet(folder)

    def take(batch: DataFrame, number: int) -> None:
        """The batch's items and, stored beside them, whether the sentinel is among them."""
        batch.write.mode("overwrite").parquet(f"{home}/items/batch={number}")
        if sentinel:
            met = spark.read.schema(schema).parquet(f"{home}/items/batch={number}").where(sentinel)
            met.limit(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{home}/ends/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    items = spark.read.option("basePath", f"{home}/items").schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{home}/items")
    if sentinel:
        end = ended(spark, home)
        items = items.where(~F.coalesce(F.expr(sentinel), F.lit(False)))
        items = items if end is None else items.where(F.col("batch") <= end)
    return items.drop("batch").dropDuplicates([key])


def ended(spark: SparkSession, home: str) -> int | None:
    """The batch in which the sentinel came, from the stored state; None while the queue is open."""
    return spark.read.schema("number long").parquet(f"{home}/ends/*").agg(F.min("number")).first()[0]
