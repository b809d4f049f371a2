"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or one of our own where it is unset (local mode, as in tests)."""
    sc = spark.sparkContext
    wanted = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not wanted and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="rillflow-"))
    return wanted or sc.getCheckpointDir()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it each action removes its shuffle files when it ends. For actions that store their rows: nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Run the plan once and go on from its stored rows.

    The files stay until forget() or the end of the folder; with spark.cleaner.referenceTracking.cleanCheckpoints Spark
    removes them once the DataFrame is no longer used.
    """
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # whether its shuffles go is settled when a DataFrame is made, not when it runs


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*cuts: DataFrame) -> None:
    """Remove the files of what cut() returned, when all that needed them is stored."""
    for df in cuts:
        where = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if where.isDefined():
            remove(df.sparkSession, where.get())


class Stored:
    """A Parquet table in the shared folder, for results too large to keep as checkpoint rows."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/rillflow-{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def join_spread(rows: DataFrame, other: DataFrame, on: list[str], sizes: DataFrame, by: list[str], parts: int = 2000, least: int = 256) -> DataFrame:
    """rows joined with other on keys that are not null, where some keys may hold very many rows: these are dealt out by a hash of `by`.

    sizes (stored): the keys and n, their rows. Dealt out are keys with more than a share of 1 / parts of the rows that sizes
    counts; there are fewer than `parts` of them, so their list can be broadcast whatever the size of the tables.
    """
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    limit = max(least, -(-(total or 0) // parts))
    if (most or 0) <= limit:
        return rows.join(other, on)
    hot = sizes.where(F.col("n") > limit).select(*on, F.ceil(F.col("n") / limit).cast("int").alias("__parts"))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0)).cast("int"))
    other = other.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    return rows.drop("__parts").join(other.drop("__parts"), [*on, "__salt"]).drop("__salt")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Run a Python function over df's rows, batch by batch.

    make() is called once in each task and returns f(*columns) -> rows, where each column is a list of some
    of a batch's values, about 16 MB or 512 rows at most, so that memory stays bounded.
    """
    names = arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, types = make(), None
        for batch in batches:
            types = types or arrow_schema(schema)
            step = max(1, min(512, batch.num_rows * 16_000_000 // max(1, batch.nbytes)))
            for piece in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                rows = list(f(*(c.to_pylist() for c in piece.columns)))
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow types of the column kinds used here: 'name kind, name kind'."""
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
        "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
        "array<array<int>>": pa.list_(pa.list_(pa.int32())),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def fold(column: str, parts: int) -> F.Column:
    """crc32 of a column's text modulo parts; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled rows of docs, chosen by a hash of doc_id: (doc_id, text, label).

    Rows without a label take no part; for conflicting labels of one document the larger counts. Rows that repeat an id
    train once, with the text of the smallest hash (null only if there is no other).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).alias("text")).select("doc_id", "text", "label")
