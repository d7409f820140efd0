"""JSONL and Parquet in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.operators.versions import last_by_key


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, with a fixed schema: no pass for inference."""
    return spark.read.schema(schema).json(path)


def read_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl() with ord, the ingest order: the path a mail came from, if its line says so, else
    the file and the line's place in it."""
    rows = spark.read.schema(f"{schema}, path string").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("ord", F.struct(F.col("path").alias("path"), place.alias("place"))).drop("path")


def read_keyed(spark: SparkSession, path: str, schema: str, key: str, ord: tuple[str, ...] | None = None) -> DataFrame:
    """One row a key: the last one, by ord or else in ingest order."""
    return last_by_key(read_jsonl(spark, path, schema), key, ord) if ord else last_by_key(read_ordered(spark, path, schema), key)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, for stages that fall back to earlier results."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_ids(df: DataFrame, path: str, column: str = "message_id") -> None:
    """A sorted list of distinct ids; files in order of their names."""
    df.select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def threads_json(threads: DataFrame, path: str) -> None:
    """One line a thread: its id and its members in order."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("position", "message_id"))), lambda x: x["message_id"])
    threads.groupBy("thread_id").agg(members.alias("message_ids")).write.mode("overwrite").json(path)


def one_row(df: DataFrame) -> str:
    """A report of one row as JSON text."""
    return json.dumps(df.first().asDict(recursive=True), default=str)
