"""Enrichment of items as they arrive.

Every step is row by row after a stream-static join with the mails, so the stream keeps no
state and needs no watermark; the checkpoint folder remembers which files are done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from claimlake.functions.text import strip
from claimlake.plans.enrich import enrich

ITEM = "message_id string, field string, idx int, name string, email string, org_type string, description string, made_by string, person_a string, person_b string, relationship_type string, evidence string, source string, target string, has_endpoint_keys boolean"


def read_items(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(items: DataFrame, mails: DataFrame, path: str, checkpoint: str, prompt_version: str = "", model_name: str = "", once: bool = False, trim: Callable[[Column], Column] = strip) -> StreamingQuery:
    """Write enriched items to path as Parquet; once=True ends when all that is there is done."""
    out = enrich(items, mails, prompt_version, model_name, trim=trim).drop("body", "regions")
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
