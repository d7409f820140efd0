"""Which prompt and model made an extraction, what is stale, and what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stamp(rows: DataFrame, prompt_version: str, model_name: str) -> DataFrame:
    return rows.withColumn("prompt_version", F.lit(prompt_version)).withColumn("model_name", F.lit(model_name))


def already_stamped(rows: DataFrame, prompt_version: str, model_name: str) -> Column:
    return F.count_if((F.col("prompt_version") == prompt_version) & (F.col("model_name") == model_name))


def stale(rows: DataFrame, prompt_version: str) -> DataFrame:
    return rows.where(F.coalesce("prompt_version", F.lit("")) != prompt_version)


def report(rows: DataFrame) -> DataFrame:
    """(version, extractions, unstamped): version is prompt:model."""
    key = F.concat(F.coalesce("prompt_version", F.lit("")), F.lit(":"), F.coalesce("model_name", F.lit("")))
    return rows.groupBy(key.alias("version")).agg(F.count("*").alias("extractions"), F.count_if(F.coalesce("prompt_version", F.lit("")) == "").alias("unstamped"))


def upsert(old: DataFrame, new: DataFrame, key: str = "message_id") -> DataFrame:
    """new rows in place of old ones with their key; other rows of old stay, new keys come in."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pending(rows: DataFrame, done: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows whose key isn't among those that are done."""
    return rows.join(done.select(key), key, "left_anti")


def mark_done(done: DataFrame, path: str) -> None:
    """Append completed keys to the checkpoint table."""
    done.write.mode("append").parquet(path)


def last_by_key(rows: DataFrame, key: str = "message_id", ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One row a key: the last in ingest order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in ord)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
