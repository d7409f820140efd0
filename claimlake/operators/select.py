"""Subsets, samples and pages of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions.text import strip


def subset(mails: DataFrame, origins: list[str], per_origin: int = 1500, most: int = 10_000, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first per_origin mails of each wanted mailbox, then the earliest most of them.

    Mailboxes match without case and outer blanks; mails without a date come first; ties go by
    the mailbox's place in origins, then by ingest order.
    """
    spark = mails.sparkSession
    wanted = spark.createDataFrame([(o.strip().lower(), k) for k, o in enumerate(origins)], "_origin string, _place int")
    rows = mails.join(F.broadcast(wanted), F.lower(strip(F.col("x_origin"))) == F.col("_origin"))
    rank = F.row_number().over(Window.partitionBy("_origin").orderBy(*ord))
    rows = rows.withColumn("_n", rank).where(F.col("_n") <= per_origin)
    return rows.orderBy(F.coalesce("date", F.lit("")), "_place", *ord).limit(most).select(*mails.columns)


def sample(rows: DataFrame, n: int, seed: int = 42, key: str = "message_id") -> DataFrame:
    """n rows drawn by a hash of seed and key: reruns agree."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def first_matching(rows: DataFrame, conditions: list[Column], ord: tuple[str, ...] = ("ord",), key: str = "message_id") -> DataFrame:
    """For each condition in turn, the first row that meets it and wasn't taken before."""
    taken, found = [], None
    for c in conditions:
        free = rows.where(c) if not taken else rows.where(c & ~F.col(key).isin(taken))
        one = free.orderBy(*ord).limit(1)
        taken += [r[key] for r in one.select(key).collect()]
        found = one if found is None else found.unionByName(one)
    return found


def page(rows: DataFrame, start: int, count: int, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    return rows.orderBy(*ord).offset(start).limit(count)
