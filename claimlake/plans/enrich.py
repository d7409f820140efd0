"""The enrichment plan: verify quotes, score, gate and stamp items in one lazy pass.

Regions are found once a mail, before items join; after the join every step is row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.text import strip
from claimlake.operators import evidence, noise, reports, scoring, versions


def located(items: DataFrame, mails: DataFrame, how: str = "left") -> DataFrame:
    """items with body, regions and the place of their quotes.

    left keeps items without a mail, unverified and unscored for noise; inner drops them.
    """
    source = noise.with_regions(mails.select("message_id", "body"))
    joined = items.join(source.withColumn("_has_mail", F.lit(True)), "message_id", how)
    found = evidence.locate(joined)
    # without a mail nothing was looked for
    return found.withColumn("evidence_verified", F.when(F.col("_has_mail"), F.col("evidence_verified"))).drop("_has_mail")


def enrich(items: DataFrame, mails: DataFrame, prompt_version: str = "", model_name: str = "", how: str = "left", trim: Callable[[Column], Column] = strip) -> DataFrame:
    """Gated items: located, scored, gated and stamped. trim: as scoring.penalties() takes it."""
    scored = scoring.score(located(items, mails, how), trim=trim)
    return versions.stamp(scoring.gate(scored, trim=trim), prompt_version, model_name)


@dataclass
class Outputs:
    """What a run writes: every item, the review queue, one report row."""

    items: DataFrame
    review: DataFrame
    report: DataFrame


def run(items: DataFrame, mails: DataFrame, prompt_version: str, model_name: str, path: str) -> Outputs:
    """Write the items once; queue and report read what was written."""
    spark = items.sparkSession
    enrich(items, mails, prompt_version, model_name).drop("body", "regions").write.mode("overwrite").parquet(f"{path}/items")
    done = spark.read.parquet(f"{path}/items")
    review, report = scoring.review_queue(done), reports.pipeline_report(done)
    review.write.mode("overwrite").json(f"{path}/review_queue")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return Outputs(done, review, report)
