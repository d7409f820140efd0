"""Confidence of an item from deterministic penalties, and the gate that follows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.schemas import RELATIONSHIP_TYPES
from claimlake.functions.text import strip
from claimlake.operators.noise import in_noise

# Fixed values
PENALTIES = {
    "empty_evidence": 0.50,
    "unverified_evidence": 0.30,
    "very_short_quote": 0.15,
    "short_quote": 0.05,
    "in_noise_region": 0.10,
    "no_email": 0.05,
    "missing_endpoint": 0.20,
    "no_evidence_available": 0.10,
}
VERY_SHORT, SHORT, FLOOR = 20, 40, 0.05
APPROVE, REVIEW = 0.70, 0.30


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def penalties(regions: str | None = "regions", trim: Callable[[Column], Column] = strip) -> Column:
    """array<struct<name,value>> for a row of items, in the order in which they are subtracted.

    regions names the mail's noise regions; null (an item without its mail) means no check.
    trim is what a quote's length leaves out at its ends.
    """
    rel = F.col("field") == "relationships"
    quote = F.coalesce(F.col("evidence"), F.lit(""))
    size = F.length(trim(quote))
    noisy = F.lit(False)
    if regions is not None:
        noisy = F.coalesce(in_noise(F.col("char_start"), F.col("char_end"), F.col(regions)), F.lit(False))
    rules = [
        ("empty_evidence", rel & blank(quote)),
        ("unverified_evidence", rel & ~blank(quote) & F.col("evidence_verified").eqNullSafe(F.lit(False))),
        ("very_short_quote", rel & (quote != "") & (size < VERY_SHORT)),
        ("short_quote", rel & (quote != "") & (size >= VERY_SHORT) & (size < SHORT)),
        ("in_noise_region", rel & noisy),
        ("no_email", (F.col("field") == "people") & _empty(F.col("email"))),
        ("missing_endpoint", F.coalesce(F.col("has_endpoint_keys"), F.lit(False)) & (_empty(F.col("source")) | _empty(F.col("target")))),
        ("no_evidence_available", ~rel),
    ]
    found = [F.when(rule, F.struct(F.lit(name).alias("name"), F.lit(PENALTIES[name]).alias("value"))) for name, rule in rules]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def score(items: DataFrame, regions: str | None = "regions", trim: Callable[[Column], Column] = strip) -> DataFrame:
    """items with confidence (two decimals) and confidence_penalties."""
    found = items.withColumn("confidence_penalties", penalties(regions, trim))
    total = F.aggregate("confidence_penalties", F.lit(1.0), lambda s, p: s - p["value"])
    return found.withColumn("confidence", F.round(F.greatest(total, F.lit(FLOOR)), 2))


def hard_reject(trim: Callable[[Column], Column] = strip) -> Column:
    """The first reason to reject an item whatever its confidence; null without one."""
    named = F.col("field").isin("people", "organizations", "deals")
    rel = F.col("field") == "relationships"
    quote = F.coalesce(F.col("evidence"), F.lit(""))
    a, b, kind = (F.coalesce(F.col(c), F.lit("")) for c in ("person_a", "person_b", "relationship_type"))
    return (
        F.when(named & blank(F.col("name")), "missing_name")
        .when((F.col("field") == "decisions") & blank(F.col("description")), "missing_description")
        .when(rel & blank(a), "missing_source")
        .when(rel & blank(b), "missing_target")
        .when(rel & (F.lower(strip(a)) == F.lower(strip(b))), "self_referential")
        .when(rel & ~kind.isin(*RELATIONSHIP_TYPES), F.concat(F.lit("invalid_relationship_type:"), kind))
        .when(rel & F.col("evidence_verified").eqNullSafe(F.lit(False)) & (F.length(trim(quote)) < VERY_SHORT), "unverifiable_and_too_short")
        .when(rel & blank(quote), "missing_evidence")
    )


def gate(items: DataFrame, approve: float = APPROVE, review: float = REVIEW, trim: Callable[[Column], Column] = strip) -> DataFrame:
    """items with status (approved, review, rejected) and gate_reason; no confidence counts as 0."""
    c = F.coalesce(F.col("confidence"), F.lit(0.0))
    found = items.withColumn("_hard", hard_reject(trim))
    status = F.when(F.col("_hard").isNotNull(), "rejected").when(c >= approve, "approved").when(c >= review, "review").otherwise("rejected")
    reason = (
        F.when(F.col("_hard").isNotNull(), F.concat(F.lit("hard_reject:"), F.col("_hard")))
        .when(c >= approve, F.concat(F.lit("confidence_above_soft_threshold:"), c.cast("string")))
        .when(c >= review, F.concat(F.lit("confidence_in_review_band:"), c.cast("string")))
        .otherwise(F.concat(F.lit("confidence_below_hard_threshold:"), c.cast("string")))
    )
    return found.withColumn("status", status).withColumn("gate_reason", reason).drop("_hard")


def review_queue(gated: DataFrame) -> DataFrame:
    """(message_id, field, index, item as JSON) of the items to review."""
    item = F.to_json(F.struct(*[c for c in gated.columns if c not in ("message_id", "field", "idx")]))
    return gated.where(F.col("status") == "review").select("message_id", "field", F.col("idx").alias("index"), item.alias("item"))


def failure_category(body: Column) -> Column:
    """Why a quote wasn't found, for relationships whose evidence isn't verified."""
    quote = F.coalesce(F.col("evidence"), F.lit(""))
    low = F.lower(F.coalesce(body, F.lit("")))
    words = F.slice(F.filter(F.split(F.lower(quote), r"[\s\x1c-\x1f\x85\p{Z}]+"), lambda w: w != ""), 1, 3)
    return (
        F.when(blank(quote), "empty_evidence")
        .when(F.contains(low, F.lower(quote)), "case_mismatch_only")
        .when(F.length(quote) < VERY_SHORT, "very_short_and_unmatched")
        .when(F.exists(words, lambda w: ~F.contains(low, w)), "likely_paraphrased")
        .otherwise("whitespace_or_encoding")
    )
