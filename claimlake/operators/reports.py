"""Aggregates that the runs report. Ranks are by index into the sorted values, from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions.text import estimate
from claimlake.operators.scoring import failure_category

# Fixed values
QUANTILES = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
TOKEN_LIMIT = 30_000
BUCKETS = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01))


def id_duplicates(mails: DataFrame) -> DataFrame:
    """(total, unique_ids, duplicates, duplicate_rate)."""
    n, u = F.count("*"), F.countDistinct("message_id")
    return mails.agg(n.alias("total"), u.alias("unique_ids"), (n - u).alias("duplicates"), F.round((n - u) / F.greatest(n, F.lit(1)), 4).alias("duplicate_rate"))


def top_ids(mails: DataFrame, most: int = 5, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(message_id, n) of ids that occur more than once, most frequent first; ties as first seen."""
    g = mails.groupBy("message_id").agg(F.count("*").alias("n"), F.min(F.struct(*ord)).alias("_first")).where("n > 1")
    return g.orderBy(F.desc("n"), "_first").limit(most).select("message_id", "n")


def data_quality(mails: DataFrame, attempted: int | None = None) -> DataFrame:
    """(parsed, attempted, success_pct, null_dates, min_date, max_date)."""
    tried = F.count("*") if attempted is None else F.lit(attempted)
    return mails.agg(
        F.count("*").alias("parsed"),
        tried.alias("attempted"),
        F.round(100.0 * F.count("*") / F.greatest(tried, F.lit(1)), 3).alias("success_pct"),
        F.count_if(F.col("date").isNull()).alias("null_dates"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def _ranks(values: DataFrame, col: str, wanted: tuple, *more: Column) -> DataFrame:
    """One row with the value at index floor(p * n) for each (name, p); more: aggregates over the
    distinct values v, which occur c times each.

    Values are counted first, so what is sorted in one place are distinct values, not rows.
    """
    counts = values.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("c"))
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), *(F.min(F.when(F.col("upto") > F.floor(F.lit(p) * F.col("n")), F.col("v"))).alias(name) for name, p in wanted), *more)


def length_quantiles(mails: DataFrame) -> DataFrame:
    """(n, min, max, p50, p90, p95, p99, over_limit) of body lengths."""
    rows = mails.select(F.length(F.coalesce("body", F.lit(""))).cast("long").alias("length"))
    over = F.coalesce(F.sum(F.when(estimate(F.col("v")) > TOKEN_LIMIT, F.col("c"))), F.lit(0)).alias("over_limit")
    return _ranks(rows, "length", QUANTILES, over)


def extraction_totals(items: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row: mails, items by field, items a mail, mails without any item, decisions without made_by."""
    fields = ("people", "organizations", "deals", "decisions", "relationships")
    by = items.groupBy("message_id").agg(*(F.count_if(F.col("field") == f).alias(f) for f in fields), F.count_if((F.col("field") == "decisions") & (F.coalesce("made_by", F.lit("")) == "")).alias("unattributed"))
    rows = extractions.select("message_id").join(by, "message_id", "left").fillna(0)
    total = sum((F.col(f) for f in fields[1:]), F.col(fields[0]))
    return rows.agg(F.count("*").alias("mails"), *(F.sum(f).alias(f) for f in fields), *(F.round(F.avg(f), 4).alias(f"avg_{f}") for f in fields), F.count_if(total == 0).alias("empty_mails"), F.sum("unattributed").alias("unattributed_decisions"))


def type_histogram(items: DataFrame) -> DataFrame:
    """(kind, type, n): relationships by type and organizations by type, '' and null as 'null'."""
    rel = items.where("field = 'relationships'").select(F.lit("relationship").alias("kind"), F.col("relationship_type").alias("type"))
    org = items.where("field = 'organizations'").select(F.lit("organization").alias("kind"), F.coalesce(F.nullif("org_type", F.lit("")), F.lit("null")).alias("type"))
    return rel.unionByName(org).groupBy("kind", "type").agg(F.count("*").alias("n"))


def top_names(items: DataFrame, most: int = 50) -> DataFrame:
    rows = items.where("field = 'people' and name is not null and name <> ''")
    return rows.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)


def graph_size(items: DataFrame) -> DataFrame:
    """(unique_people, unique_orgs, deals, decisions, claims): what a load would create.

    Organizations are counted by name.
    """
    name = lambda f: F.countDistinct(F.when(F.col("field") == f, F.lower("name")))
    n = lambda f: F.count_if(F.col("field") == f)
    return items.agg(name("people").alias("unique_people"), name("organizations").alias("unique_orgs"), n("deals").alias("deals"), n("decisions").alias("decisions"), n("relationships").alias("claims"))


def affects_resolution(items: DataFrame, affects: DataFrame) -> DataFrame:
    """(total, resolved, resolved_pct): affected names that the same mail names as person or organization."""
    names = items.where("field in ('people', 'organizations')").select("message_id", F.lower("name").alias("name")).distinct()
    rows = affects.select("message_id", F.lower("affects").alias("name"))
    found = rows.join(names.withColumn("known", F.lit(True)), ["message_id", "name"], "left")
    return found.agg(F.count("*").alias("total"), F.count_if(F.col("known")).alias("resolved"), F.round(100.0 * F.count_if(F.col("known")) / F.greatest(F.count("*"), F.lit(1)), 1).alias("resolved_pct"))


def confidence_quantiles(scored: DataFrame) -> DataFrame:
    """(n, average, p10, p25, p50)."""
    average = F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 4).alias("average")
    return _ranks(scored, "confidence", (("p10", 0.1), ("p25", 0.25), ("p50", 0.5)), average).drop("min", "max")


def confidence_buckets(scored: DataFrame) -> DataFrame:
    """(bucket, n) for all buckets, empty ones too."""
    sums = scored.agg(*(F.count_if((F.col("confidence") >= lo) & (F.col("confidence") < hi)).alias(f"b{k}") for k, (lo, hi) in enumerate(BUCKETS)))
    names = [f"{lo:.1f}-{min(hi, 1.0):.1f}" for lo, hi in BUCKETS]
    return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"b{k}").alias("n")) for k, name in enumerate(names)))).alias("x")).select("x.*")


def confidence_by_field(scored: DataFrame) -> DataFrame:
    return scored.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("average"))


def penalty_counts(scored: DataFrame, where: Column | None = None) -> DataFrame:
    rows = scored if where is None else scored.where(where)
    return rows.select(F.explode("confidence_penalties.name").alias("penalty")).groupBy("penalty").agg(F.count("*").alias("n"))


def gate_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("field", "status").agg(F.count("*").alias("n"))


def gate_pivot(gated: DataFrame) -> DataFrame:
    return gated.groupBy("field").pivot("status", ["approved", "review", "rejected"]).count().fillna(0)


def reject_reasons(gated: DataFrame, whole: bool = False) -> DataFrame:
    """(reason, n): the first two parts of the reason, or all of it."""
    reason = F.col("gate_reason") if whole else F.substring_index("gate_reason", ":", 2)
    return gated.where("status = 'rejected'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def failure_categories(located: DataFrame, body: str = "body", examples: int = 3) -> DataFrame:
    """(category, n, examples) of unverified relationships; examples by message and item."""
    rows = located.where((F.col("field") == "relationships") & ~F.col("evidence_verified"))
    rows = rows.select("message_id", "idx", F.substring("evidence", 1, 150).alias("evidence"), failure_category(F.col(body)).alias("category"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("message_id", "idx"))
    few = rows.withColumn("r", rank).where(F.col("r") <= examples).groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "message_id"))), lambda x: x["message_id"]), ",").alias("examples"))
    return rows.groupBy("category").agg(F.count("*").alias("n")).join(few, "category")


def pipeline_report(gated: DataFrame) -> DataFrame:
    """One row: items, quotes, verified share, average confidence, items by status."""
    quotes, ok = F.count_if(F.col("evidence_verified").isNotNull()), F.count_if("evidence_verified")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return gated.agg(F.count("*").alias("items"), quotes.alias("quotes"), ok.alias("verified"), F.round(100.0 * ok / F.greatest(quotes, F.lit(1)), 2).alias("verified_pct"), F.round(F.avg("confidence"), 4).alias("average_confidence"), n("approved"), n("review"), n("rejected"))


def evaluation(scores: DataFrame) -> DataFrame:
    """(field, n, correct_pct, partial_pct, hallucinated_pct, accuracy) from (field, verdict).

    Accuracy counts a partial one half; all are null where nothing was judged.
    """
    n = F.count("verdict")
    share = lambda v: F.round(100.0 * F.count_if(F.col("verdict") == v) / F.nullif(n, F.lit(0)), 1)
    half = F.count_if(F.col("verdict") == "correct") + 0.5 * F.count_if(F.col("verdict") == "partial")
    return scores.groupBy("field").agg(n.alias("n"), share("correct").alias("correct_pct"), share("partial").alias("partial_pct"), share("hallucinated").alias("hallucinated_pct"), F.round(half / F.nullif(n, F.lit(0)), 4).alias("accuracy"))
