"""Where an item's quote stands in its mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.text import collapse, offset_map, squeeze


def _place(n: Column, om: Column) -> Column:
    """The n-th entry (from 1), null outside."""
    return F.get(om, n - 1)


def locate(rows: DataFrame, quote: str = "evidence", body: str = "body") -> DataFrame:
    """rows with char_start, char_end (of the last character) and evidence_verified.

    The quote is looked for with blanks collapsed, then in lower case, and the first match is
    mapped back. A quote of blanks only spans the whole body. Without a quote all three are
    null; without a body the quote counts as not found. The offset map is computed for rows
    whose quote was found only.
    """
    has = F.coalesce(F.length(quote), F.lit(0)) > 0
    text = F.coalesce(F.col(body), F.lit(""))
    rows = rows.withColumn("_q", squeeze(F.col(quote))).withColumn("_b", F.when(has, collapse(text)))
    first = F.expr("locate(_q, _b)")
    rows = rows.withColumn("_at", F.when(~has | (text == ""), F.lit(0)).when(first > 0, first).otherwise(F.expr("locate(lower(_q), lower(_b))")))
    rows = rows.withColumn("_om", F.when(F.col("_at") > 0, offset_map(text)))
    size = F.length("_q")
    start = _place(F.col("_at"), F.col("_om"))
    end = F.when(size == 0, _place(F.size("_om"), F.col("_om"))).otherwise(_place(F.col("_at") + size - 1, F.col("_om")))
    rows = rows.withColumn("_s", start).withColumn("_e", end)
    ok = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    return (
        rows.withColumn("char_start", F.when(ok, F.col("_s")).cast("int"))
        .withColumn("char_end", F.when(ok, F.col("_e")).cast("int"))
        .withColumn("evidence_verified", F.when(has, ok))
        .drop("_q", "_b", "_at", "_om", "_s", "_e")
    )


def totals(located: DataFrame) -> DataFrame:
    """(message_id, total_quotes, verified, unverified) of the items that have a quote."""
    rows = located.where(F.col("evidence_verified").isNotNull())
    return rows.groupBy("message_id").agg(F.count("*").alias("total_quotes"), F.count_if("evidence_verified").alias("verified"), F.count_if(~F.col("evidence_verified")).alias("unverified"))


def unverified_examples(located: DataFrame, most: int = 20) -> DataFrame:
    """The first unverified quotes, in order of message and item, cut to 200 characters."""
    rows = located.where(~F.col("evidence_verified"))
    return rows.orderBy("message_id", "field", "idx").limit(most).select("message_id", "field", "idx", F.substring("evidence", 1, 200).alias("quote"))
