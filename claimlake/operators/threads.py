"""Conversations rebuilt from reply headers or, without any, from subjects.

Ties in date keep ingest order: ord is any sortable column that gives it.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions.text import strip, subject_form
from claimlake.scratch import cut, drop


def has_headers(mails: DataFrame) -> bool:
    """Whether any mail names a mail that it answers: then headers thread all of them."""
    row = mails.agg(F.max(F.coalesce(F.length("in_reply_to") > 0, F.lit(False)) | F.coalesce(F.size("references") > 0, F.lit(False))).alias("any")).first()
    return bool(row["any"])


def parents(mails: DataFrame) -> DataFrame:
    """(message_id, parent): In-Reply-To, else the last reference; null without either."""
    parent = F.when(F.length("in_reply_to") > 0, strip(F.col("in_reply_to"))).when(F.size("references") > 0, strip(F.element_at("references", -1)))
    return mails.select("message_id", parent.alias("parent"))


def _follow(edges: DataFrame, n: int, want_all: bool) -> DataFrame:
    """(node, at) after following parents by doubling until nothing moves, or 2^k >= n steps."""
    now = cut(edges.select(F.col("message_id").alias("node"), F.col("parent").alias("at")), "thread-steps")
    for _ in range(max(1, ceil(log2(n + 1)))):
        nxt = now.select(F.col("node").alias("at"), F.col("at").alias("far"))
        step = cut(now.join(nxt, "at", "left").select("node", F.coalesce("far", "at").alias("at"), F.col("far").isNotNull().alias("moved")), "thread-steps")
        drop(now)
        now = step.select("node", "at")
        if want_all and not step.where("moved").limit(1).count():
            break
    return now


def roots(edges: DataFrame) -> DataFrame:
    """(message_id, root) for (message_id, parent), one row an id, parent not null.

    A root may lie outside the table. A node on a cycle is its own root; a chain that enters a
    cycle ends at the node where it enters.
    """
    edges = cut(edges, "thread-edges")
    n = edges.count()
    if not n:
        return edges.select("message_id", F.col("parent").alias("root"))
    found = _follow(edges, n, want_all=True)
    # after n steps or more, what still has a parent stands on a cycle, and each cycle node is stood on
    ring = cut(found.join(edges.select(F.col("message_id").alias("at")), "at", "left_semi").select(F.col("at").alias("message_id")).distinct(), "thread-ring")
    if ring.limit(1).count():
        tails = edges.join(ring, "message_id", "left_anti")
        found = _follow(tails, n, want_all=True) if tails.limit(1).count() else found.limit(0)
        found = found.unionAll(ring.select(F.col("message_id").alias("node"), F.col("message_id").alias("at")))
    return found.select(F.col("node").alias("message_id"), F.col("at").alias("root"))


def _numbered(rows: DataFrame, key: str, ord: tuple[str, ...]) -> DataFrame:
    """rows with position, the place within key by date and ord, and first, the id at place 0.

    Rows are dealt by range of key and order, so a key that very many mails share has slices in
    many tasks; each slice is numbered alone, after the rows of the key's slices before it.
    """
    order = [F.coalesce("date", F.lit("9999")), *ord]
    dealt = cut(rows.repartitionByRange(key, *order).withColumn("_slice", F.spark_partition_id()), "dealt")
    slices = dealt.groupBy(key, "_slice").agg(F.count("*").alias("_n"), F.min_by("message_id", F.struct(*order)).alias("_first"))
    before = Window.partitionBy(key).orderBy("_slice")
    start = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.select(key, "_slice", start.alias("_start"), F.first("_first").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(*order))
    return dealt.join(slices, [key, "_slice"]).withColumn("position", (F.col("_start") + rank - 1).cast("int")).select(*rows.columns, "position", "first")


def by_headers(mails: DataFrame, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(thread_id, message_id, position); of rows that share an id the last counts."""
    mails = mails.where("message_id is not null and message_id <> ''")
    last = Window.partitionBy("message_id").orderBy(*(F.desc(c) for c in ord))
    mails = mails.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    found = roots(parents(mails).where("parent is not null"))
    rows = mails.select("message_id", "date", *ord).join(found, "message_id", "left")
    return _numbered(rows.withColumn("thread_id", F.coalesce("root", "message_id")), "thread_id", ord).select("thread_id", "message_id", "position")


def by_subject(mails: DataFrame, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(thread_id, message_id, position); mails without a subject stand alone."""
    mails = mails.where("message_id is not null and message_id <> ''")
    rows = mails.select("message_id", "date", *ord, subject_form(F.col("subject")).alias("_s"))
    # the two kinds of key can't meet: a subject's has a prefix that an id's hasn't
    key = F.when(F.col("_s") == "", F.concat(F.lit("i:"), F.col("message_id"))).otherwise(F.concat(F.lit("s:"), F.col("_s")))
    return _numbered(rows.withColumn("_key", key), "_key", ord).select(F.col("first").alias("thread_id"), "message_id", "position")


def rebuild(mails: DataFrame, ord: tuple[str, ...] = ("ord",)) -> DataFrame:
    return by_headers(mails, ord) if has_headers(mails) else by_subject(mails, ord)


def stats(threads: DataFrame) -> DataFrame:
    """(total_threads, single_message_threads, multi_message_threads, largest_thread)."""
    sizes = threads.groupBy("thread_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("total_threads"), F.count_if(F.col("n") == 1).alias("single_message_threads"), F.count_if(F.col("n") > 1).alias("multi_message_threads"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_thread"))
