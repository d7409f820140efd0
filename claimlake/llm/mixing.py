"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Targets: sources share the budget by weight, each at most CAP times its size; what a capped
source leaves goes to the others by weight. The level at which that settles is found with
running sums over the sources in order of size / weight, without iterating.

Draw: a document's key is -ln(u) / quality, u from the md5 of seed and id, so reruns agree
and better documents come first more often. A source takes whole epochs first; the rest of
its target goes to its documents in order of key, by a prefix sum of sizes, the last one in
part. Prefix sums run in two levels over slices of the key range, and a source has the more
slices the more rows it has: no task holds all rows of a source. Slices are even in the
distribution of the source's own keys, a mixture over its shares of good, poor and other
documents, so they hold about the same number of rows whatever the shares are.

Defined cases: null text has size 0; null source is a source of its own, last; documents
without a row in labels have quality 1; a null id draws like an empty one; repeated rows are
documents of their own (equal ids share a key, order among equal rows doesn't show); an empty
table, or one without words, takes nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlake.scratch import cut

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix"
WORDS = r"[^\x20\x09-\x0D]+"
#: Slices over all sources: one holds about this share of all rows, or SLICE_ROWS.
SLICES, SLICE_ROWS = 2048, 1_000_000
#: Rows of a table that is broadcast, at most.
FEW = 20_000
#: Relative chances of documents labelled good and poor.
GOOD, POOR = 2.0, 0.5


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, n, source_size, weight, target) from (source, n, source_size): one row a source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cases = F.lit(float(weights[-1]))
    for k in range(len(weights) - 2, -1, -1):
        cases = F.when(place % len(weights) == k, float(weights[k])).otherwise(cases)
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    t = sizes.withColumn("weight", cases)
    t = t.withColumn("_budget", share * F.sum("source_size").over(whole))
    t = t.withColumn("_full", cap * (F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")))
    t = t.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_rest"))
    # the first source, by size / weight, that the level doesn't fill settles it for all after it
    open_ = F.col("_level") * F.col("weight") <= cap * F.col("source_size")
    t = t.withColumn("_at", F.min(F.when(open_, F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("l")))).over(whole)["l"])
    return t.select("source", "n", "source_size", "weight", F.least(F.coalesce(F.col("_at") * F.col("weight"), F.lit(float("inf"))), (cap * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, rows: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of (doc_id, text, source).

    quality: (doc_id, quality) with 1 good and 0 poor. taken: words the mix takes, repeats counted.
    rows: with the whole row of docs, as a struct row.
    """
    carried = [F.struct("*").alias("row")] if rows else []
    rows = docs.select("doc_id", "source", size(F.col("text")).alias("size"), *carried)
    if quality is not None:
        known = quality.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
        rows = rows.join(known, "doc_id", "left").withColumn("_q", F.when(F.col("_q") > 0, GOOD).when(F.col("_q") <= 0, POOR).otherwise(1.0))
    else:
        rows = rows.withColumn("_q", F.lit(1.0))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 1) / float(2**52 + 1)
    rows = cut(rows.withColumn("_key", -F.ln(u) / F.col("_q")), "sizes")
    kinds = (GOOD, 1.0, POOR)
    sums = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), *(F.count_if(F.col("_q") == q).alias(f"_n{k}") for k, q in enumerate(kinds)))
    # rows from tables that hold each source once
    sums = cut(sums, "sums")
    sources = targets(sums.select("source", "n", "source_size"), weights, share, cap)
    sources = sources.join(sums.select(F.col("source").alias("_of"), *(f"_n{k}" for k in range(len(kinds)))), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    n = F.sum("n").over(Window.partitionBy())
    sources = sources.withColumn("_slices", F.ceil(F.col("n") / F.least(F.greatest(F.ceil(n / SLICES), F.lit(1)), F.lit(SLICE_ROWS))))
    sources = cut(sources, "sources")
    # one row a source, and one a slice: broadcast where few, else joined by shuffling
    sources_n, slices_n = sources.agg(F.count("*"), F.coalesce(F.sum("_slices"), F.lit(0))).first()
    s = sources.select(F.col("source").alias("_source"), "n", "source_size", "target", "_slices", *(f"_n{k}" for k in range(len(kinds))))
    s = F.broadcast(s) if sources_n <= FEW else s
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the distribution function of the source's keys: monotone, and even over 0 to 1
    below = sum((F.col(f"_n{k}") * (1 - F.exp(-q * F.col("_key"))) for k, q in enumerate(kinds)), F.lit(0.0)) / F.col("n")
    rows = rows.withColumn("_slice", F.least(F.floor(F.col("_slices") * below), F.col("_slices") - 1))
    sums = rows.groupBy(F.col("source").alias("_source"), F.col("_slice").alias("_at")).agg(F.sum("size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    before = F.broadcast(before.drop("_sum")) if slices_n <= FEW else before.drop("_sum")
    inner = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inner) - F.col("size"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_at")))
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    rest = whole - epochs * F.col("source_size") - F.col("_before") - F.col("_in")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carried else []))


def take(mixed: DataFrame) -> DataFrame:
    """The rows of mix(rows=True) as often as the mix takes them, the last document of a source by rounding."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    found = mixed.select("row", copies.alias("copies")).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mix(docs, labels).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mix_sources": op2_mix_sources}
SQL = {
    "op2_mix_sources": r"""
with q as (select doc_id, max(quality) q from labels where doc_id is not null and quality is not null group by 1),
d as (select d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
  -ln((cast('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13) as bigint)::double + 1) / (power(2, 52) + 1))
   / case when q > 0 then 2.0 when q <= 0 then 0.5 else 1.0 end::double k
  from documents d left join q using (doc_id)),
s as (select source, sum(size)::bigint ss, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end)::double w from d group by source),
f as (select *, (1.5 * sum(ss) over () - 2 * (sum(ss) over o - ss))::double / sum(w) over (order by ss / w, source nulls last rows between current row and unbounded following) l
  from s window o as (order by ss / w, source nulls last rows between unbounded preceding and current row)),
t as (select source, ss, least(coalesce((select arg_min(l, (ss / w, source)) from f where l * w <= 2 * ss) * w, 2.0 * ss), 2.0 * ss)::double t from f),
r as (select doc_id, size, ss, t, sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and current row) - size p
  from d join t on d.source is not distinct from t.source)
select doc_id, size, ss source_size, t target,
 (case when ss > 0 then floor(floor(t) / ss) else 0 end * size
  + greatest(0, least(size, floor(t) - case when ss > 0 then floor(floor(t) / ss) else 0 end * ss - p)))::bigint taken from r
""",
}
