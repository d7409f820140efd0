"""Quality rules as a ledger of failure bits, in DataFrame operations.

ledger() measures every text once and sets one bit for each rule it fails, whether or not a
policy uses the rule. A policy is a version, a mask and a number of tolerated failures;
apply_policy() and ablations() read only the bits, so a new policy needs no new pass over
texts.

Defined cases: null text has no words and fails TOO_SHORT; an empty table gives empty
results; repeated rows are judged one by one; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Rules by bit: name and SQL condition for a failure, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("word_length", "n_words >= 10 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("few_letters", "10 * n_letters < 4 * word_chars"),
    ("stutter", "10 * n_stutter > 3 * n_words"),
)
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails more than tolerated of the rules in mask, or any in hard."""

    version: str
    mask: int
    hard: int = 0
    tolerated: int = 0


POLICIES = (
    Policy("base", BASE),
    Policy("v1", (1 << len(RULES)) - 1),
    Policy("lenient", (1 << len(RULES)) - 1, hard=BASE, tolerated=1),
)
CURRENT = POLICIES[1]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: inside a lambda a plain column would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _covered(words: Column) -> Column:
    """Words in windows that occur twice or more, comparing the windows' text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i")))

    def places(a: Column) -> Column:
        def again(x: Column, k: Column) -> Column:
            return F.struct(x["i"].alias("i"), (F.coalesce(F.get(a, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(a, k + 1)["w"] == x["w"], F.lit(False))).alias("again"))

        return F.sort_array(F.transform(F.filter(F.transform(a, again), lambda x: x["again"]), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        # a window covers its words up to the next such window
        steps = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda x, y: x + y)

    return let(F.sort_array(windows), lambda a: let(places(a), covered))


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of (doc_id, text), each text read once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_words", F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    # hashes tell the many texts without a repeated window apart; the others compare text
    rows = rows.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_h")
    windows = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
    rows = rows.withColumn("_w", windows)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", pattern, "")).cast("long")

    repeated = F.when(F.size("_w") > F.size(F.array_distinct("_w")), _covered(F.col("_words"))).otherwise(F.lit(0))
    return rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        left(BLANK).alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter(h, lambda x, i: F.get(h, i - 1) == x)).cast("long").alias("n_stutter"),
        left(r"[^\p{L}]+").alias("n_letters"),
        left(r"[^\p{Lu}]+").alias("n_upper"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """measure() with failures: a long with bit k set where RULES[k] fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs).withColumn("failures", failures.cast("long"))


def apply_policy(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """book with policy (its version) and kept."""
    failed = F.bit_count(F.col("failures").bitwiseAND(F.lit(policy.mask)))
    hard = F.col("failures").bitwiseAND(F.lit(policy.hard)) != 0
    return book.withColumn("policy", F.lit(policy.version)).withColumn("kept", ~hard & (failed <= policy.tolerated))


def ablations(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """One row a rule: documents that fail it, that only it rejects, and kept without it.

    One pass over the bits; the sums are combined before the shuffle.
    """
    held = F.col("failures").bitwiseAND(F.lit(policy.mask))
    sums = [F.count("*").alias("n"), F.count_if(held == 0).alias("kept")]
    for k in range(len(RULES)):
        bit = F.lit(1 << k)
        sums += [F.count_if(F.col("failures").bitwiseAND(bit) != 0).alias(f"f{k}"), F.count_if(held == bit).alias(f"o{k}")]
    sums += [F.bit_or("failures").alias("any_failed"), F.bit_and("failures").alias("all_failed")]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("bit"), F.lit(name).alias("rule"), F.col(f"f{k}").alias("failed"), F.col(f"o{k}").alias("only"), (F.col("kept") + F.col(f"o{k}")).alias("kept_without")) for k, (name, _) in enumerate(RULES))))
    return book.agg(*sums).select("n", "kept", "any_failed", "all_failed", rows.alias("r")).select("r.*", "n", "kept", "any_failed", "all_failed")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = apply_policy(book)
    base = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL = {
    "op5_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)),
r as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) n from g) where n > 1),
c as (select doc_id, sum(least(5, coalesce(nx - i, 5))) c from (select *, lead(i) over (partition by doc_id order by i) nx from r) group by 1),
m as (select doc_id, len(w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(c, 0) n_repeat_words, len(l) n_lines, len(list_filter(w, lambda x, i: i > 1 and w[i - 1] = x)) n_stutter,
  length(regexp_replace(t, '[^\p{L}]+', '', 'g')) n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) n_upper
  from w left join c using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
 not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or 2 * n_upper > word_chars
  or (n_words >= 10 and (word_chars < 2 * n_words or word_chars > 15 * n_words)) or 10 * n_letters < 4 * word_chars or 10 * n_stutter > 3 * n_words) kept
from b
""",
}
