"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

1. language: documents whose language can't be told (no letter, or less than half of the
   evidence for one language) go.
2. lines: each fuzzy line stays in its first place only; a document without lines left goes.
3. near_duplicates: of each group of near copies (SimHash groups of five-word shingles, checked
   and completed at Jaccard 0.8) the row with the smallest id stays.
4. mix: sources to their target weights; a document comes as often as the mix takes it, the
   last one of a source by rounding.
5. pack: token ids of all documents into sequences of at most 2048.

Defined cases, in every stage: rows are told apart by id and text, so rows that share an id, or
have none, with different texts stay rows of their own; exact repeats of a row are kept or
dropped together until near_duplicates leaves one. Null, empty and wordless texts have no
language and go in the first stage. Of near copies with one smallest id the smallest text key
stays, null ids come last; a null source is a source of its own. Extra columns, whatever their
names, are kept up to mix. An empty table gives an empty result.

run() has no SQL counterpart (language model, signatures, tokenizer, pattern fit): the tests
hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import language, lines, mixing, near, packing
from claimlake.scratch import cut

LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are ``und`` or score below LEAST_SCORE; lang stays as given."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    found = language.predict(docs, model, lang_col="_lang_pred", score_col="_score")
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def keep_first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(docs, lines.dedup_lines(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id (null last), of its texts the smallest key."""
    names = docs.columns
    found = cut(near.near_copies(docs), "near")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "text_key")).alias("x"))
    kept = first.select(F.col("x.id").alias("_id"), F.col("x.text_key").alias("_key"))
    docs = docs.withColumn("_text", lines.text_key(F.col("text")))
    # exact repeats of a row share its id and text
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))).dropDuplicates(["_id", "_key"]).select(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mixing.take(mixing.mix(docs, labels, rows=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(cut(packing.token_pieces(docs), "pieces"))


STAGES = [
    ("language", keep_known_language),
    ("lines", keep_first_lines),
    ("near_duplicates", keep_one_of_group),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
