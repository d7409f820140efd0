"""SimHash near-dedup (simhash.py) with an exact check, for the corpus pipeline.

Two texts are near copies if the sets of their shingles (WORDS words, A-Z lower-cased, split at
the six ASCII blanks; a shorter text is one shingle) have a Jaccard of SIMILAR or more.
Fingerprints of these shingles and their anchors give groups of texts that differ in few
places. 64 bits don't tell Jaccard 0.8 from less, and at 2 bits only a few of the pairs of that
similarity are linked, so each group is checked on whole sets and the search is completed: a
group is one more band beside those of a MinHash signature, and lines.fuzzy_labels compares the
texts of all bands. At Jaccard 0.8 a pair meets with a chance of 1 - (1 - 0.8^4)^16 = 99.98 %.

Defined cases: texts of the same words are one text, also null, empty and blank ones; null ids
are ordinary; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.llm import shingles, simhash
from claimlake.llm.lines import FEW, band_lists, fuzzy_labels, held, one_text, sieve, text_key
from claimlake.llm.text import small_batches
from claimlake.scratch import cut

SIMILAR, BANDS, WIDTH, TINY = 0.8, 16, 4, 3


def _words(data: bytes) -> bytes:
    return b" ".join(data.lower().split())


def _digest(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    return np.fromiter((digest(w, 1) for w in words), np.uint64, len(words))


def _bytes(docs: DataFrame):
    return F.coalesce("text", F.lit("")).cast("binary").alias("text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, n, bands, fp) of each row; line: the key that texts of the same words share."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), _bytes(docs))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            words = [_words(t.as_py()) for t in b.column(2)]
            parts = [shingles.signatures(shingles.word_sets(words[s]), s.stop - s.start, BANDS, WIDTH) for s in shingles.groups([len(x) for x in words])]
            n, bands = band_lists(parts, TINY)
            prints = np.fromiter((simhash.fingerprint(w, shingles.WORDS) for w in words), np.uint64, len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_digest(words).view(np.int64)), pa.array(n), bands, pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "line", "n", "bands", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, line long, n int, bands array<long>, fp long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted texts, as words split by single blanks."""
    bits = docs.sparkSession.sparkContext.broadcast(sieve(wanted, "line"))

    def run(batches):
        for b in batches:
            words = [_words(t.as_py()) for t in b.column(0)]
            keys = _digest(words)
            own = np.flatnonzero(held(bits.value, keys)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys[own].view(np.int64)), pa.array([words[k] for k in own], pa.binary())], names=["line", "text"])

    return one_text(docs.select(_bytes(docs)).mapInArrow(run, "line long, text binary"), wanted)


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, component) of each row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs), "signatures")
    groups = simhash.groups(cut(signed.select("fp").distinct(), "prints"))
    banded = signed.join(_few(groups), "fp", "left").withColumn("group", F.xxhash64(F.coalesce("component", "fp"), F.lit("simhash")))
    texts = cut(banded.select("line", "n", F.array_append("bands", F.col("group")).alias("bands")), "texts-bands")
    found = cut(fuzzy_labels(docs, texts, similar, _texts, shingles.word_sets).where("label <> line"), "labels")
    named = signed.select("doc_id", "text_key", "line").join(_few(found), "line", "left")
    return named.select("doc_id", "text_key", F.coalesce("label", "line").alias("component"))


def _few(rows: DataFrame) -> DataFrame:
    """rows, broadcast if few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows
