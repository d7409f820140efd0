"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id, so file k holds ids below those of file k+1 and every
file is sorted: readers skip stripes and row groups by the id's minimum and maximum, and a
lookup of one id asks its Bloom filter. A row holds a document's ids as array<int> (ORC's
run-length encoding takes about two bytes an id here), its place within the file and the
number of the file. start() adds what the earlier files hold: one row a file.

Defined cases: null text is empty (only the end id); equal ids keep all their rows, in order
of the text's hash; null ids come first; an empty table writes no rows. Extra columns are not
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlake.llm.text import small_batches
from claimlake.llm.tokens import default_vocabulary, word_ids
from claimlake.scratch import new_path

END = 2
#: ids to an Arrow batch sent back, about
BATCH = 1 << 20
OPTIONS = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write the ids of (doc_id, text), in order of doc_id, to ORC files under path."""
    small_batches(docs.sparkSession)
    vocab = vocabulary or default_vocabulary()
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = end.to_bytes(4, "little")

    def encode(batches):
        words, file, start = word_ids(vocab), TaskContext.get().partitionId(), 0

        def out(ids, blobs, first):
            sizes = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            return pa.RecordBatch.from_arrays([ids, pa.array([file] * len(blobs), pa.int32()), pa.array(first + ends - sizes), pa.array(sizes), lists], names=["doc_id", "file", "file_start", "n_tokens", "ids"])

        for b in batches:
            blobs, at, held = [], 0, 0
            for k, text in enumerate(b.column(1)):
                blobs.append(words.encode(text.as_py() or "") + tail)
                held += len(blobs[-1]) // 4
                if held >= BATCH or k == b.num_rows - 1:
                    yield out(b.column(0).slice(at, len(blobs)), blobs, start)
                    start, at, blobs, held = start + held, k + 1, [], 0

    found = rows.mapInArrow(encode, f"doc_id {kind}, file int, file_start long, n_tokens long, ids array<int>")
    found.write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start: the ids of all documents before."""
    rows = spark.read.orc(path)
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    # one row a file, not a document
    before = sums.select("file", (F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", (F.col("_before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32 for ids: unsigned crc32 of little-endian unsigned 32-bit ids."""
    small_batches(rows.sparkSession)
    at = rows.columns.index("ids")
    rest = [c for c in rows.columns if c != "ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "ids") + ", ids_crc32 long"

    def crc(batches):
        for b in batches:
            lists = b.column(at)
            values, ends = np.asarray(lists.values, dtype="<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(sums, pa.int64())], names=[*rest, "ids_crc32"])

    return rows.mapInArrow(crc, schema)


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return checksums(read(spark, path))


QUERIES = {"op4_token_orc": op4_token_orc}
SQL: dict[str, str] = {}
