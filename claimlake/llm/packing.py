"""Best-fit packing by non-negative least squares over length patterns.

Pieces (documents, cut only where longer than a sequence) become a histogram of lengths: at
most SEQ bins, whatever the input. The driver enumerates patterns of one to three lengths
that fill a sequence exactly, fits repeat counts to the histogram with projected accelerated
gradient steps (x >= 0), rounds them down, and packs the residual histogram best-fit, longest
first, on grouped counts. Executors then number the pieces of each length and look their
place up in the plan. The numbering salts frequent lengths, so no task holds all rows of one.

Defined cases: null text is empty (one id, the end id); repeated rows are packed as often as
they come (equal rows are interchangeable); an empty table gives an empty result; a null
doc_id is kept as it is. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimlake.llm.text import small_batches
from claimlake.llm.tokens import default_vocabulary, word_ids
from claimlake.scratch import cut

SEQ, END = 2048, 0
STEPS = 150
#: A salted share of one length holds this many rows at most, or one in SEQ of all.
SHARE = 1_000_000


def patterns(seq: int) -> np.ndarray:
    """Rows of three lengths, descending, 0 for none, that sum to seq."""
    a = np.arange(1, seq + 1, dtype=np.int32)
    first, second = (x.ravel() for x in np.meshgrid(a, np.arange(0, seq, dtype=np.int32), indexing="ij"))
    third = seq - first - second
    ok = (first >= second) & (third >= 0) & (second >= third)
    return np.stack([first[ok], second[ok], third[ok]], axis=1)


def fit(hist: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, whole repeat counts) with A x <= hist. hist[l]: pieces of length l."""
    seq = len(hist) - 1
    pats = patterns(seq)
    pats = pats[(hist[pats] > 0).all(axis=1, where=pats > 0)]
    if not len(pats):
        return pats, np.zeros(0, dtype=np.int64)
    target = hist.astype(np.float64)
    target[0] = 0
    cols = [pats[:, i] for i in range(3)]

    def made(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(c, weights=x, minlength=seq + 1) for c in cols)
        y[0] = 0
        return y

    # long lengths are the hard ones to place: weight the residuals by length
    weight = np.arange(seq + 1) / seq
    scale = np.bincount(pats.ravel(), minlength=seq + 1).astype(np.float64)  # patterns that use a length
    step = 1.0 / (3 * max(1.0, (weight * scale)[1:].max()))
    x = np.zeros(len(pats))
    y, t = x, 1.0
    for _ in range(steps):
        r = weight * (made(y) - target)
        r[0] = 0
        new = np.maximum(0.0, y - step * (r[cols[0]] + r[cols[1]] + r[cols[2]]))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    # largest counts first, never more than the histogram still has
    left = hist.astype(np.int64).copy()
    counts = np.zeros(len(pats), dtype=np.int64)
    for k in np.argsort(-x, kind="stable")[: 64 * seq]:
        n = int(x[k] + 0.5)
        if n < 1:
            break
        need: dict[int, int] = {}
        for length in pats[k]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        n = min(n, *(int(left[length]) // m for length, m in need.items()))
        if n > 0:
            counts[k] = n
            for length, m in need.items():
                left[length] -= n * m
    return pats, counts


def best_fit(left: np.ndarray) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts: (lengths, number of equal sequences)."""
    seq = len(left) - 1
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_at = np.zeros(seq + 1, dtype=bool)  # rooms with open sequences
    for length in range(seq, 0, -1):
        n = int(left[length])
        while n > 0:
            fits = np.flatnonzero(open_at[length:])
            if not len(fits):
                per = min(n, seq // length)
                whole, rest = divmod(n, per)
                groups = [((length,) * per, whole)] + ([((length,) * rest, 1)] if rest else [])
                n = 0
            else:
                at = length + int(fits[0])
                held, k = room[at].pop()
                per = min(at // length, n)
                used = min(k, n // per)
                groups = [(held + (length,) * per, used)]
                n -= used * per
                if k > used:
                    room[at].append((held, k - used))
                open_at[at] = bool(room[at])
            for items, k in groups:
                space = seq - sum(items)
                room.setdefault(space, []).append((items, k))
                open_at[space] = space > 0
    return [(list(items), k) for groups in room.values() for items, k in groups]


def plan(hist: np.ndarray) -> dict[str, np.ndarray]:
    """Slots by (length, first rank): where the pieces of a length go, in order of rank."""
    pats, counts = fit(hist)
    chosen = [([int(v) for v in pats[k] if v], int(counts[k])) for k in np.flatnonzero(counts)]
    left = hist.astype(np.int64).copy()
    for items, n in chosen:
        for v in items:
            left[v] -= n
    left[0] = 0
    slots: list[tuple[int, int, int, int]] = []
    seen = np.zeros(len(hist), dtype=np.int64)
    base = 0
    for items, n in chosen + best_fit(left):
        at = 0
        for v in items:
            slots.append((v, int(seen[v]), base, at))
            seen[v] += n
            at += v
        base += n
    slots.sort()
    cols = np.array(slots, dtype=np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "rank": cols[:, 1], "base": cols[:, 2], "offset": cols[:, 3], "sequences": np.array([base])}


def token_pieces(docs: DataFrame, vocabulary: str | None = None, seq: int = SEQ, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document of (doc_id, text)."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    docs = docs.select("doc_id", "text")
    tail = end.to_bytes(4, "little")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut_up(batches):
        words = word_ids(path)
        for b in batches:
            rows, doc_rows = [], []
            for k, text in enumerate(b.column(1)):
                blob = words.encode(text.as_py() or "") + tail
                n = len(blob) // 4
                for piece, at in enumerate(range(0, n, seq)):
                    part = blob[4 * at : 4 * min(n, at + seq)]
                    rows.append((piece, at, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                    doc_rows.append(k)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [b.column(0).take(pa.array(doc_rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.binary())] * keep_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.mapInArrow(cut_up, schema)


def pack(pieces: DataFrame, seq: int = SEQ, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a table with a column length, 1 to seq.

    Read three times: give a written table.
    """
    spark = pieces.sparkSession
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # seq rows at most
    hist = np.zeros(seq + 1, dtype=np.int64)
    for r in found:
        hist[r["length"]] = r["n"]
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    if not hist.sum():
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(plan(hist))
    # salts a length: no share is larger than SHARE rows or one in seq of all rows
    share = max(1, min(SHARE, int(hist.sum()) // seq))
    salts = spark.createDataFrame([(int(v), int(-(-hist[v] // share))) for v in np.flatnonzero(hist)], "_length long, _salts long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_length")).withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts"))).drop("_length", "_salts")
    sizes = salted.groupBy(F.col("length").alias("_l"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    before = sizes.select("_l", "_s", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_rank", rank.cast("long")).join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = pieces.columns

    def place(batches):
        p = shared.value
        ends = np.searchsorted(p["length"], np.arange(seq + 2))
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):  # rows come sorted by length: few in a batch
                own = length == v
                at[own] = ends[v] + np.searchsorted(p["rank"][ends[v] : ends[v + 1]], rank[own], side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(p["base"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): the packed pieces of each sequence, joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(cut(token_pieces(docs), "pieces"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
