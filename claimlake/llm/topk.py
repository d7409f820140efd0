"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned and sorted by length, so each task reads buckets (Arrow
batches) of similar length. Queries come in blocks of BLOCK, a size bound for what driver and
tasks hold; a block is searched and its best ones written before the next one is read. A query
starts with the k-th best score among the SEEDS longest vectors. In a bucket with greatest length m, a query needs cosine >= threshold / (|q| m): above 1 the bucket
is skipped (length pruning); above COSINE, only vectors whose coordinate along the query's
largest component lies in the range that this cosine allows are multiplied (coordinate
pruning); otherwise the whole bucket is. Products are exact: in float64 where all sums stay
below 2^53, else in Python integers, held within 64 bits.

Defined cases: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; rows that repeat a query's id are not its candidates, and one of them
(the smallest) is the query; other repeated rows are candidates of their own; only vectors of
a query's dimension are its candidates; ties go to the smaller id; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimlake.llm.text import large_batches
from claimlake.scratch import cut, new_path

K, EVERY, SCALE = 10, 100, 1024.0
BLOCK, SEEDS, BUCKET, COSINE = 8192, 2048, 2048, 0.6
#: Queries multiplied at once, a bound for a task's memory.
ROWS = 512
LOW, LARGE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SCHEMA = "query_id long, vec_id long, score long"


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for whole numbers, as exact long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() < 2.0**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(v) for v in r] for r in m], dtype=object) for m in (a, b))
    return np.array([[min(max(int(v), LOW + 1), LARGE) for v in r] for r in x @ y.T], dtype=np.int64).reshape(len(a), len(b))


def _norm(e: Column) -> Column:
    return F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(SCALE) * x.cast("double")).cast("double"), F.lit(2.0))))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, norm) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.withColumn("dim", F.size("embedding")).withColumn("norm", _norm(F.col("embedding")))


class _Best:
    """The k best (score, id) so far of each query."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q = self.id = self.s = np.zeros(0, dtype=np.int64)
        self.n = n

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        q, ids, s = (np.concatenate(x) for x in ((self.q, q), (self.id, ids), (self.s, s)))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.id, self.s = q[keep], ids[keep], s[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def _scan(best: _Best, qid: np.ndarray, q: np.ndarray, qnorm: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
    """Put one bucket's candidates into best."""
    lengths = np.linalg.norm(v, axis=1)
    most = lengths.max(initial=0.0)
    # a little slack, as lengths are rounded
    alive = np.flatnonzero(best.floor <= qnorm * most * (1 + 1e-9) + 1e-6)
    if not len(alive):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((qnorm[alive] * most > 0) & (best.floor[alive] > 0), best.floor[alive] / (qnorm[alive] * most), -1.0)
    focus = np.flatnonzero(need > COSINE)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(focus):
        share = v / np.maximum(lengths, 1e-300)[:, None]
    for i in alive[focus]:
        t = min(1.0, best.floor[i] / (qnorm[i] * most) - 1e-9)
        f = int(np.argmax(np.abs(q[i])))
        c = q[i, f] / qnorm[i]
        spread = (max(0.0, (1 - t * t) * (1 - c * c))) ** 0.5 + 1e-6
        # outside the range no vector of the bucket reaches cosine t with the query
        at = share[:, f]
        # the range ends at +-1 where the query's own direction along f is that close to the axis
        low = -1.0 if -c >= t else t * c - spread
        high = 1.0 if c >= t else t * c + spread
        near = np.flatnonzero((at >= low) & (at <= high) & (ids != qid[i]))
        s = products(q[i : i + 1], v[near])[0]
        ok = s >= best.floor[i]
        hits.append((np.full(int(ok.sum()), i), ids[near[ok]], s[ok]))
    if hits:  # the lists of best ones are sorted once a bucket
        best.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))
    plain = np.setdiff1d(alive, alive[focus], assume_unique=True)
    for k in range(0, len(plain), ROWS):
        part = plain[k : k + ROWS]
        s = products(q[part], v)
        s[qid[part][:, None] == ids[None, :]] = LOW
        row, col = np.nonzero((s >= best.floor[part][:, None]) & (s > LOW))
        if len(row) > 4 * best.k * len(part):
            # cut each row to its k best first; ids ascend within a bucket, so ties go to the smaller
            take = min(best.k, s.shape[1])
            order = np.argsort(-s, axis=1, kind="stable")[:, :take]
            row = np.repeat(np.arange(len(part)), take)
            col = order.ravel()
            ok = (s[row, col] > LOW) & (s[row, col] >= best.floor[part][row])
            row, col = row[ok], col[ok]
        if len(row):
            best.add(part[row], ids[col], s[row, col])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) for (vec_id, embedding)."""
    spark = rows.sparkSession
    found = cut(vectors(rows).repartitionByRange(F.desc("norm"), F.col("vec_id")).sortWithinPartitions(F.desc("norm"), "vec_id"), "vectors")
    asked = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("v")).select("vec_id", "v.dim", "v.embedding")
    asked = cut(asked, "queries")
    blocks = -(-asked.count() // BLOCK)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = found.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in longest}:
        own = [r for r in longest if r["dim"] == dim]
        seeds[dim] = (np.array([r["vec_id"] for r in own], dtype=np.int64), whole(np.array([r["embedding"] for r in own], dtype=np.float64).reshape(len(own), dim)))
    path = new_path(spark, "best")
    for block in range(blocks):
        by: dict[int, tuple] = {}
        got = asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == block).collect()  # about BLOCK rows
        for dim in {r["dim"] for r in got}:
            own = [r for r in got if r["dim"] == dim]
            qid = np.array([r["vec_id"] for r in own], dtype=np.int64)
            q = whole(np.array([r["embedding"] for r in own], dtype=np.float64).reshape(len(own), dim))
            floor = np.full(len(own), LOW, dtype=np.int64)
            if dim in seeds and len(seeds[dim][0]) > k:
                ids, v = seeds[dim]
                for at in range(0, len(own), ROWS):
                    s = products(q[at : at + ROWS], v)
                    s[qid[at : at + ROWS][:, None] == ids[None, :]] = LOW
                    floor[at : at + ROWS] = np.sort(s, axis=1)[:, -k]
            by[dim] = (qid, q, np.linalg.norm(q, axis=1), floor)
        shared = spark.sparkContext.broadcast(by)
        with large_batches(spark, BUCKET):
            found.select("vec_id", "embedding", "dim").mapInArrow(_searcher(shared, k), SCHEMA).write.mode("append").parquet(path)
        shared.destroy()  # the next block takes its place
        del by, got
    merged = spark.read.schema(SCHEMA).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int):
    def search(batches):
        by = shared.value
        best = {dim: _Best(len(x[0]), k, x[3]) for dim, x in by.items()}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in by:
                    continue
                own = pa.array(np.flatnonzero(dims == dim))
                ids = b.column(0).take(own).to_numpy()
                v = _matrix(b.column(1).take(own), dim)
                order = np.argsort(ids, kind="stable")
                _scan(best[dim], *by[dim][:3], ids[order], v[order])
        for dim, x in best.items():
            if len(x.q):
                yield pa.record_batch({"query_id": pa.array(by[dim][0][x.q]), "vec_id": pa.array(x.id), "score": pa.array(x.s)})

    return search


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_exact_topk": op7_exact_topk}
SQL = {
    "op7_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint score from v q join v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
}
