"""Connected components of a distributed edge table (large-star / small-star).

Every round replaces the edges of a node by edges to the smallest node it can see.
Nothing but two counts reaches the driver. A hub's rows meet in a join (which AQE
may split) and in a min() that is combined before the shuffle. A table of at most FEW
edges, counted first, is settled by union-find in one task instead: rounds over so few
rows are all start-up.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.scratch import cut, drop

FEW = 10_000


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges (hi, lo), hi > lo."""
    if small:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    else:
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    seen = near.join(least, "u")
    if small:
        out = seen.select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").unionAll(seen.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    else:
        out = seen.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return out.distinct()


def _settled(edges: DataFrame) -> DataFrame:
    """(hi, lo): each node that isn't its component's smallest, and that one."""

    def run(batches):
        root: dict = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lo, hi = sorted((find(x), find(y)))
                root[hi] = lo
        found = [(x, r) for x in list(root) if (r := find(x)) != x]
        yield pa.RecordBatch.from_pydict({"hi": [x for x, _ in found], "lo": [r for _, r in found]}, schema=arrow)

    arrow = pa.schema([("hi", _arrow(edges)), ("lo", _arrow(edges))])
    return edges.coalesce(1).mapInArrow(run, edges.schema)


def _arrow(edges: DataFrame) -> pa.DataType | None:
    """Of the nodes; None for other kinds of ids, which take the rounds."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(dict(edges.dtypes)["hi"])


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for each node of an undirected edge table.

    component is the smallest node reachable. Self-loops and repeated edges do no harm, rows
    with a null end are ignored, and a node without an edge to another one has no row.
    """
    ends = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    links = cut(edges.where(F.col(a) != F.col(b)).select(*ends).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    now, before = mark(links), None
    if 0 < now[0] <= FEW and _arrow(links):
        links, before = cut(_settled(links), "star"), now
    while now[0] and now != before:
        old, before = links, now
        links = cut(_star(_star(old, small=False), small=True), "star")
        now = mark(links)
        drop(old)
    # a root stands only at the low end of its star
    stars = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionAll(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
