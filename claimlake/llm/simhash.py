"""SimHash near-duplicates by anchor-point covering.

fingerprints(): 64 bits a text, from XXH64 of word shingles. links(): pairs of distinct
fingerprints that differ in T = 2 bits or fewer, found at anchors. The anchors are the pairs
of codewords of the binary Golay code [23,12] over bits 0-22 and 23-45; the code is perfect
with covering radius 3, so a fingerprint has one home anchor, at 3 bits or less in each half.
If x and y differ in 2 bits or fewer, y is within 3 + d1 and 3 + d2 of x's home, d1 + d2 <= 2.
Each fingerprint is sent to all such anchors (about 61 of 16.8 million) and every anchor
compares its homes with all that came, on the whole 64 bits: no pair is missed.

Equal texts are one fingerprint before anything is replicated. An anchor with very many rows
is cut into tiles of homes x visitors, each pair in one tile; which anchors are hot is
estimated from a sample, and only the size of tiles depends on that. Tasks send back a
spanning forest of the links they see, not all pairs.

Defined cases: null or empty text, or one without a word, has fingerprint zero and is linked
like any other; repeated rows each get their row; a null id counts as larger than all others
(a component of null ids only has a null id); an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm.text import large_batches, small_batches
from claimlake.operators.components import components
from claimlake.scratch import cut

SHINGLE, SEED, T = 3, 42, 2
GENERATOR, BITS, RADIUS = 0xC75, 23, 3  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: Rows of an anchor's tile, about; fingerprints that hot anchors are estimated from, about.
TILE, SAMPLE = 20_000, 20_000
PART = 1 << 20


def _shingle_counts(data: bytes, counts: np.ndarray, carried: list[bytes], last: bool, total: list[int], shingle: int) -> list[bytes]:
    """Add the bit counts of a part's shingles; return the words that the next part begins with."""
    from xxhash import xxh64_intdigest as digest

    words = carried + data.lower().split()
    n = len(words) - shingle + 1
    if n < 1:
        if last and not total[0] and words:
            n = 1
        else:
            return words
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    for k in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)), np.uint64, min(n - k, 1 << 16))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    total[0] += n
    return words[n:]


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Of a text's UTF-8 bytes, from shingles of so many words; words are split at the six ASCII blanks and A-Z lower-cased."""
    counts, total, carried, at = np.zeros(64, dtype=np.int64), [0], [], 0
    while at < len(data):
        end = at + PART
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        carried = _shingle_counts(data[at:end], counts, carried, end >= len(data), total, shingle)
        at = end
    bits = counts * 2 > total[0]
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def prints(batches):
        for b in batches:
            got = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(prints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Syndromes of three bytes, the coset leader by syndrome, codewords 3 to 5 bits from it."""

    def rest(v: int) -> int:
        for k in range(BITS - 1, 10, -1):
            if v >> k & 1:
                v ^= GENERATOR << (k - 11)
        return v

    one = np.array([rest(1 << k) for k in range(24)], dtype=np.int64)
    syndromes = np.zeros((3, 256), dtype=np.int64)
    for byte in range(3):
        for v in range(256):
            syndromes[byte, v] = np.bitwise_xor.reduce(one[8 * byte : 8 * byte + 8][[bool(v >> i & 1) for i in range(8)]], initial=0)
    leader = np.zeros(2048, dtype=np.int64)
    bits = [1 << k for k in range(BITS)]
    for i, a in enumerate(bits):
        leader[rest(a)] = a
        for j in range(i):
            leader[rest(a | bits[j])] = a | bits[j]
            for k in range(j):
                leader[rest(a | bits[j] | bits[k])] = a | bits[j] | bits[k]
    words = np.array([v << 11 ^ rest(v << 11) for v in range(4096)], dtype=np.int64)
    far = np.bitwise_count(words[None, :] ^ leader[:, None])
    near = []
    for d in (4, 5):
        hit = far == d
        table = np.full((2048, int(hit.sum(axis=1).max())), -1, dtype=np.int64)
        for s in range(2048):
            own = words[hit[s]]
            table[s, : len(own)] = own
        near.append(table)
    return syndromes, leader, near


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor, is home) for all anchors of each fingerprint (unsigned 64 bits)."""
    syndromes, leader, (at4, at5) = _code()
    halves = []
    for k in range(2):
        v = (fp >> np.uint64(k * BITS) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        s = syndromes[0, v & 255] ^ syndromes[1, v >> 8 & 255] ^ syndromes[2, v >> 16]
        halves.append((v ^ leader[s], at4[s], at5[s]))
    (home1, a4, a5), (home2, b4, b5) = halves
    n = len(fp)
    zero = np.zeros((n, 1), dtype=np.int64)

    def pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.repeat(x, y.shape[1], axis=1), np.tile(y, (1, x.shape[1]))
        row, col = np.nonzero((x >= 0) & (y >= 0))
        return row, (home1[row] ^ x[row, col]) << BITS | (home2[row] ^ y[row, col])

    found = [(np.arange(n), home1 << BITS | home2), pairs(a4, zero), pairs(zero, b4), pairs(a5, zero), pairs(zero, b5), pairs(a4, b4)]
    index = np.concatenate([r for r, _ in found])
    return index, np.concatenate([a for _, a in found]), np.arange(len(index)) < n


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of edges a-b that aren't their component's smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links in whole groups of equal key, homes first in each: pairs of differing fp within T."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    group = np.repeat(np.arange(len(starts)), sizes)
    mine = np.flatnonzero(home & (sizes[group] > 1))
    width = sizes[group[mine]]
    a, b, at = [], [], 0
    sums = np.cumsum(width)
    while at < len(mine):
        end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + most, side="right")))
        w = width[at:end]
        i = np.repeat(mine[at:end], w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(starts[group[mine[at:end]]], w)
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= T) & (fp[i] != fp[j])
        if hit.any():
            x, y = forest(fp[i[hit]], fp[j[hit]])
            a.append(x)
            b.append(y)
        at = end
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): edges between distinct fp of prints, with the same components as all pairs within T."""
    spark = prints.sparkSession
    n = prints.count()
    rate = max(1, n // SAMPLE)

    def all_anchors(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 4096):
                _, anchor, _ = anchors(fp[k : k + 4096])
                yield pa.record_batch({"anchor": pa.array(anchor)})

    sample = prints.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(rate)) == 0).select("fp")
    # an anchor is hot if it has more than tile rows and more than 1/4096 of all: 4096 at most
    limit = max(tile, 61 * n // 4096)
    hot = sample.mapInArrow(all_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * rate > limit).collect()
    cuts = {r["anchor"]: -(-r["n"] * rate // limit) for r in hot}
    shared = spark.sparkContext.broadcast(cuts)

    def replicate(batches):
        cuts = shared.value
        hot = np.array(sorted(cuts), dtype=np.int64)
        for b in batches:
            fp_all = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp_all), 4096):
                fp = fp_all[k : k + 4096]
                index, anchor, home = anchors(fp)
                tile = np.zeros(len(index), dtype=np.int64)
                if len(hot):
                    split = np.flatnonzero(np.isin(anchor, hot))
                    if len(split):
                        parts = np.array([cuts[x] for x in anchor[split].tolist()])
                        mod = (fp[index[split]] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                        again = np.repeat(np.arange(len(split)), parts)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
                        # a home visits its own anchor too: as a home it goes to a row of tiles, as a visitor to a column
                        keep = np.ones(len(index), dtype=bool)
                        keep[split] = False
                        p, m, h = parts[again], mod[again], home[split][again]
                        as_home = (h, m * p + other, True)
                        as_visitor = (np.ones(len(again), dtype=bool), other * p + m, False)
                        sets = [(index[keep], anchor[keep], home[keep], tile[keep])]
                        for use, t, flag in (as_home, as_visitor):
                            sets.append((index[split][again][use], anchor[split][again][use], np.full(int(use.sum()), flag), t[use]))
                        index, anchor, home, tile = (np.concatenate(x) for x in zip(*sets, strict=True))
                yield pa.record_batch({"anchor": pa.array(anchor), "tile": pa.array(tile.astype(np.int32)), "visitor": pa.array(~home), "fp": pa.array(fp[index].view(np.int64))})

    def meet(batches):
        held = None
        for b in batches:
            rows = [b.column(0).to_numpy(), b.column(1).to_numpy(), ~b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy().view(np.uint64)]
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            if not len(rows[0]):
                continue
            # the last group may go on in the next batch
            own = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            end = len(own) - int(own.sum())
            held = [x[end:] for x in rows]
            if end:
                yield from out(*(x[:end] for x in rows))
        if held:
            yield from out(*held)

    def out(anchor, tile, home, fp):
        key = anchor ^ (tile.astype(np.int64) << 46)
        a, b = _compare(key, fp, home)
        if len(a):
            yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    rows = prints.select("fp").mapInArrow(replicate, "anchor long, tile int, visitor boolean, fp long")
    return rows.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile", "visitor").mapInArrow(meet, "a long, b long")


def groups(distinct: DataFrame) -> DataFrame:
    """(fp, component), written, of the fingerprints that others link to; distinct: a written table."""
    with large_batches(distinct.sparkSession, 20_000):  # short rows
        found = cut(links(distinct), "links")
    return cut(components(found, "a", "b").withColumnRenamed("node", "fp"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, text)."""
    prints = cut(fingerprints(docs), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = groups(distinct)
    first = found.join(distinct, "fp").groupBy("component").agg(F.min("least").alias("first"))
    linked = found.join(first, "component").select("fp", "first")
    # written first, so that both sides of the join are plain exchanges and a hot fingerprint can be split
    labels = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("first", "least").alias("component_id")), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
