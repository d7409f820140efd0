"""Fuzzy line dedup by MinHash: signatures and exact Jaccard in numpy, all joins in DataFrame operations.

Lines are trimmed, lower-cased and each run of blanks in them is one blank. A line's shingles
are the runs of CHARS characters at every position (a shorter line is one shingle). Its
signature has BANDS bands of WIDTH values (shingles.signatures); lines of up to TINY shingles
have one band, as only equal sets of that size are similar. Two lines of Jaccard 0.8 meet in a
band with a chance of 1 - (1 - 0.8^4)^9 = 99.1 %, at 0.9 with 99.98 %; lines that meet nowhere
directly can still be joined through a third one. Bands of all sizes are treated alike.

Lines of a band are compared by the exact Jaccard of their whole shingle sets: with leaders
first, then in pairs those that no link joins yet (see fuzzy_labels). The verified links go to
the distributed union-find round by round, and the first place (doc_id, line number) of a component is kept.

Equal lines are one line, by a 64-bit hash, before anything is compared (n distinct lines
collide with probability about n^2 / 2^65). Hot lines and bands are combined before the
shuffle. The text of the few lines that share a band is read from docs a second time rather
than kept, so nothing of the size of the shingle sets is written or shuffled.

Defined cases: null text has no lines; lines without a word take no part and stay; rows
that repeat id and text are kept or dropped together, rows that share an id (or have none) with
different texts are rows of their own; a null id ranks first; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import shingles
from claimlake.llm.text import small_batches
from claimlake.operators.components import components
from claimlake.scratch import cut, drop

SIMILAR, BANDS, WIDTH, TINY = 0.8, 9, 4, 3
#: Times that a band's lines meet a leader before what is left meets in pairs: of all bands, and
#: after that of bands of more than GROUP lines.
ROUNDS, MORE = 2, 3
#: Lines of a band (linked ones count too) that meet in pairs; those of larger bands meet by
#: their rarest shingles, which loses no pair either.
GROUP = 32
#: Rows of two longs that are broadcast, at most; larger tables are joined by shuffling.
FEW = 100_000
#: Bits of the filters that tasks share, whatever the number of lines or bands: what they let
#: through by chance costs time, not results.
SIEVE = 1 << 27
#: Slots by which shingles of large bands are counted.
SLOTS = 1 << 20
BLANKS = " \t\r\x0b\x0c"
_BLANK = dict.fromkeys(map(ord, BLANKS), " ")

Sets = Callable[[list[bytes]], np.ndarray]


def flat_lines(text: str) -> list[tuple[int, str]]:
    """(number, normalised line) of every line with a word."""
    text = text.lower()
    if any(b in text for b in BLANKS[1:]):
        text = text.translate(_BLANK)
    if "  " in text:
        return [(k, " ".join(filter(None, x.split(" ")))) for k, x in enumerate(text.split("\n")) if x.strip(" ")]
    return [(k, x.strip(" ")) for k, x in enumerate(text.split("\n")) if x and x != " "]


def text_key(text: Column) -> Column:
    """What rows of one text share; with the id it names a row, up to exact repeats."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_sets(texts: list[bytes]) -> np.ndarray:
    return shingles.char_sets([t.decode("utf-8", "surrogatepass") for t in texts])


def _digests(flat: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    return np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in flat), np.uint64, len(flat))


def band_lists(parts: list[tuple[np.ndarray, np.ndarray]], tiny: int) -> tuple[np.ndarray, pa.ListArray]:
    """(sizes of the sets, their bands): one band where a set has tiny shingles at most."""
    if not parts:
        return np.zeros(0, dtype=np.int32), pa.array([], pa.list_(pa.int64()))
    bands, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    use = np.ones(bands.shape, dtype=bool)
    use[n <= tiny, 1:] = False
    ends = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
    return n.astype(np.int32), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[use]))


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, n, bands) of every line with a word. line: the hash
    that equal lines share; n: its shingles."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            row, number, flat = [], [], []
            for k, t in enumerate(b.column(2)):
                for i, x in flat_lines(t.as_py() or ""):
                    row.append(k)
                    number.append(i)
                    flat.append(x)
            parts = [shingles.signatures(shingles.char_sets(flat[s]), s.stop - s.start, BANDS, WIDTH) for s in shingles.groups([len(x) for x in flat])]
            n, bands = band_lists(parts, TINY)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(number, pa.int32()), pa.array(_digests(flat).view(np.int64)), pa.array(n), bands], names=["doc_id", "text_key", "line_no", "line", "n", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, line_no int, line long, n int, bands array<long>")


def sieve(keys: DataFrame, name: str) -> bytes:
    """One bit of SIEVE for each key (long); its size doesn't follow the number of keys."""
    at = F.pmod(F.col(name), F.lit(SIEVE)) + 1
    made = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(SIEVE // 8, dtype=np.uint8)
    for r in made.collect():  # SIEVE bits at most
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        bits[(r["bucket"] - 1) * len(part) : r["bucket"] * len(part)] = part
    return bits.tobytes()


def held(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned 64 bits) may be in the sieve."""
    at = (keys & np.uint64(SIEVE - 1)).astype(np.int64)
    return (np.frombuffer(bits, dtype=np.uint8)[at >> 3] >> (at & 7) & 1).astype(bool)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of the wanted lines, text in UTF-8; docs is read again, with a filter that tasks share."""
    small_batches(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(sieve(wanted, "line"))

    def run(batches):
        for b in batches:
            found: dict[int, str] = {}
            for t in b.column(0):
                flat = [x for _, x in flat_lines(t.as_py() or "")]
                keys = _digests(flat)
                for k in np.flatnonzero(held(bits.value, keys)).tolist():
                    found.setdefault(int(keys[k]), flat[k])
            keys = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.encode("utf-8", "surrogatepass") for x in found.values()], pa.binary())], names=["line", "text"])

    return one_text(docs.select("text").mapInArrow(run, "line long, text binary"), wanted)


def one_text(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) for each wanted line, of rows that may repeat or hold others."""
    return _only(found, wanted, "line").groupBy("line").agg(F.first("text").alias("text"))


def _only(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows whose key is in keys (distinct): by broadcast where keys are few, else by shuffling."""
    return rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, on)


def _alike(pairs: DataFrame, texts: DataFrame, similar: float, sets: Sets) -> DataFrame:
    """(la, lb), distinct, of the pairs (a, b, la, lb) whose shingle sets have a Jaccard of similar."""
    one = texts.select(F.col("line").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("line").alias("b"), F.col("text").alias("y"))
    found = pairs.join(one, "a").join(two, "b").select("la", "lb", "x", "y")

    def run(batches):
        for b in batches:
            parts = list(shingles.jaccard(b.column(2).to_pylist(), b.column(3).to_pylist(), sets))
            both, x, y = np.concatenate([*parts, np.zeros((0, 3), dtype=np.int64)]).T
            yield pa.record_batch([b.column(0), b.column(1)], names=["la", "lb"]).filter(pa.array(both >= similar * (x + y - both)))

    return found.mapInArrow(run, "la long, lb long").distinct()


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """members, written, with the labels that links (la, lb) between labels leave."""
    found = cut(components(links, "la", "lb"), "labels")
    if found.isEmpty():
        return members
    few = F.broadcast if found.count() <= FEW else lambda x: x
    new = found.select(F.col("node").alias("label"), F.col("component").alias("_new"))
    named = members.join(few(new), "label", "left").withColumn("label", F.coalesce("_new", "label"))
    out = cut(named.select(members.columns), "members")
    drop(members)
    return out


def _rarest(many: DataFrame, texts: DataFrame, similar: float, sets: Sets) -> DataFrame:
    """(line, n, label, key, place): for each line of many the first n - ceil(similar * n) + 1 of
    its shingles, rarest first, without those that no other line has. Two lines as similar as
    that share one of them at least, so no pair is lost; a frequent passage comes last.

    Any order of shingles that is one for all lines will do: it goes by how many lines have a
    shingle of the same slot, of SLOTS, so what tasks share doesn't follow the input.
    """
    rows = cut(many.join(texts, "line").select("line", "n", "label", "text"), "many")

    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(SLOTS - 1)).astype(np.int64)

    def count(batches):
        seen = np.zeros(SLOTS, dtype=np.int64)
        for b in batches:
            own = b.column(0).to_pylist()
            for s in shingles.groups([len(x) for x in own]):
                seen += np.bincount(slots(sets(own[s])), minlength=SLOTS)
        used = np.flatnonzero(seen)
        for k in range(0, len(used), 1 << 16):
            yield pa.record_batch([pa.array(used[k : k + (1 << 16)]), pa.array(seen[used[k : k + (1 << 16)]])], names=["slot", "lines"])

    sums = rows.select("text").mapInArrow(count, "slot long, lines long").groupBy("slot").agg(F.sum("lines").alias("lines")).where("lines > 1")
    sums = sums.select(F.col("slot").cast("int"), F.least("lines", F.lit((1 << 31) - 1)).cast("int").alias("lines")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, dtype=np.int32)
    often[sums["slot"].to_numpy()] = sums["lines"].to_numpy()
    shared = many.sparkSession.sparkContext.broadcast(often)

    def first(batches):
        often = shared.value
        for b in batches:
            own = b.column(3).to_pylist()
            for s in shingles.groups([len(x) for x in own]):
                keys = sets(own[s])
                ends = shingles.bounds(keys, s.stop - s.start)
                number, lines = (keys >> np.uint64(shingles.BITS)).astype(np.int64), often[slots(keys)]
                order = np.lexsort((keys, lines, number))
                n = np.diff(ends)
                room = n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(keys)) - ends[number]  # numbers are in order before and after
                use = (place < room[number]) & (lines[order] > 1)
                at = pa.array(number[use] + s.start)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array((keys[order][use] << np.uint64(64 - shingles.BITS)).view(np.int64)), pa.array(place[use].astype(np.int32))], names=["line", "n", "label", "key", "place"])

    return rows.mapInArrow(first, "line long, n int, label long, key long, place int")


def _members(lines: DataFrame) -> DataFrame:
    """(line, n, band) of the bands that two lines or more share, distinct."""
    small_batches(lines.sparkSession)
    # half of a line's hash tells the lines of a band apart: two that agree in it are missed in 1 of 2^32 bands
    half = F.shiftright("line", 32).cast("int")
    all_ = lines.select(half.alias("half"), F.explode("bands").alias("band"))
    groups = all_.groupBy("band").agg(F.min("half").alias("lo"), F.max("half").alias("hi")).where("lo < hi").select("band")
    bits = lines.sparkSession.sparkContext.broadcast(sieve(groups, "band"))

    def run(batches):
        for b in batches:
            ends, bands = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            bands = bands[ends[0] : ends[-1]]
            own = np.flatnonzero(held(bits.value, bands.view(np.uint64)))
            at = pa.array(np.searchsorted(ends - ends[0], own, side="right") - 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(bands[own])], names=["line", "n", "band"])

    found = cut(lines.select("line", "n", "bands").mapInArrow(run, "line long, n int, band long").distinct(), "shared")
    # without what the filter let through by chance
    real = cut(found.groupBy("band").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo < hi").select("band"), "bands")
    return _only(found, real, "band")


def fuzzy_labels(docs: DataFrame, lines: DataFrame, similar: float = SIMILAR, texts_of: Callable[[DataFrame, DataFrame], DataFrame] = line_texts, sets: Sets = line_sets) -> DataFrame:
    """(line, label) of the lines that share a band with others; lines that share a band and are
    similar have one label, the smallest line of their component. lines: (line, n, bands) with n
    the shingles of a line, written; a line may repeat. texts_of(docs, wanted) gives the texts of
    the lines that share a band, sets the shingle sets of texts.

    Rounds compare the lines of a band with a leader drawn by hash, except those that
    links already join to it, so a band of many copies costs one comparison each. The lines of a
    band of two have met after the first round and leave. What then is not yet joined
    within a band meets in pairs; lines of a band of more than GROUP meet all lines of such bands that share one of their rarest shingles instead, which no pair similar enough
    can avoid. Sizes that differ too much for the similarity are never compared.
    """
    small_batches(docs.sparkSession)
    members = cut(_members(lines).withColumn("label", F.col("line")), "members")
    wanted = cut(members.select("line").distinct(), "wanted")
    texts = cut(texts_of(docs, wanted), "texts")

    def could(n: str, m: str) -> Column:
        return F.least(n, m) >= similar * F.greatest(n, m)

    for round_ in range(ROUNDS + MORE):
        leader = F.min(F.struct(F.xxhash64("line", F.lit(round_)), F.col("line").alias("l"), F.col("label").alias("ll"), F.col("n").alias("ln"))).alias("x")
        open_ = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), leader).where("lo < hi")
        open_ = open_.where(F.col("m") > (GROUP if round_ >= ROUNDS else 2 if round_ else 0)).select("band", "x.l", "x.ll", "x.ln")
        met = members.join(open_, "band").where((F.col("label") != F.col("ll")) & could("n", "ln"))
        pairs = met.select(F.col("line").alias("a"), F.col("l").alias("b"), F.col("label").alias("la"), F.col("ll").alias("lb")).distinct()
        members = _joined(members, _alike(pairs, texts, similar, sets))
    open_ = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo < hi AND m > 2").select("band", "m")
    left = cut(members.join(open_, "band"), "open")
    few = left.where(F.col("m") <= GROUP).select("line", "n", "label", F.col("band").alias("key"), F.lit(0).alias("place"))
    # a large band holds lines that share a passage: they meet by their rarest shingles
    many = left.where(F.col("m") > GROUP).select("line", "n", "label").distinct()
    keyed = cut(few.unionAll(_rarest(many, texts, similar, sets)), "keyed")
    apart = cut(keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "apart")
    met = cut(_only(keyed, apart, "key"), "close")
    x, y = (met.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("line", "n", "label", "place"))) for k in "ab")
    # at the first shingle that two lines share, what is left of both holds all that they share
    enough = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= similar / (1 + similar) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = x.join(y, "key").where((F.col("line_a") < F.col("line_b")) & (F.col("label_a") != F.col("label_b")) & could("n_a", "n_b") & enough)
    pairs = cut(pairs.select(F.col("line_a").alias("a"), F.col("line_b").alias("b"), F.col("label_a").alias("la"), F.col("label_b").alias("lb")).distinct(), "pairs")
    return _joined(members, _alike(pairs, texts, similar, sets)).select("line", "label").distinct()


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, line_no, line, component, kept) of every line of (doc_id, text) with a word."""
    docs = docs.select("doc_id", "text")
    place = ["doc_id", "line_no", "text_key"]
    lines = cut(signed_lines(docs), "lines")
    found = cut(fuzzy_labels(docs, lines, similar).where("label <> line"), "line-labels")
    # first places by line, then by component: written, so that both sides of each join are plain exchanges and hot keys can be split
    firsts = lines.groupBy("line").agg(F.min(F.struct(*place)).alias("at"))
    named = cut(firsts.join(found, "line", "left").select("line", F.coalesce("label", "line").alias("component"), "at"), "firsts")
    roots = found.select(F.col("label").alias("component")).distinct()
    best = cut(named.join(roots, "component", "left_semi").groupBy("component").agg(F.min("at").alias("first")), "first")
    # only lines that others join have to look for the first place of their component
    named = named.join(best, "component", "left").select("line", "component", F.coalesce("first", "at").alias("first"))
    out = lines.select(*place, "line").join(named, "line")
    return out.select("doc_id", "text_key", "line_no", "line", "component", (F.struct(*place) == F.col("first")).alias("kept"))


def drop_lines(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs without their dropped lines; documents that lose every line with a word go."""
    names = docs.columns
    gone = judged.where("not kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("line_no").alias("_gone"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_key")), "left")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    rest = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains("_gone", x["i"])), lambda x: x["x"]), "\n")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest))
    return out.where(F.col("_gone").isNull() | (F.btrim("text", F.lit(BLANKS + "\n")) != "")).select(*names)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "component", "kept")


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL: dict[str, str] = {}
