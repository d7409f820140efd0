"""Personal data: four exact patterns, and terms that reveal what the patterns protect.

One pass over whole texts finds the protected values and, in every text with one, all terms
outside the spans; the same pass counts in how many documents every term of the corpus occurs.
Values and terms travel as 64-bit hashes. From the counts, pointwise mutual information says
how far a term gives a value away: PMI(t; e) against IC(e) = log(documents / documents with e),
1 when t never occurs without e. With at least SUPPORT documents behind the pair, a share of
GENERALISE or more has every occurrence of the term in all texts generalised, REMOVE or more
removed; a second pass finds the occurrences.

Defined cases: null text is empty and has no span; repeated rows each get their row and count
as documents; an empty table gives an empty result; a null id is kept; extra columns are not
read, but redact() returns them. Rows carry their own spans: rows that share an id don't mix.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from claimlake.llm.text import chunks, small_batches
from claimlake.scratch import cut

KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.98
#: Distinct terms that a task counts before it sends them on.
HELD = 200_000
#: Bits of the filter of disclosing terms that tasks share.
SIEVE = 1 << 23
_PLACE = StructType([StructField("term", LongType()), StructField("start", IntegerType()), StructField("stop", IntegerType())])

# Written so that no text takes more than linear time: a run of digits or of address
# characters is tried once, from its start.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """A match needs a run of local characters right before an @ and a domain after it."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
        # nothing before an @ that failed can begin a later match: no run holds an @
        end = m.end() if m else at + 1
        at = text.find("@", end)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def term_of(m: re.Match) -> str:
    return m[0].lower()


def values_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The protected values of a text: kind and normalised text of each span."""
    return {f"{kind}:{re.sub(r'[ ().-]', '', text[a:b].lower()) if kind in ('card', 'phone') else text[a:b].lower()}" for kind, a, b in spans}


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Matches of the terms of the whole text that no span touches."""
    taken = sorted((a, b) for _, a, b in spans)
    k, reach = 0, 0
    for m in TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= m.start():
            yield m


def digest(s: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def scan(docs: DataFrame) -> DataFrame:
    """For each row its values and, if it has any, its terms outside spans, as hashes; and rows
    (term, n) of terms counted by task. Written once, read twice."""
    small_batches(docs.sparkSession)
    docs = docs.select("text")

    def run(batches):
        counts, longs = Counter(), pa.list_(pa.int64())
        names = ["values", "terms", "term", "n"]

        def flush():
            terms = list(counts)
            for k in range(0, len(terms), 50_000):
                part = terms[k : k + 50_000]
                none = pa.nulls(len(part), longs)
                yield pa.RecordBatch.from_arrays([none, none, pa.array([digest(t) for t in part], pa.int64()), pa.array([counts[t] for t in part], pa.int64())], names=names)
            counts.clear()

        for b in batches:
            values, terms = [], []
            for t in b.column(0):
                text = t.as_py() or ""
                spans = base_spans(text)
                values.append([digest(v) for v in values_of(text, spans)])
                terms.append([digest(w) for w in {term_of(m) for m in free_terms(text, spans)}] if spans else [])
                words: set[str] = set()
                for part in chunks(text):
                    words.update(TERM.findall(part))
                counts.update({w.lower() for w in words})
                if len(counts) > HELD:
                    yield from flush()
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(values, longs), pa.array(terms, longs), none, none], names=names)
        yield from flush()

    return docs.mapInArrow(run, "values array<long>, terms array<long>, term long, n long")


def disclosing(scanned: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(value, term, share): pairs whose PMI is at least generalise of the value's information."""
    docs = scanned.where(F.col("values").isNotNull())
    held = docs.where(F.size("values") > 0).select("terms", F.explode("values").alias("value"))
    values = cut(held.groupBy("value").agg(F.count("*").alias("of_value")).where(F.col("of_value") >= support), "values")
    pairs = held.join(values.select("value"), "value").select("value", F.explode("terms").alias("term"))
    both = pairs.groupBy("value", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    terms = scanned.where(F.col("values").isNull()).groupBy("term").agg(F.sum("n").alias("of_term")).where(F.col("of_term") >= support)
    total = F.lit(float(docs.count()))
    info = F.ln(total / F.col("of_value"))
    # a value in every document holds no information: nothing can reveal more
    share = F.when(info > 0, F.ln(F.col("both") * total / (F.col("of_term") * F.col("of_value"))) / info).otherwise(F.lit(0.0))
    return both.join(values, "value").join(terms, "term").select("value", "term", share.alias("share")).where(F.col("share") >= generalise)


def occurrences(docs: DataFrame, terms: DataFrame, rows: bool = False) -> DataFrame:
    """(doc_id, row, base, seen) of each row; seen: every place outside spans of a term whose
    hash may be in terms. SIEVE bits are shared, whatever the number of terms: joins decide.
    rows: with the whole row of docs, as a struct doc."""
    small_batches(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")
    docs = docs.select("doc_id", F.struct("*").alias("doc") if rows else "text")
    schema = StructType([docs.schema["doc_id"], StructField("row", LongType()), StructField("base", StringType()), StructField("seen", ArrayType(_PLACE)), *([docs.schema["doc"]] if rows else [])])
    fields = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])
    bits = np.zeros(SIEVE // 8, dtype=np.uint8)
    for r in terms.select(F.pmod("term", F.lit(SIEVE)).alias("k")).distinct().toLocalIterator():
        bits[r["k"] >> 3] |= 1 << (r["k"] & 7)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        from pyspark import TaskContext

        row, sieve, known = TaskContext.get().partitionId() << 40, shared.value, {}

        def wanted(word: str) -> int | None:
            h = digest(word.lower())
            k = h % SIEVE
            if len(known) > HELD:
                known.clear()
            known[word] = h if sieve[k >> 3] >> (k & 7) & 1 else None
            return known[word]

        for b in batches:
            base, seen, numbers = [], [], []
            for t in b.column(1).field(at) if rows else b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append(joined(spans))
                places = []
                for m in free_terms(text, spans):
                    w = m[0]
                    h = known[w] if w in known else wanted(w)
                    if h is not None:
                        places.append({"term": h, "start": m.start(), "stop": m.end()})
                seen.append(places)
                numbers.append(row)
                row += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers, pa.int64()), pa.array(base, pa.string()), pa.array(seen, pa.list_(fields)), *([b.column(1)] if rows else [])], names=schema.names)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, rows: bool = False) -> DataFrame:
    """(doc_id, base, spans): pattern spans, and all spans, as kind:start:end joined by commas.
    rows: with the whole row of docs, as a struct doc."""
    flagged = disclosing(cut(scan(docs), "pii"), support, generalise)
    # a term is as telling as for the value that it gives away most
    flagged = cut(flagged.groupBy("term").agg(F.max("share").alias("share")), "disclosing")
    places = cut(occurrences(docs, flagged, rows), "occurrences")
    kinds = F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    hits = places.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*").join(flagged, "term")
    spans = F.array_sort(F.collect_list(F.struct(kinds.alias("kind"), "start", "stop")))
    added = hits.groupBy("row").agg(spans.alias("a")).select("row", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("added"))
    found = places.drop("seen").join(added, "row", "left")
    return found.select("doc_id", "base", F.concat_ws(",", F.nullif("base", F.lit("")), "added").alias("spans"), *(["doc"] if rows else []))


def redact(found: DataFrame) -> DataFrame:
    """The rows of find(rows=True) with their text sanitised: spans become [KIND]; of overlapping
    spans the first stands, and of two that start together the longer one."""
    parts = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("a"), (-F.split(x, ":")[2].cast("int")).alias("b"), F.split(x, ":")[0].alias("k")))
    start = F.struct(F.array().cast("array<string>").alias("t"), F.lit(0).alias("at"))
    text = F.col("doc.text")

    def step(acc, x):
        # only the parts between spans are gathered: a text with many spans isn't copied for each
        more = F.concat(acc["t"], F.array(F.substring(text, acc["at"] + 1, x["a"] - acc["at"]), F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))))
        return F.when(x["a"] >= acc["at"], F.struct(more.alias("t"), (-x["b"]).alias("at"))).otherwise(acc)

    clean = F.aggregate(F.array_sort(parts), start, step, lambda acc: F.concat(F.array_join(acc["t"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("doc", F.col("doc").withField("text", F.when(F.col("spans") != "", clean).otherwise(text))).select("doc.*")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    parts = F.filter(F.split("base", ","), lambda x: x != "")

    def count(kind):
        # a second parameter of the lambda, even a default, would be the place in the array
        return F.size(F.filter(parts, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
