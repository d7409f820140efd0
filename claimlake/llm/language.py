"""Language ID by word-first backoff.

fit() counts words and character n-grams per language over a bounded, hash-chosen sample of
labelled rows (PER_LANG documents a language are expected, every one below that number) and
keeps all that were seen MIN_COUNT times, so the model grows with the number of languages and
not with the input. Whole texts are learned and predicted: a run of letters longer than PART,
as in scripts without blanks, counts and scores in parts. A known word scores by its log
frequency in each language, an unseen one by its longest n-grams that the model has, five
characters down to one, by the mean of their log frequencies. What a row of log frequencies has
in common to all languages is left out: it changes neither the order nor the shares.

The model is a few arrays and two joined texts, fetched by Arrow and shared with the tasks;
scores are held for the languages that a word or n-gram was seen in only.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text whose
words say nothing gets the language with most training rows (ties: smaller code point) and
score 1/languages; without any labelled row every text is ``und``. A null id counts as ''.
Repeated rows are predicted alike. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm.text import chunks, small_batches
from claimlake.scratch import cut

PER_LANG, MIN_COUNT = 2_000, 2
#: Longest n-gram; letters of a run that count as a word; scores that a worker keeps at hand.
LONGEST, PART, KEPT = 5, 64, 4_000_000
WORD = re.compile(rf"[^\W\d_]{{1,{PART}}}")


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)]


@dataclass
class Table:
    """Log frequencies of keys: key k has those of langs[ends[k]:ends[k + 1]], the other languages rest."""

    keys: str  # joined by line ends
    ends: np.ndarray
    langs: np.ndarray
    logs: np.ndarray
    rest: np.ndarray

    def rows(self) -> np.ndarray:
        """All rows, each less its largest value."""
        out = np.tile(self.rest, (len(self.ends) - 1, 1))
        out[np.repeat(np.arange(len(out)), np.diff(self.ends)), self.langs] = self.logs
        return out - out.max(axis=1, keepdims=True)

    def row(self, k: int) -> np.ndarray:
        out = self.rest.copy()
        own = slice(self.ends[k], self.ends[k + 1])
        out[self.langs[own]] = self.logs[own]
        return out - out.max()

    def reader(self) -> Callable:
        """Rows by number; made at once where that takes KEPT scores at most."""
        if (len(self.ends) - 1) * len(self.rest) <= KEPT:
            return self.rows().__getitem__
        return lambda ks: np.array([self.row(k) for k in ks])


@dataclass
class Model:
    """langs in order of preference."""

    langs: list[str] = field(default_factory=list)
    words: Table | None = None
    grams: Table | None = None


class _Lookup(dict):
    """word -> row of scores; beyond KEPT scores the rows of unseen words are summed aside."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        n = len(model.langs)
        self.words = {w: k for k, w in enumerate(model.words.keys.split("\n"))} if n else {}
        self.grams = {g: k for k, g in enumerate(model.grams.keys.split("\n"))} if n else {}
        self.word_rows, self.gram_rows = (model.words.reader(), model.grams.reader()) if n else (None, None)
        self.rows = np.zeros((KEPT // max(n, 1) + 1, n), dtype=np.float32)
        self.used, self.aside = 1, np.zeros(n)
        if 0 < len(self.words) * n <= KEPT // 2:  # all known words at once, else each when it comes
            self.used += len(self.words)
            self.rows[1 : self.used] = self.word_rows(slice(None))
            self.update((w, k + 1) for w, k in self.words.items())

    def backoff(self, word: str) -> np.ndarray | None:
        """Mean log frequencies of the longest n-grams of an unseen word that the model has."""
        for n in range(LONGEST, 0, -1):
            if known := [k for g in grams(word, n) if (k := self.grams.get(g)) is not None]:
                return self.gram_rows(known).sum(axis=0) / len(known)
        return None

    def __missing__(self, word: str) -> int:
        k = self.words.get(word)
        score = self.word_rows([k])[0] if k is not None else self.backoff(word)
        if self.used < len(self.rows):
            if score is None:
                self[word] = 0
                return 0
            self.rows[self.used] = score
            self[word] = self.used
            self.used += 1
            return self.used - 1
        if score is not None:
            self.aside += score
        return 0

    def score(self, text: str) -> tuple[int, float] | None:
        """(best language, its share of the evidence); None if the text has no letter."""
        total, any_word = np.zeros(len(self.model.langs)), False
        self.aside[:] = 0
        for part in chunks(text):
            words = WORD.findall(part.lower())
            if words:
                any_word = True
                total += self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        if not any_word:
            return None
        total += self.aside
        p = np.exp(total - total.max())
        best = int(np.argmax(total))
        return best, float(p[best] / p.sum())


def _counts(batches):
    """Per batch: (lang, kind, gram, n), already summed."""
    from collections import Counter

    for b in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            c = by.setdefault(lang, Counter())
            for part in chunks(text or ""):
                c.update(WORD.findall(part.lower()))
        for lang, words in by.items():
            small: Counter = Counter()
            for w, n in words.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        small[g] += n
            for kind, c in ((0, words), (1, small)):
                keys = list(c)
                for i in range(0, len(keys), 50_000):
                    part = keys[i : i + 50_000]
                    yield pa.record_batch({"lang": pa.array([lang] * len(part), pa.string()), "kind": pa.array([kind] * len(part), pa.int32()), "gram": pa.array(part, pa.string()), "n": pa.array([c[k] for k in part], pa.int64())})


def fit(docs: DataFrame, per_lang: int = PER_LANG, min_count: int = MIN_COUNT) -> Model:
    """Learn from (text, lang) of labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    # one row a language
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).toArrow().to_pydict()
    order = sorted(zip(sizes["lang"], sizes["n"], strict=True), key=lambda x: (-x[1], x[0]))
    if not order:
        return Model()
    langs = [x for x, _ in order]
    numbers = spark.createDataFrame([(x, k, min(1.0, per_lang / n)) for k, (x, n) in enumerate(order)], "lang string, number int, share double")
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = train.join(F.broadcast(numbers), "lang").where(place < F.col("share")).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, kind int, gram string, n long")
    counts = counts.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n")).join(F.broadcast(numbers.drop("share")), "lang")
    seen = F.array_sort(F.collect_list(F.struct("number", "n")))  # languages at most
    table = cut(counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), seen.alias("seen")).where(F.col("total") >= min_count).select("kind", "gram", "seen"), "grams")

    def fetch(kind: int) -> Table:
        rows = table.where(F.col("kind") == kind).select("gram", F.col("seen.number").alias("number"), F.col("seen.n").alias("n")).orderBy("gram").toArrow().combine_chunks()
        if not rows.num_rows:
            return Table("\n", np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), np.zeros(len(langs), dtype=np.float32))
        lists = rows["number"].combine_chunks()
        ends = lists.offsets.to_numpy().astype(np.int64)
        number, n = lists.values.to_numpy(), rows["n"].combine_chunks().values.to_numpy()
        # half a count for what a language lacks
        whole = np.bincount(number, weights=n, minlength=len(langs)) + 0.5 * rows.num_rows
        return Table("\n".join(rows["gram"].to_pylist()), ends, number.astype(np.int32), np.log((n + 0.5) / whole[number]).astype(np.float32), np.log(0.5 / whole).astype(np.float32))

    return Model(langs, fetch(0), fetch(1))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """docs with two more columns (replacing any of these names): language and score 0 to 1.

    keep_text=False leaves the text out of the result, so it isn't sent back from Python.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(lang_col, score_col)
    shared = spark.sparkContext.broadcast(model)
    where = [c.lower() for c in docs.columns].index(text.lower())
    kept = [i for i in range(len(docs.columns)) if keep_text or i != where]
    schema = docs.select(*[f"`{docs.columns[i]}`" for i in kept]).schema.add(lang_col, "string").add(score_col, "double")

    def label(batches):
        look = _Lookup(shared.value)  # of the task, so a worker doesn't hold it on
        for b in batches:
            langs, scores = [], []
            for t in b.column(where):
                t = t.as_py()
                got = look.score(t) if t and look.model.langs else None
                langs.append(look.model.langs[got[0]] if got else "und")
                scores.append(got[1] if got else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(b.schema.names[i] for i in kept), lang_col, score_col])

    return docs.mapInArrow(label, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
