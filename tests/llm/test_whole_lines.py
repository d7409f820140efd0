"""Line dedup against shingles at every position."""

import random

from pyspark.sql import functions as F

from claimlake.llm import lines
from tests.llm.cases import empty


def all_shingles(norm):
    norm = " ".join(norm.split())
    return frozenset(norm[i : i + 8] for i in range(max(1, len(norm) - 7)))


def alike(a, b):
    a, b = all_shingles(a), all_shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def judge(spark, texts):
    docs = spark.createDataFrame([(k, t, None, None, 1) for k, t in enumerate(texts)], empty(spark).schema)
    return {(r["doc_id"], r["line_no"]): r["kept"] for r in lines.dedup_lines(docs).collect()}


def test_every_position(spark):
    rng = random.Random(3)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    texts = [
        "https://example.org/first/page/of/this/site",
        "https://other.example.com/a/wholly/different/address",
        "transaction 2024010100017 completed",
        "transaction 2024010199358 completed",
        cjk[:8] + cjk[8:34],
        cjk[:8] + cjk[34:],
    ]
    long = "".join(rng.choice("abcdefgh ") for _ in range(70_000)).strip()
    texts += [long, long[:60_000] + "x" + long[60_001:], long[:30_000] + long[:30_000][::-1]]
    got = judge(spark, texts)
    want = [not any(alike(t, u) for u in texts[:k]) for k, t in enumerate(texts)]
    assert [got[k, 0] for k in range(len(texts))] == want and want == [True] * 7 + [False, True]


def test_against_all_positions(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam".split()) + str(rng.randrange(300)) for _ in range(24)) for _ in range(30)]
    texts = []
    for _ in range(150):
        ws = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(1000))
        texts.append(" ".join(ws))
    texts = list(dict.fromkeys(texts))
    got = judge(spark, texts)
    label = list(range(len(texts)))
    for k in range(len(texts)):
        for j in range(k):
            if label[j] != label[k] and alike(texts[j], texts[k]):
                low, high = sorted((label[j], label[k]))
                label = [low if x == high else x for x in label]
    # at 0.8 a pair may be missed with a chance of about 2 %
    assert sum(got[k, 0] != (label[k] == k) for k in range(len(texts))) <= 0.02 * len(texts)


def test_large_bands(spark, monkeypatch):
    """Short lines that share a passage, all in one large band; few of them are similar."""
    rng = random.Random(8)
    ends = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(220)]
    texts = ["the same" + e for e in ends]
    # similar pairs that two leader rounds rarely bring together
    texts += [t[:-1] + ("0" if k % 2 else "1") for k, t in enumerate(texts[:60])]
    size = {k: len(all_shingles(t)) for k, t in enumerate(texts)}
    docs = spark.createDataFrame([(k, t, None, None, 1) for k, t in enumerate(texts)], empty(spark).schema)
    # every line in one band: whatever is linked doesn't hang on the signature
    rows = lines.signed_lines(docs).select("doc_id", "line_no", "line")
    rows = rows.join(spark.createDataFrame(list(size.items()), "doc_id long, n int"), "doc_id").withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    ids = {r["line"]: r["doc_id"] for r in rows.collect()}
    monkeypatch.setattr(lines, "ROUNDS", 1)
    monkeypatch.setattr(lines, "MORE", 0)
    got = {ids[r["line"]]: ids[r["label"]] for r in lines.fuzzy_labels(docs, rows).collect()}
    want = [(a, b) for b in range(len(texts)) for a in range(b) if alike(texts[a], texts[b])]
    assert len(want) >= 60 and all(got.get(a, a) == got.get(b, b) for a, b in want)


def test_fuzzy_lines_without_id(spark):
    text = "a line that two rows have in nearly the same words, and one of them has no id"
    rows = [(None, text, None, None, 1), (1, text[:-1] + "t", None, None, 1), (2, text, None, None, 1)]
    judged = lines.dedup_lines(spark.createDataFrame(rows, empty(spark).schema))
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == {None: True, 1: False, 2: False}


def test_bands_of_two_meet_once(spark, monkeypatch):
    texts = ["these two lines share a band", "but they are wholly different", "a third line, nearly the same as another line of three", "a third line, nearly the same as another line of threes", "and one that isn't"]
    docs = spark.createDataFrame([(k, t, None, None, 1) for k, t in enumerate(texts)], empty(spark).schema)
    bands = [0, 0, 2, 2, 2]
    rows = spark.createDataFrame([(k, len(all_shingles(t)), [bands[k]]) for k, t in enumerate(texts)], "doc_id long, n int, bands array<long>")
    rows = lines.signed_lines(docs).select("doc_id", "line").join(rows, "doc_id").cache()
    ids = {r["line"]: r["doc_id"] for r in rows.collect()}
    met, plain = [], lines._alike

    def alike(pairs, *args):
        met.extend(tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in pairs.collect())
        return plain(pairs, *args)

    monkeypatch.setattr(lines, "_alike", alike)
    got = {ids[r["line"]]: ids[r["label"]] for r in lines.fuzzy_labels(docs, rows).collect()}
    assert met.count((0, 1)) == 1
    assert got[0] != got[1] and got[2] == got[3] != got[4]
