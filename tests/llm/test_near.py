"""The near_duplicates stage against all pairs."""

import random

import corpus_pipeline
from tests.llm.cases import empty


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        text = [rng.choice(words) for _ in range(rng.choice([6, 20, 120, 400]))]
        rows.append((100 * k, " ".join(text)))
        for c in range(4):
            copy = list(text)
            for _ in range(rng.randrange(1, 2 + len(text) // 60)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((100 * k + c + 1, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], empty(spark).schema)
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()}
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for k in range(len(rows)):
        for j in range(k):
            if label[j] != label[k] and len(sets[j] & sets[k]) >= 0.8 * len(sets[j] | sets[k]):
                low, high = sorted((label[j], label[k]))
                label = [low if x == high else x for x in label]
    want = {rows[k][0] for k in range(len(rows)) if label[k] == k}
    assert 40 < len(want) < len(rows) and got == want


def test_rows_without_own_id(spark):
    """Rows that share an id, or have none, keep their own lines and stay as rows."""
    body = ["one quite ordinary sentence about ships", "the second row talks of winter in the hills", "some third thing on bread and its many kinds", "fourth and last, a word or two about glass"]
    rows = [(1, "common line of all rows here\n" + body[0]), (None, "common line of all rows here\n" + body[1]), (None, body[2] + "\nanother line of that row, clean"), (7, body[3]), (7, "nothing like it: " + "violins and drums " * 3), (None, body[1])]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], empty(spark).schema)
    now = corpus_pipeline.keep_first_lines(spark, docs, "")
    got = sorted(r["text"] for r in now.collect())
    assert body[2] + "\nanother line of that row, clean" in got and body[3] in got and len(got) == 6
    assert sum(body[1] in t for t in got) == 1 and sum("common line" in t for t in got) == 1
    assert sorted(r["text"] for r in corpus_pipeline.keep_one_of_group(spark, now, "").collect()) == got
