"""Documents with every awkward case: nulls, empty, long, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, lang=0):
    parts = (["the", "er", "an", "on", "th"], ["que", "le", "ait", "eau", "ou"])[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents(spark, n=60, seed=1, extra=True):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = k % 2
        text = ".\n".join(words(rng, rng.randrange(3, 60), lang) for _ in range(rng.randrange(1, 6)))
        rows.append((k, text, ("en", "fr")[lang], f"s{k % 3}" if k % 7 else None, len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "", 0), (n + 2, " \n\t ", None, "s1", 4), (n + 3, words(rng, 6000), "en", "s0", 9), (None, "no id here at all", "en", "s0", 3)]
    rows += [rows[3], rows[3], (n + 4, rows[3][1], "fr", "s9", 1), (n + 5, rows[5][1] + " and more", "fr", "s9", 1), (n + 6, "😀 İstanbul ñandú <|endoftext|> it's 3.14!!, ok", "en", "s1", 1), (n + 7, "123 456", "en", "s1", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        # names that the operators use inside
        for c in ("length", "size", "_n", "fp", "line", "score", "ids", "start", "target", "row"):
            df = df.selectExpr("*", f"1 as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
