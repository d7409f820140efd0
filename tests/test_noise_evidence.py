import random
import re

from pyspark.sql import functions as F

from claimlake.operators import evidence, noise


def found(spark, bodies):
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string").withColumn("r", noise.regions(F.col("body")))
    df = df.withColumn("o", noise.original(F.coalesce("body", F.lit("")), F.col("r")))
    return {r["k"]: ([(x["start"], x["end"], x["region_type"]) for x in r["r"]], r["o"]) for r in df.collect()}


def blocks(body):
    """Quoted blocks line by line: written for the test."""
    lines, at, spans = body.split("\n"), 0, []
    starts = []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    k = 0
    while k < len(lines):
        x = lines[k]
        inside = x.startswith(">") or not x.strip()
        wrote = not inside and re.match(r"(?i)^.*(?:wrote|writes|said|sent):\s*$", x)
        if wrote or x.startswith(">"):
            j = k + 1
            while j < len(lines) and (lines[j].startswith(">") or not lines[j].strip()):
                j += 1
            spans.append((starts[k], min(starts[j - 1] + len(lines[j - 1]) + 1, len(body)), "quoted_reply"))
            k = j
        else:
            k += 1
    return spans


def test_random_blocks(spark):
    rng = random.Random(5)
    parts = ["> q", ">", "", "  ", "text", "On day, x wrote:", "> y wrote:", "he SAID:  ", "--x"]
    bodies = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    got = found(spark, bodies)
    for k, b in enumerate(bodies):
        assert [x for x in got[k][0] if x[2] == "quoted_reply"] == (blocks(b) if b else []), b


def test_markers(spark):
    bodies = ["😀 hi\n-----Original Message-----\nold", "a\n--- Forwarded by X\non day ---\nb", "x\nBEGIN forwarded message:\ny", "clean", "", None, "abcdef\n-- \nme", "ab\n--\nabcdefgh", "--- forwarded by x ---"]
    got = found(spark, bodies)
    assert got[0][0] == [(5, 35, "forward_header")] and got[0][1] == "😀 hi"
    assert got[1][0][0] == (2, len(bodies[1]), "forward_header")
    assert got[2][0][0][2] == "forward_header"
    assert got[3] == ([], "clean") and got[4][0] == [] and got[5][0] == []
    assert got[6][0] == [(7, 13, "signature")]  # 7 > 6
    assert got[7][0] == [] and got[8][0] == []  # too early; the mark's case counts


def test_noise_overlap(spark):
    df = spark.createDataFrame([(0, 5), (6, 9), (10, 10), (11, 12)], "s int, e int").withColumn("r", F.expr("array(named_struct('start', 5, 'end', 10, 'region_type', 'x'))"))
    assert [r["n"] for r in df.select(noise.in_noise(F.col("s"), F.col("e"), F.col("r")).alias("n")).collect()] == [False, True, False, False]


def locate(body, quote):
    """(start, end of last character) of a quote, or none: written for the test."""
    if not quote or not body:
        return None
    q, c = re.sub(r"\s+", " ", quote).strip(), re.sub(r"\s+", " ", body)
    at = c.find(q)
    at = at if at >= 0 else c.lower().find(q.lower())
    if at < 0:
        return None
    places = [i for i, x in enumerate(body) if not (x in " \t\n\r" and i and body[i - 1] in " \t\n\r")]
    end = at + len(q) - 1
    if at >= len(places) or end >= len(places):
        return None
    return places[at], places[end]


def test_quotes(spark):
    rng = random.Random(7)
    cases = [("  a b", "a b"), ("Hello\n  World", "hello world"), ("a", ""), ("", "a"), (None, "a"), ("x y  ", "  "), ("x", None), ("a  b c", "b c"), ("😀  z", "z"), ("same same", "same")]
    for _ in range(300):
        body = "".join(rng.choice("abA \n\t\x0b") for _ in range(rng.randrange(0, 14)))
        i = rng.randrange(0, 12)
        cases.append((body, rng.choice([body[i : i + 5], body[i : i + 4].upper(), "ab"])))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, body string, evidence string")
    for r in evidence.locate(df).collect():
        body, quote = cases[r["k"]]
        want = locate(body, quote)
        got = (r["char_start"], r["char_end"]) if r["char_start"] is not None else None
        assert got == want, (body, quote)
        assert r["evidence_verified"] == (None if not quote else want is not None)
