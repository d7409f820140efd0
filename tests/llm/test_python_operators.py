import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from claimlake.llm import language, lines, pii, simhash, topk
from tests.llm.cases import documents, empty


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def group(keys, pairs):
    parent = {k: k for k in keys}
    for a, b in pairs:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {k: find(parent, k) for k in keys}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    docs = documents(spark, extra=True)
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    want = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == want and len(got) == len(rows)
    ids = sorted((k for k in want if k is not None))
    comp = group(ids, [(a, b) for a in ids for b in ids if a < b and (want[a] ^ want[b]).bit_count() <= 2])
    assert all(r["component_id"] == comp[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(2).choice("ab cd Ef gh".split()) for _ in range(500))
    monkeypatch.setattr(simhash, "PART", 37)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"  one\n") == plain_fingerprint("one")


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(simhash.T):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    index, anchor, home = simhash.anchors(x)
    i2, a2, _ = simhash.anchors(y)
    visits = set(zip(i2.tolist(), a2.tolist(), strict=True))
    assert all(v in visits for v in zip(index[home].tolist(), anchor[home].tolist(), strict=True))


def test_links_with_tiles(spark):
    """A dense ball of fingerprints, cut into small tiles, against all pairs."""
    rng = random.Random(4)
    prints = {0}
    for _ in range(250):
        x = rng.choice(sorted(prints))
        prints.add(x ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
        prints.add(rng.getrandbits(64))
    signed = [p - 2**64 if p >> 63 else p for p in sorted(prints)]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=8).collect()
    want = group(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2])
    assert group(signed, [(r["a"], r["b"]) for r in edges]) == want


def plain_shingles(norm):
    """Runs of 8 characters at every position, blanks as one blank."""
    flat = " ".join(norm.split())
    return frozenset(flat[i : i + 8] for i in range(max(1, len(flat) - 7)))


def test_lines(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam".split()) + str(rng.randrange(300)) for _ in range(24)) for _ in range(40)]
    rows = []
    for k in range(200):
        ws = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(1000))
        rows.append((k, "\n".join([" ".join(ws).upper() if k % 5 == 0 else " ".join(ws), "", "License: X", f"{k} {rng.getrandbits(80):x} own line {k}"]), None, None, 1))
    rows += [(None, "License: X\nnull id", None, None, 1), (500, None, None, None, 1), (501, "", None, None, 1), (502, "\t\n ", None, None, 1), rows[0]]
    docs = spark.createDataFrame(rows, empty(spark).schema).withColumn("line", F.lit(1)).withColumn("kept", F.lit("x"))
    judged = lines.dedup_lines(docs)
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in judged.collect()}
    places = {}
    for i, text, *_ in rows:
        for k, x in enumerate((text or "").split("\n")):
            if x.strip(lines.BLANKS):
                places[i, k] = x.strip(lines.BLANKS).lower()
    assert set(got) == set(places)
    texts = sorted(set(places.values()))
    sets = [plain_shingles(t) for t in texts]
    comp = group(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    first = {}
    order = sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    want = {p: first.setdefault(comp[texts.index(places[p])], p) == p for p in order}
    # at 0.8 a pair may be missed with a chance of about 2 %
    assert sum(want[p] != got[p] for p in want) <= 0.02 * len(want)
    assert got[None, 0] and not got[0, 2] and got[None, 1]
    cleaned = {r["doc_id"]: r["text"] for r in lines.drop_lines(docs, judged).collect()}
    assert cleaned[501] == "" and cleaned[500] is None and cleaned[None] == "License: X\nnull id"
    assert "License: X" not in cleaned[7] and "own line 7" in cleaned[7]
    assert lines.dedup_lines(empty(spark)).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        t = "".join(rng.choice("aZ0191.@@-+ ()é.") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == plain_spans(t), t
    for _ in range(4000):
        t = "".join(rng.choice("4111-1 ") for _ in range(60))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("9" * 200_000 + "a" * 200_000) == []  # linear time


def test_disclosure(spark):
    # a name that stands beside one address only, and common words that stand everywhere
    rows = [(k, f"please write to Quillon Varga at qv{0}@corp.example for the report today", None, None, 1) for k in range(5)]
    rows += [(10 + k, f"please write to someone else for the report today number {k}", None, None, 1) for k in range(200)]
    rows += [(400, None, None, None, 1), (401, "", None, None, 1), (None, "call +49 (30) 1234-5678 now", None, None, 1), rows[0]]
    docs = spark.createDataFrame(rows, empty(spark).schema).withColumn("row", F.lit(0)).withColumn("term", F.lit("x"))
    found = pii.find(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["base"], r["spans"]))
    text = rows[0][1]
    at = text.index("Varga")
    assert f":{at}:{at + 5}" in got[3][0][1] and got[3][0][1].startswith(got[3][0][0]) and len(got[0]) == 2
    assert not any(f":{text.index(w)}:" in got[3][0][1] for w in ("the", "report"))
    assert got[20] == [("", "")] and got[400] == [("", "")] and got[None][0][0].startswith("phone:5:")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs, rows=True)).collect()}
    assert "qv0@" not in clean[2] and "Varga" not in clean[2] and "the report today" in clean[2] and clean[20] == rows[15][1]
    assert clean[400] is None
    assert pii.find(empty(spark)).count() == 0


def test_pii_query(spark, tmp_path):
    texts = ["a@b.co, c@d.eu and 1.2.3.4", "card 4111 1111 1111 1111, call +49 (30) 1234-5678", "300.1.1.1", "", None, "😀 x@y.z\n+1-800-555-0199 \x00 0.0.0.0"]
    rows = [(k % 4 or None, t, None, None, 1) for k, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, empty(spark).schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r)[:-1] for r in pii.op9_pii(spark, str(tmp_path)).collect()]
    want = []
    for k, t, *_ in rows:
        spans = plain_spans(t or "")
        text = ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)
        want.append((k, *(sum(s[0] == kind for s in spans) for kind in pii.KINDS), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_language(spark):
    docs = documents(spark, n=200, extra=True)
    model = language.fit(docs)
    assert model.langs[:1] == ["en"] or set(model.langs) == {"en", "fr"}
    got = language.predict(docs.select("doc_id", "text", "lang", language.held_out(F.col("doc_id")).alias("h")), model).collect()
    fold = [r for r in got if r["h"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert fold and sum(r["lang_pred"] == r["lang"] for r in fold) >= 0.98 * len(fold)
    by = {r["doc_id"]: r for r in got}
    assert by[200]["lang_pred"] == by[201]["lang_pred"] == by[202]["lang_pred"] == by[207]["lang_pred"] == "und" and by[200]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == docs.count()
    none = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.predict(docs.select("doc_id", "text"), none).collect()} == {"und"}
    only = spark.createDataFrame([(900, "漢字だけ", None, None, 1)], empty(spark).schema)
    assert language.predict(only.select("doc_id", "text"), model).first()["lang_pred"] in model.langs
    # what a held-out document says of itself is never learnt
    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language.fit(lied).langs


def plain_top(rows, k):
    vecs = [(i, np.floor(1024 * np.array(v, dtype=np.float64))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in vecs if i % 100 == 0}.items()):
        s = sorted((-int(a @ b), i) for i, b in vecs if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top(spark):
    rng = np.random.default_rng(3)
    for scale, dim in ((1.0, 8), (50.0, 5)):
        rows = [(i, (rng.normal(size=dim) * rng.choice([0.1, 1, scale])).astype(np.float32).tolist()) for i in range(0, 1200, 2)]
        rows += [(5000 + i, rows[7][1]) for i in range(60)] + [(9999, rows[7][1]), (9999, rows[7][1])]
        rows += [(1, None), (3, [None] * dim), (7, [float("nan")] * dim), (9, [float("inf")] * dim), (None, rows[0][1]), (11, [1.0]), (10100, [2.0]), (13, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit(0)).withColumn("dim", F.lit("x"))
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df).collect())
        assert got == plain_top(rows, 10)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    big = spark.createDataFrame([(100, [1e9, -1e9]), (1, [1e9, 1e8])], "vec_id long, embedding array<double>")
    assert topk.top_k(big).first()["score"] == 2**63 - 1 or topk.top_k(big).count() == 1


def plain_backoff(train, text):
    """Word-first backoff by dictionaries: (language, share) of a text."""
    langs = sorted({x for x, _ in train}, key=lambda x: (-sum(y == x for y, _ in train), x))
    tables = ({}, {})
    for lang, t in train:
        for run in re.findall(r"[^\W\d_]+", t.lower()):
            for w in (run[i : i + 64] for i in range(0, len(run), 64)):
                for key in [(0, w), *((1, f" {w} "[i : i + n]) for n in range(1, 6) for i in range(len(w) + 3 - n))]:
                    at = tables[key[0]].setdefault(key[1], dict.fromkeys(langs, 0))
                    at[lang] += 1
    logs = []
    for t in tables:
        t = {k: v for k, v in t.items() if sum(v.values()) >= 2}
        whole = {x: sum(v[x] + 0.5 for v in t.values()) for x in langs}
        logs.append({k: np.array([np.log((v[x] + 0.5) / whole[x]) for x in langs]) for k, v in t.items()})
    total, any_word = np.zeros(len(langs)), False
    for run in re.findall(r"[^\W\d_]+", text.lower()):
        for w in (run[i : i + 64] for i in range(0, len(run), 64)):
            any_word = True
            if w in logs[0]:
                total += logs[0][w]
                continue
            for n in range(5, 0, -1):
                known = [logs[1][g] for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in logs[1]]
                if known:
                    total += np.mean(known, axis=0)
                    break
    p = np.exp(total - total.max())
    return (langs[int(np.argmax(total))], float(p.max() / p.sum())) if any_word else ("und", 0.0)


def test_language_against_plain_backoff(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(k, " ".join("".join(rng.choice(("abcde", "cdefg", "漢字仮名")[k % 3]) for _ in range(rng.choice([2, 5, 9, 150]))) for _ in range(12)), ("aa", "bb", "cc")[k % 3] if k % 5 else None, None, 1) for k in range(150)]
    df = spark.createDataFrame(docs, empty(spark).schema)
    fold = {r["doc_id"]: r["h"] for r in df.select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()}
    train = [(lang, t) for k, t, lang, *_ in docs if lang and not fold[k]]
    want = {k: plain_backoff(train, t) for k, t, *_ in docs}
    model = language.fit(df)
    for kept in (language.KEPT, 30):  # with room for all rows, and for hardly any
        monkeypatch.setattr(language, "KEPT", kept)
        look = language._Lookup(model)
        for k, t, *_ in docs:
            best, share = look.score(t)
            assert model.langs[best] == want[k][0] and abs(share - want[k][1]) < 1e-3
