import re

import pytest
from pyspark.sql import functions as F

from claimlake.llm import mixing, quality, registry, warc
from claimlake.llm.registry import SQL
from tests.llm.cases import documents, empty
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], SQL[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        s = by.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["target"], "source_size": r["source_size"]})
        s["size"] += r["size"]
        s["taken"] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total, weights = sum(s["size"] for s in by.values()), {}
    for k, name in enumerate(sorted(by, key=lambda x: (x is None, x))):
        weights[name] = (3, 1, 2)[k % 3]
    # water filling by hand
    target, open_ = dict.fromkeys(by, 0.0), set(by)
    left = 1.5 * total
    while open_:
        level = left / sum(weights[x] for x in open_)
        full = {x for x in open_ if level * weights[x] > 2 * by[x]["size"]}
        if not full:
            target |= {x: level * weights[x] for x in open_}
            break
        for x in full:
            target[x] = 2.0 * by[x]["size"]
            left -= target[x]
        open_ -= full
    for x, s in by.items():
        assert s["size"] == s["source_size"] and abs(s["target"] - target[x]) < 1e-6 * max(1, target[x])
        assert s["taken"] == int(s["target"] + 1e-9) or abs(s["taken"] - s["target"]) <= 1
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in rows}
    assert mixing.mix(empty(spark)).count() == 0
    wordless = spark.createDataFrame([(1, None, None, "a", 0), (2, " ", None, "b", 0)], empty(spark).schema)
    assert [r["taken"] for r in mixing.mix(wordless).collect()] == [0, 0]


def test_quality_prefers_good(spark):
    docs = documents(spark, extra=False).where("source is not null and doc_id is not null and size(split(text, ' ')) < 400")
    labels = docs.select("doc_id", F.lit(0).alias("quality")).distinct()
    one = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, labels).collect()}
    assert len(one) == docs.select("doc_id").distinct().count()


def test_rules(spark):
    docs = documents(spark)
    repeated = spark.createDataFrame([(900, "a b c d e f a b c d e g a b c d e", None, None, 0), (901, "x\nx\n x\n\nx", None, None, 0), (902, "one two three four", None, None, 0), (903, "THIS IS ALL SHOUTED TEXT OF TEN WORDS OR MORE HERE", None, None, 0)], empty(spark).schema)
    book = quality.ledger(docs.select(*repeated.columns).unionAll(repeated))
    got = {r["doc_id"]: r for r in book.collect()}
    for r in docs.collect():
        w = words(r["text"])
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)} if len(w) < 500 else None
        g = got[r["doc_id"]]
        assert g["n_words"] == len(w) and g["word_chars"] == sum(map(len, w))
        if covered is not None:
            assert g["n_repeat_words"] == len(covered)
    assert got[900]["n_repeat_words"] == 15 and got[901]["n_dup_lines"] == 2 and got[902]["n_repeat_words"] == 0
    assert got[903]["failures"] & 1 << 4
    judged = {r["doc_id"]: r["kept"] for r in quality.apply_policy(book).collect()}
    assert not judged[902] and not judged[60]
    rates = {r["rule"]: r for r in quality.ablations(book).collect()}
    assert rates["too_short"]["failed"] == sum(bool(g["failures"] & 1) for g in book.collect())
    for p in quality.POLICIES:
        assert quality.apply_policy(book, p).where("kept").count() <= book.count()
    assert quality.ledger(empty(spark)).count() == 0


def test_archive(spark, tmp_path):
    long = "<p>é" + "x" * 1200
    rows = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit(1)).withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write(pages, path)
    found = warc.read(spark, path)
    records = warc.record_bytes(found)
    parsed = warc.parse(records).collect()
    got = {r["page_id"]: r for r in parsed}
    assert got[3]["record_type"] == "response" and got[3]["refers_to"] is None
    assert {got[k]["refers_to"] for k in (1, 2, None)} == {3}
    assert got[4]["record_type"] == got[5]["record_type"] == "response" and got[6]["payload_bytes"] == 0
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    assert len({r["record_id"] for r in parsed}) == len(rows) == len(parsed)
    for r in records.collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        assert block == block[:size] + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n") and b"X" not in fields
        assert fields[b"WARC-Date"] == b"1970-01-01T00:00:00Z" and fields[b"WARC-Record-ID"].startswith(b"<urn:uuid:")
        page = got[int(fields[b"X-Page-ID"]) if b"X-Page-ID" in fields else None]
        revisit = fields[b"WARC-Type"] == b"revisit"
        assert revisit == (page["record_type"] == "revisit") == (b"WARC-Profile" in fields)
        assert size == (0 if revisit else page["payload_bytes"])
        if revisit:
            assert fields[b"WARC-Refers-To"].decode() == got[page["refers_to"]]["record_id"]
    # a damaged payload is noticed
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}2/records")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, f"{path}2").collect()
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
