"""Disclosing terms far from a protected value, and in texts without one."""

from claimlake.llm import pii
from tests.llm.cases import empty


def test_far_terms(spark):
    far = "Quillon met the board and then all of us went home for a long rest before mail came in from qv@corp.example today"
    texts = [far] * 30 + ["Quillon met the board and then all of us went home for a long rest before mail came in"] + ["the board and then all of us went home for a long rest before mail met came from today"] * 200
    docs = spark.createDataFrame([(k, t, None, None, 1) for k, t in enumerate(texts)], empty(spark).schema)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[0]["spans"] == got[0]["base"] + ",remove:0:7" or got[0]["spans"] == got[0]["base"] + ",generalise:0:7"
    assert got[30]["base"] == "" and got[30]["spans"] == got[0]["spans"].split(",")[1]
    assert got[40]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(docs, rows=True)).collect()}
    assert "Quillon" not in clean[3] and "Quillon" not in clean[30] and clean[40] == texts[40]
