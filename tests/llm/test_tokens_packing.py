import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimlake.llm import packing, token_files
from claimlake.llm.text import chunks
from claimlake.llm.tokens import WordIds, default_vocabulary
from claimlake.scratch import cut
from tests.llm.cases import documents, empty

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = WordIds(default_vocabulary())


def ids(text):
    return WORDS.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("aBcé É.,!'s\n\t ñß<|>0́  İKµªſ")), st.characters(codec="utf-8")), max_size=60))
def test_words_are_whole_texts(text):
    assert array("I", WORDS.encode(text)).tolist() == ids(text)


def test_special_tokens_and_runs():
    for text in ("A<|endoftext|>B", "it's, we'll. I'M", "a.,b", "word,word.", "x" * 300, "É,é. Ñ,"):
        assert array("I", WORDS.encode(text)).tolist() == ids(text)


def test_chunks_lose_nothing():
    text = "ab cd\nef " * 50 + "z" * 40 + " end"
    assert "".join(chunks(text, 16)) == text
    assert list(chunks("", 4)) == [""]


def expected(rows):
    out = []
    for i, text in rows:
        t = ids(text or "") + [0]
        out += [(i, k // 2048, k, len(t[k : k + 2048]), zlib.crc32(array("I", t[k : k + 2048]).tobytes())) for k in range(0, len(t), 2048)]
    return sorted(out, key=str)


def test_pack(spark):
    docs = documents(spark)
    found = packing.pack(cut(packing.token_pieces(docs, keep_ids=True), "pieces"))
    rows = found.collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    whole = packing.sequences(found).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total


def test_pack_empty(spark):
    assert packing.pack(cut(packing.token_pieces(empty(spark)), "pieces")).count() == 0


def test_plan_is_whole():
    rng = np.random.default_rng(0)
    for n in (1, 7, 500, 20_000):
        hist = np.zeros(2049, dtype=np.int64)
        np.add.at(hist, np.clip(rng.lognormal(5.5, 1.2, n).astype(int), 1, 2048), 1)
        p = packing.plan(hist)
        total = int((hist * np.arange(2049)).sum())
        assert int(p["sequences"][0]) <= -(-total // 2048) * 1.02 + 2
        # every length's slots cover its ranks, and no sequence is overfull
        pats, counts = packing.fit(hist)
        assert (sum(np.bincount(pats[:, i], weights=counts, minlength=2049) for i in range(3))[1:] <= hist[1:]).all()


def test_token_files(spark, tmp_path):
    docs = documents(spark)
    path = str(tmp_path / "orc")
    token_files.write(docs, path)
    rows = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.checksums(token_files.read(spark, path)).collect()]
    given_rows = sorted([(r["doc_id"], r["text"]) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted((i is not None, i or 0, len(ids(t or "")) + 1, zlib.crc32(array("I", ids(t or "") + [2]).tobytes())) for i, t in given_rows)
    assert sorted((i is not None, i or 0, n, c) for i, _, n, c in rows) == want
    at = 0
    for _, start, n, _ in sorted(rows, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [i for i, s, n, c in sorted(rows, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    token_files.write(empty(spark), str(tmp_path / "none"))
    assert spark.read.schema("doc_id long").orc(str(tmp_path / "none")).count() == 0
