import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from claimlake.llm import lines, mixing, simhash  # noqa: E402
from tests.llm.cases import documents  # noqa: E402


def test_stages(spark, tmp_path):
    docs = documents(spark, n=120, extra=False)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, path)
        now.write.parquet(f"{path}/{name}")
        now = spark.read.parquet(f"{path}/{name}")
        if name != "pack":
            assert now.columns == docs.columns
        ids, old = ({r[0] for r in df.select("doc_id").collect()} for df in (now, before))
        if name == "language":
            # documents without a letter go, the others stay
            assert old - ids == {120, 121, 122, 127}
        if name == "lines":
            judged = lines.dedup_lines(before)
            assert now.select(F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''").groupBy("x").count().where("count > 3").count() == 0 and judged.where("kept").count() > 0
        if name == "near_duplicates":
            groups = simhash.near_duplicates(before).collect()
            assert ids == {r["component_id"] for r in groups}
            assert now.count() == len(ids)
        if name == "mix":
            took = {}
            for r in mixing.mix(before, spark.read.parquet(f"{path}/labels.parquet")).collect():
                took[r["doc_id"]] = round(r["taken"] / r["size"]) if r["size"] else 0
            got = {r["doc_id"]: r["count"] for r in now.groupBy("doc_id").count().collect()}
            assert all(abs(got.get(k, 0) - n) <= 1 for k, n in took.items())
        if name == "pack":
            full = now.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
            assert full.where("n <> end or n > 2048").count() == 0 and ids == old


def test_awkward_tables(spark, tmp_path):
    """Clashing columns, several rows without an id, ids with two texts, and an empty table."""
    docs = documents(spark, n=80)
    more = [(None, "a first text of some words that has no id of its own"), (None, "quite another one, without an id as well, on other things"), (5, "the fifth id again, but with a text that nobody else has got")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in more], docs.select("doc_id", "text", "lang", "source", "n_chars").schema), allowMissingColumns=True)
    path = str(tmp_path)
    spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for table, kind in ((docs, "all"), (docs.limit(0), "none")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, path)
            out.write.parquet(f"{path}/{kind}-{name}")
            now = spark.read.parquet(f"{path}/{kind}-{name}")
            if name != "pack":
                assert now.columns == docs.columns
            if name in ("language", "lines", "near_duplicates") and kind == "all":
                assert {t for _, t in more} <= {r["text"] for r in now.select("text").collect()}
            if kind == "none":
                assert now.count() == 0


def test_copies_stay_with_their_row(spark):
    """Rows of one id and size don't share what the mix takes of them."""
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(1, "alpha beta", "a"), (1, "gamma delta", "a"), (None, "one two", "a"), (None, "six ten", "a")] + [(k, "many words of a source that is far larger " * 4, "b") for k in range(2, 40)], schema)
    mixed = mixing.mix(docs, rows=True)
    want = sum(round(r["taken"] / r["size"]) for r in mixed.collect())
    assert mixing.take(mixed).count() == want and mixing.take(mixed).columns == docs.columns


def test_even_slices(spark, monkeypatch):
    """Slices hold about as many rows each, whatever the labels say."""
    monkeypatch.setattr(mixing, "SLICES", 16)
    docs = spark.range(20_000).selectExpr("id as doc_id", "'w' as text", "'s' as source")
    seen = []
    real = mixing.cut
    monkeypatch.setattr(mixing, "cut", lambda df, name="cut": seen.append((name, real(df, name))) or seen[-1][1])
    for quality in (0, 1):
        seen.clear()
        mixing.mix(docs, docs.select("doc_id", F.lit(quality).alias("quality"))).count()
        rows, sources = dict(seen)["sizes"], dict(seen)["sources"].first()
        kinds = [sources[f"_n{k}"] for k in range(3)]
        q = (mixing.GOOD, 1.0, mixing.POOR)[kinds.index(20_000)]
        sizes = [r["count"] for r in rows.groupBy(F.floor(sources["_slices"] * (1 - F.exp(-q * F.col("_key"))))).count().collect()]
        assert len(sizes) == sources["_slices"] == 16 and max(sizes) < 1.3 * min(sizes)
