import pytest

from claimlake.plans import queries as core
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_duckdb(spark, sf_dir, name):
    compare(spark, sf_dir, core.QUERIES[name], core.SQL[name])


@pytest.mark.parametrize("name", ["confidence_buckets", "graph_claims", "penalty_counts", "review_penalties"])
def test_quotes_that_end_in_a_line_end(spark, tmp_path, name):
    """A quote of 39 characters and LF has the length 40 in the SQL: no short quote, so 0.9 within a reply."""
    rows = [(5, 1, "user", "y" * 60 + "\n" + "z" * 4), (5, 2, "assistant", "yes"), (12, 1, "user", "y" * 60 + "\n" + "z" * 6), (20, 1, "user", "y" * 60 + " \n" + "z" * 6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    compare(spark, str(tmp_path), core.QUERIES[name], core.SQL[name])


def test_boundaries_have_rows(spark, sf_dir):
    assert core.QUERIES["ingest_eml"](spark, sf_dir).count() > 0
    assert core.QUERIES["offline_extract"](spark, sf_dir).count() > 0
    assert core.QUERIES["sample_mails"](spark, sf_dir).count() == 25


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
