import pytest
import random

from claimlake.operators import dedup, threads, versions
from claimlake.operators import components as components_module
from claimlake.operators.components import components


def root(parent, x):
    seen = set()
    while x in parent and x not in seen:
        seen.add(x)
        x = parent[x]
    return x


def test_roots_with_cycles(spark):
    rng = random.Random(1)
    for _ in range(4):
        parent = {f"m{k}": f"m{rng.randrange(80)}" for k in rng.sample(range(70), 45)}
        parent["m71"] = "outside"
        got = {r[0]: r[1] for r in threads.roots(spark.createDataFrame(list(parent.items()), "message_id string, parent string")).collect()}
        assert got == {k: root(parent, k) for k in parent}


def test_no_parents(spark):
    assert threads.roots(spark.createDataFrame([], "message_id string, parent string")).count() == 0


MAILS = "message_id string, subject string, date string, in_reply_to string, references array<string>, ord int"


def test_subject_threads(spark):
    rows = [("a", "Re: X", "2001-02", None, None, 0), ("b", "x", "2001-01", None, None, 1), ("c", "", None, None, None, 2), ("d", None, None, None, None, 3), ("e", "x", None, None, None, 4), ("", "x", None, None, None, 5)]
    df = spark.createDataFrame(rows, MAILS)
    assert not threads.has_headers(df)
    got = {(r["thread_id"], r["message_id"], r["position"]) for r in threads.rebuild(df).collect()}
    assert got == {("b", "b", 0), ("b", "a", 1), ("b", "e", 2), ("c", "c", 0), ("d", "d", 0)}


def test_header_threads(spark):
    rows = [("a", "", None, None, None, 0), ("b", "", "2001", " a ", None, 1), ("c", "", None, None, ["z", "b"], 2), ("d", "", None, "gone", None, 3), ("b", "", "2000", "a", None, 4)]
    got = {(r["thread_id"], r["message_id"], r["position"]) for r in threads.rebuild(spark.createDataFrame(rows, MAILS)).collect()}
    assert got == {("a", "b", 0), ("a", "a", 1), ("a", "c", 2), ("gone", "d", 0)}


@pytest.mark.parametrize("few", [0, 10_000])  # rounds of stars, and one task
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_exact(spark):
    rows = [("1", "Hi  there", "2001-02"), ("2", "hi there", None), ("3", " HI THERE ", "2001-01"), ("4", "other", None), ("5", None, None), ("6", "", None)]
    members = dedup.exact_members(spark.createDataFrame(rows, "message_id string, body string, date string"))
    got = {r["primary_id"]: r["duplicate_ids"] for r in dedup.exact_groups(members).collect()}
    assert got == {"3": ["1", "2"], "5": ["6"]}


def test_near(spark):
    # a-b-c chain, d apart; and a group of 11 equal vectors
    v = [(1, [1.0, 0.0, 0.0]), (2, [0.8, 0.6, 0.0]), (3, [0.28, 0.96, 0.0]), (4, [0.0, 0.0, -1.0])] + [(k, [0.0, 0.0, 1.0]) for k in range(10, 21)]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    mails = spark.createDataFrame([(k, str(k), None, "t" * (k % 5)) for k, _ in v], "vec_id long, message_id string, date string, text string")
    got = {r["primary_id"]: (r["duplicate_ids"], r["similarity"]) for r in dedup.near_groups(vectors, mails, 0.8).collect()}
    assert got["3"] == (["1", "2"], round((0.8 + 0.8 + 0.28) / 3, 4))
    assert got["14"][1] == 0.8 and len(got["14"][0]) == 10
    assert dedup.near_pairs(vectors, 0.8, block=2).count() == 2 + 55


def test_versions(spark):
    old = spark.createDataFrame([("a", "old", 0), ("b", None, 1), ("a", "new", 2)], "message_id string, prompt_version string, ord int")
    assert {r["prompt_version"] for r in versions.last_by_key(old).where("message_id = 'a'").collect()} == {"new"}
    assert versions.stale(old, "new").count() == 2
    new = spark.createDataFrame([("b", "new", 9)], old.schema)
    assert sorted((r[0], r[1]) for r in versions.upsert(old, new).collect()) == [("a", "new"), ("a", "old"), ("b", "new")]


def test_positions_over_slices(spark):
    """A subject whose mails lie in several slices, with ties in date and mails without one."""
    mails = spark.range(400).selectExpr("cast(id as string) message_id", "if(id % 9 = 0, null, concat('2001-01-0', id % 5)) date", "id ord", "if(id % 20 = 0, concat('other', id), 'Re: common') subject")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        dealt = mails.repartitionByRange("subject", "date", "ord").where("subject = 'Re: common'")
        assert dealt.selectExpr("spark_partition_id() p").distinct().count() > 1
        got = {(r["thread_id"], r["position"]): r["message_id"] for r in threads.by_subject(mails).collect()}
    finally:
        spark.conf.unset(coalesce)
    common = sorted((k for k in range(400) if k % 20), key=lambda k: ("9999" if k % 9 == 0 else f"2001-01-0{k % 5}", k))
    want = {(str(common[0]), n): str(k) for n, k in enumerate(common)} | {(str(k), 0): str(k) for k in range(0, 400, 20)}
    assert got == want
