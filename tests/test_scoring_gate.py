from pyspark.sql import functions as F

from claimlake.operators import scoring

SCHEMA = "field string, idx int, name string, email string, description string, person_a string, person_b string, relationship_type string, evidence string, evidence_verified boolean, char_start int, char_end int, source string, target string, has_endpoint_keys boolean"
LONG = "x" * 40


def item(field="relationships", **k):
    base = dict.fromkeys([c.split(" ")[0] for c in SCHEMA.split(", ")])
    base |= {"field": field, "idx": 0, "has_endpoint_keys": False}
    if field == "relationships":
        base |= {"person_a": "A", "person_b": "B", "relationship_type": "informs", "evidence": LONG, "evidence_verified": True}
    return base | k


def run(spark, items):
    order = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    df = spark.createDataFrame([tuple(i[c] for c in order) for i in items], SCHEMA).withColumn("regions", F.expr("array(named_struct('start', 100, 'end', 200, 'region_type', 'signature'))"))
    return scoring.gate(scoring.score(df)).collect()


def test_scores(spark):
    cases = [
        (item(), 1.0), (item(evidence_verified=False), 0.7), (item(evidence=""), 0.5), (item(evidence=None), 0.5), (item(evidence="   "), 0.35),
        (item(evidence="y" * 19), 0.85), (item(evidence="y" * 20), 0.95), (item(evidence="y" * 39), 0.95), (item(evidence="z", evidence_verified=False), 0.55),
        (item(char_start=150, char_end=160), 0.9), (item(char_start=90, char_end=100), 1.0), (item(has_endpoint_keys=True, source="a"), 0.8),
        (item("people", name="N", email="e"), 0.9), (item("people", name="N"), 0.85), (item("deals", name="N"), 0.9),
    ]
    for r, (_, want) in zip(run(spark, [c[0] for c in cases]), cases, strict=True):
        assert r["confidence"] == want


def test_gate(spark):
    cases = [
        (item(), "approved", "confidence_above_soft_threshold:1.0"), (item(person_a=" "), "rejected", "hard_reject:missing_source"), (item(person_b=None), "rejected", "hard_reject:missing_target"),
        (item(person_a="Ann ", person_b=" ann"), "rejected", "hard_reject:self_referential"), (item(relationship_type="friend"), "rejected", "hard_reject:invalid_relationship_type:friend"),
        (item(evidence="z", evidence_verified=False), "rejected", "hard_reject:unverifiable_and_too_short"), (item(evidence=""), "rejected", "hard_reject:missing_evidence"),
        (item("people", name=" "), "rejected", "hard_reject:missing_name"), (item("decisions"), "rejected", "hard_reject:missing_description"),
        (item(evidence_verified=False), "approved", "confidence_above_soft_threshold:0.7"),
        (item(evidence_verified=False, evidence="y" * 30), "review", "confidence_in_review_band:0.65"),
    ]
    for r, (_, status, reason) in zip(run(spark, [c[0] for c in cases]), cases, strict=True):
        assert (r["status"], r["gate_reason"]) == (status, reason)


def test_thresholds(spark):
    df = spark.createDataFrame([(item()["field"], c) for c in (0.95, 0.7, 0.69, 0.3, 0.29, None)], "field string, confidence double")
    for c, kind in (("person_a", "A"), ("person_b", "B"), ("relationship_type", "informs"), ("evidence", LONG), ("name", None), ("description", None)):
        df = df.withColumn(c, F.lit(kind).cast("string"))
    got = [r["status"] for r in scoring.gate(df.withColumn("evidence_verified", F.lit(True))).collect()]
    assert got == ["approved", "approved", "review", "review", "rejected", "rejected"]
