"""Node and edge tables for a knowledge graph, from gated items.

Only approved items are loaded; every mail becomes a Message. Ids are deterministic, rows that
share one are one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as X

#: label and key column of each node table
NODES = {"Person": "id", "Organization": "id", "Deal": "id", "Decision": "id", "Claim": "id", "Evidence": "id", "Message": "message_id"}


def _approved(gated: DataFrame, field: str) -> DataFrame:
    return gated.where((F.col("status") == "approved") & (F.col("field") == field))


def persons(gated: DataFrame) -> DataFrame:
    """(id, canonical_name, email, mentions): one row an id; the smallest spelling and address."""
    rows = _approved(gated, "people").withColumn("id", X.person_key(F.col("name")))
    return rows.groupBy("id").agg(F.min("name").alias("canonical_name"), F.min(F.nullif("email", F.lit(""))).alias("email"), F.count("*").alias("mentions"))


def organizations(gated: DataFrame) -> DataFrame:
    rows = _approved(gated, "organizations").withColumn("id", X.org_key(F.col("name")))
    return rows.groupBy("id").agg(F.min("name").alias("canonical_name"), F.min(F.nullif("org_type", F.lit(""))).alias("org_type"), F.count("*").alias("mentions"))


def deals(gated: DataFrame) -> DataFrame:
    rows = _approved(gated, "deals").withColumn("id", X.deal_key(F.col("name")))
    return rows.groupBy("id").agg(F.min("name").alias("name"), F.min("description").alias("description"), F.count("*").alias("mentions"))


def decisions(gated: DataFrame, mails: DataFrame) -> DataFrame:
    rows = _approved(gated, "decisions").withColumn("id", X.decision_key(F.col("message_id"), F.col("description")))
    rows = rows.groupBy("id", "message_id").agg(F.min("description").alias("description"), F.min("made_by").alias("made_by"))
    return rows.join(mails.select("message_id", F.col("date").alias("decided_on")), "message_id", "left").select("id", "message_id", "description", "made_by", "decided_on")


def claims(gated: DataFrame, mails: DataFrame) -> DataFrame:
    """(id, type, subject_id, object_id, message_id, quote, confidence, valid_from): approved relationships."""
    rows = _approved(gated, "relationships").withColumn("subject_id", X.person_key(F.col("person_a"))).withColumn("object_id", X.person_key(F.col("person_b")))
    rows = rows.withColumn("id", X.claim_key(F.col("message_id"), F.col("relationship_type"), F.col("subject_id"), F.col("object_id"), F.col("evidence")))
    rows = rows.groupBy("id").agg(*(F.min(c).alias(a) for c, a in (("relationship_type", "type"), ("subject_id", "subject_id"), ("object_id", "object_id"), ("message_id", "message_id"), ("evidence", "quote"))), F.max("confidence").alias("confidence"))
    dates = mails.select("message_id", F.substring("date", 1, 10).alias("valid_from"))
    return rows.join(dates, "message_id", "left").select("id", "type", "subject_id", "object_id", "message_id", "quote", "confidence", "valid_from")


def evidence(gated: DataFrame) -> DataFrame:
    rows = _approved(gated, "relationships").withColumn("id", X.evidence_key(F.col("message_id"), F.col("evidence")))
    noisy = F.exists("confidence_penalties", lambda p: p["name"] == "in_noise_region")
    return rows.groupBy("id").agg(F.min("evidence").alias("quote"), F.min("char_start").alias("char_start"), F.min("char_end").alias("char_end"), F.max(noisy).alias("in_quoted_block"))


def messages(mails: DataFrame) -> DataFrame:
    return mails.select("message_id", F.substring("date", 1, 10).alias("date"), "subject", "from_addr", "body", "x_origin").dropDuplicates(["message_id"])


def claims_as_of(found: DataFrame, day: str) -> DataFrame:
    """Claims that held on day (ISO); claims without a date are never in a point in time."""
    held = F.col("valid_from") <= day
    if "valid_to" in found.columns:
        held = held & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    return found.where(held)


def affects_edges(gated: DataFrame, affects: DataFrame) -> DataFrame:
    """(message_id, decision_id, name, target_id): target null where no item of the mail has the name."""
    known = gated.where("status = 'approved' and field in ('people', 'organizations')")
    known = known.select("message_id", F.lower("name").alias("_n"), F.when(F.col("field") == "people", X.person_key(F.col("name"))).otherwise(X.org_key(F.col("name"))).alias("target_id"))
    known = known.groupBy("message_id", "_n").agg(F.max("target_id").alias("target_id"))  # a person before an organization
    d = _approved(gated, "decisions").select("message_id", "idx", X.decision_key(F.col("message_id"), F.col("description")).alias("decision_id"))
    rows = affects.join(d, ["message_id", "idx"]).withColumn("_n", F.lower("affects"))
    return rows.join(known, ["message_id", "_n"], "left").select("message_id", "decision_id", F.col("affects").alias("name"), "target_id")


def uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    """(label, nodes, duplicate_ids): the constraint that each node's key stands once."""
    found = None
    for label, df in sorted(tables.items()):
        key = NODES[label]
        one = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("nodes"), F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("duplicate_ids")).select(F.lit(label).alias("label"), "nodes", "duplicate_ids")
        found = one if found is None else found.unionByName(one)
    return found


#: Properties that queries filter on, by label.
INDEXED = {
    "Person": ("canonical_name", "is_deleted"),
    "Organization": ("canonical_name", "org_type", "is_deleted"),
    "Claim": ("type", "status", "valid_from", "valid_to", "is_deleted"),
    "Message": ("date",),
    "Decision": ("is_deleted",),
    "Deal": ("is_deleted",),
}


def statements() -> list[str]:
    """Statements that a property-graph database takes for the same keys and indexes."""
    unique = [f"CREATE CONSTRAINT {label.lower()}_key IF NOT EXISTS FOR (n:{label}) REQUIRE n.{key} IS UNIQUE" for label, key in NODES.items()]
    return unique + [f"CREATE INDEX {label.lower()}_{p} IF NOT EXISTS FOR (n:{label}) ON (n.{p})" for label, ps in INDEXED.items() for p in ps]


def issue(execute, wanted: list[str] | None = None) -> list[tuple[str, str | None]]:
    """(statement, error) after execute(statement) of each; one that fails doesn't stop the rest."""
    out = []
    for s in statements() if wanted is None else wanted:
        try:
            execute(s)
            out.append((s, None))
        except Exception as e:  # the database's answer is reported
            out.append((s, str(e)))
    return out


def write(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table a label, clustered by key so that readers prune by its range."""
    for label, df in tables.items():
        df.repartitionByRange(NODES[label]).sortWithinPartitions(NODES[label]).write.mode("overwrite").parquet(f"{path}/{label}")
