"""Items from mails by a pluggable model, with validation, retries and a daily limit.

A model is a function from a prompt to JSON text. rule_model() is a deterministic one that
needs no network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as X
from claimlake.functions.schemas import EXTRACTION, FIELDS, MODEL_OUTPUT
from claimlake.operators import versions
from claimlake.scratch import cut

# Fixed values
DAILY_LIMIT, RETRIES, BACKOFF_S, PACE_S, REPAIRS = 10_000, 3, 60.0, 0.5, 2
TEMPORARY = ("429", "503", "disconnected", "timeout")


def is_temporary(error: Column) -> Column:
    """Whether an error's text speaks of a state that passes; numbers as they are, words in any case."""
    low = F.lower(error)
    return F.contains(error, F.lit("429")) | F.contains(error, F.lit("503")) | F.contains(low, F.lit("disconnected")) | F.contains(low, F.lit("timeout"))


def parse_output(c: Column) -> Column:
    """Model output as a struct; null if it isn't JSON of the schema. Control characters may stand in strings."""
    return F.from_json(c, MODEL_OUTPUT, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})


def rule_model(prompt: str) -> str:
    """People from capitalised word pairs, one relationship from the first line that names two."""
    body = prompt.split("\n\n", 1)[-1]
    names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", body)))
    rel = []
    for line in body.split("\n"):
        two = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", line)))
        if len(two) >= 2:
            rel.append({"person_a": two[0], "person_b": two[1], "relationship_type": "works_with", "evidence": line.strip()})
            break
    return json.dumps({"people": [{"name": n, "email": None, "role_or_title": None} for n in names], "organizations": [], "deals": [], "decisions": [], "relationships": rel})


def _call(model: Callable[[str], str], prompt: str, sleep: Callable[[float], None], repairs: int) -> tuple[str | None, str | None, str]:
    """(output, error, status) of one mail: tries again on passing errors, asks again on bad JSON."""
    error = None
    bad = 0
    tries = 0
    while tries < RETRIES:
        try:
            out = model(prompt)
        except Exception as e:  # the model's errors are data here
            error = str(e)
            if not ("429" in error or "503" in error or any(w in error.lower() for w in TEMPORARY[2:])):
                return None, error, "failed"
            tries += 1
            if tries < RETRIES:
                sleep(BACKOFF_S)
            continue
        try:
            found = json.loads(out, strict=False)
            if not isinstance(found, dict):
                raise ValueError("not an object")
            return json.dumps({f: found.get(f) or [] for f in FIELDS}), None, "done"
        except ValueError as e:
            error, bad = f"invalid output: {e}", bad + 1
            if bad > repairs:
                return None, error, "failed"
    return None, error, "retry"


#: Tasks that call the model at once where a limit is set.
CALLS = 8


def extract(mails: DataFrame, model: Callable[[str], str] = rule_model, repairs: int = REPAIRS, pace_s: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(message_id, output, error, status): status done, failed (for good) or retry (try another day).

    message_id comes from the mail, never from the model.
    """
    rows = mails.select("message_id", X.prompt(F.col("from_addr"), F.col("to_addrs"), F.col("subject"), F.col("body")).alias("prompt"))

    def run(frames):
        for f in frames:
            found = []
            for p in f["prompt"]:
                found.append(_call(model, p or "", sleep, repairs))
                if pace_s:
                    sleep(pace_s)
            yield pd.DataFrame({"message_id": f["message_id"], "output": [x[0] for x in found], "error": [x[1] for x in found], "status": [x[2] for x in found]})

    return rows.mapInPandas(run, "message_id string, output string, error string, status string")


def results(found: DataFrame, prompt_version: str = "", model_name: str = "") -> DataFrame:
    """Extraction records of the mails that are done."""
    rows = found.where("status = 'done'").select("message_id", F.lit(prompt_version).alias("prompt_version"), F.lit(model_name).alias("model_name"), parse_output(F.col("output")).alias("o"))
    return rows.select("message_id", "prompt_version", "model_name", *(f"o.{f}" for f in FIELDS)).to(found.sparkSession.createDataFrame([], EXTRACTION).schema)


def run_batch(mails: DataFrame, done: DataFrame, model: Callable[[str], str] = rule_model, limit: int | None = DAILY_LIMIT, ord: tuple[str, ...] = ("ord",), calls: int = CALLS, **options) -> DataFrame:
    """extract() for the next limit mails (None: all), in ingest order, whose id isn't done.

    The caller appends the result, then the ids with status done or failed to the done table.
    """
    rows = versions.pending(mails, done)
    if limit is not None:  # a limit leaves one partition, and calls take their time
        rows = rows.orderBy(*ord).limit(limit).repartition(calls)
    return extract(rows, model, **options)


def reextract_stale(mails: DataFrame, extractions: DataFrame, prompt_version: str, model_name: str, model: Callable[[str], str] = rule_model, limit: int | None = None, dry_run: bool = False, ord: tuple[str, ...] = ("ord",), **options) -> DataFrame:
    """extractions with those of another prompt version made anew; others stay as they are.

    limit: at most so many mails, in ingest order. dry_run returns the stale ids instead. What
    can't be extracted keeps its old record.
    """
    old = versions.stale(extractions, prompt_version).select("message_id").distinct()
    if dry_run:
        return old if limit is None else old.orderBy("message_id").limit(limit)
    rows = mails.join(old, "message_id", "left_semi")
    rows = rows if limit is None else rows.orderBy(*ord).limit(limit).repartition(CALLS)
    return versions.upsert(extractions, cut(results(extract(rows, model, **options), prompt_version, model_name), "reextracted"))


def to_items(extractions: DataFrame) -> DataFrame:
    """The nested lists as one long table of items: (message_id, field, idx, ...)."""
    columns = {
        "people": {"name": "name", "email": "email"},
        "organizations": {"name": "name", "org_type": "org_type"},
        "deals": {"name": "name", "description": "description"},
        "decisions": {"description": "description", "made_by": "made_by"},
        "relationships": {c: c for c in ("person_a", "person_b", "relationship_type", "evidence")},
    }
    every = ("name", "email", "org_type", "description", "made_by", "person_a", "person_b", "relationship_type", "evidence", "source", "target")

    def one(field: str):
        own = columns[field]

        def item(x: Column, i: Column) -> Column:
            values = [(x[own[c]] if c in own else F.lit(None).cast("string")).alias(c) for c in every]
            return F.struct(F.lit(field).alias("field"), i.alias("idx"), *values, F.lit(False).alias("has_endpoint_keys"))

        return F.transform(F.coalesce(F.col(field), F.array()), item)

    lists = [one(f) for f in FIELDS]
    return extractions.select("message_id", F.explode(F.concat(*lists)).alias("i")).select("message_id", "i.*")


def affects(extractions: DataFrame) -> DataFrame:
    """(message_id, idx, affects) of decisions."""
    d = extractions.select("message_id", F.posexplode("decisions").alias("idx", "d"))
    return d.select("message_id", "idx", F.explode("d.affects").alias("affects"))
