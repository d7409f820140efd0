"""RFC-822 files to records. Decoding is Python (the standard library's email package)."""

from __future__ import annotations

import email
import email.policy
import re
from email.utils import parsedate_to_datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as X

# Fixed values
YEARS = (1995, 2005)
#: Starts each message of a mailbox file; sender and date aren't those of the message.
ENVELOPE = "From MAILER-DAEMON Thu Jan  1 00:00:00 1970\n"
_QUOTED = re.compile(rb"(?m)^>(>*From )")

RECORD = (
    "message_id string, from_addr string, to_addrs array<string>, cc_addrs array<string>, subject string, date string, body string, "
    "x_folder string, x_origin string, in_reply_to string, references array<string>, x_from_display string, x_to_display string, x_cc_display string, "
    "path string, error string"
)


def files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, content) of every file below folder; limit None or 0 means all."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return found.limit(limit) if limit else found


def write_mailboxes(messages: DataFrame, folder: str) -> None:
    """Write messages (one string column) as mailbox files (mboxrd), one a partition."""
    c = F.col(messages.columns[0])
    # (?d): lines end at LF only, as where mailboxes() parts them
    quoted = F.regexp_replace(c, "(?md)^(>*From )", ">$1")
    messages.select(F.concat(F.lit(ENVELOPE), quoted, F.lit("\n")).alias("value")).write.text(folder)


def mailboxes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every message in the mailbox files below folder, for parse(quoted=True).

    Files are split as any text, so neither their number nor their size matters. The path names
    the file and sorts as the messages stand in it.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\nFrom ").text(folder)
    place = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"), F.lit("."), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return found.select(place.alias("path"), F.col("value").cast("binary").alias("content"))


def peek(spark: SparkSession, folder: str, most: int = 5) -> tuple[int, list[str]]:
    """Number of files whose name has no leading dot, and the first paths. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    found = found.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return found.count(), [r["path"] for r in found.orderBy("path").limit(most).collect()]


def iso_date(value: str | None) -> str | None:
    """An RFC-2822 date in ISO form with its own offset; null outside YEARS (by its own year)."""
    if not value:
        return None
    try:
        found = parsedate_to_datetime(value)
    except (TypeError, ValueError, IndexError):
        return None
    return found.isoformat() if YEARS[0] <= found.year <= YEARS[1] else None


@lru_cache(maxsize=4096)
def _known_header(name: str, value: str):
    return email.policy.default.header_factory(name, value)


def _header(name: str, value: str):
    """Headers are parsed at each access and mostly repeat: short ones are kept."""
    return _known_header(name, value) if len(value) <= 500 else email.policy.default.header_factory(name, value)


_POLICY = email.policy.default.clone(header_factory=_header)


def unquoted(raw: bytes) -> bytes:
    """The message in a part of a mailbox file: without its envelope line and its marks."""
    return _QUOTED.sub(rb"\1", raw.partition(b"\n")[2])


def decode(raw: bytes) -> dict:
    """One message's record, lists as they stand in the headers; raises if it can't be decoded."""
    m = email.message_from_bytes(raw, policy=_POLICY)
    text = lambda name: str(m[name]).strip() if m[name] is not None else ""
    as_is = lambda name: str(m[name]) if m[name] is not None else None
    part = m.get_body(preferencelist=("plain",))
    return {
        "message_id": text("Message-ID"),
        "from_addr": text("From"),
        "to_addrs": as_is("To"),
        "cc_addrs": as_is("Cc"),
        "subject": text("Subject"),
        "date": iso_date(text("Date")),
        "body": part.get_content().strip() if part is not None else "",
        "x_folder": text("X-Folder"),
        "x_origin": text("X-Origin"),
        "in_reply_to": as_is("In-Reply-To"),
        "references": as_is("References"),
        "x_from_display": as_is("X-From"),
        "x_to_display": as_is("X-To"),
        "x_cc_display": as_is("X-cc"),
    }


def parse(found: DataFrame, quoted: bool = False) -> DataFrame:
    """Records of (path, content); error holds why a file has none. quoted: contents are of mailboxes()."""
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    raw = bytes(content)
                    rows.append({**decode(unquoted(raw) if quoted else raw), "path": path, "error": None})
                except Exception as e:  # any failure becomes a row of its own
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    rows = found.mapInPandas(run, RECORD.replace("array<string>", "string"))
    failed = F.col("error").isNotNull()
    lists = {c: F.when(~failed, X.address_list(F.col(c))) for c in ("to_addrs", "cc_addrs")}
    return rows.withColumns(lists | {"references": F.when(~failed, X.reference_list(F.col("references")))})


def parsed(records: DataFrame) -> DataFrame:
    return records.where("error is null").drop("error")


def failures(records: DataFrame) -> DataFrame:
    return records.where("error is not null").select("path", "error")
