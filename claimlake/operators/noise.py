"""Parts of a mail body that its sender didn't write: forwards, quotes, signatures.

One fold over a body's lines finds quoted blocks and the signature; no line leaves its row,
so there is no shuffle. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions.text import WS, strip

# Fixed values
FORWARDS = (
    rf"(?iu)-{{3,}}{WS}*Original Message{WS}*-{{3,}}",
    rf"-{{3,}}{WS}*Forwarded by{WS}+.+?-{{3,}}",
    r"(?iu)Begin forwarded message:",
)
WROTE = rf"(?iud)^.*(?:wrote|writes|said|sent):{WS}*$"
SIGNATURE = rf"(?d)^(?:--|_{{3,}}|-{{3,}}|[*]{{3,}}){WS}*$"

REGION = "struct<start:int,end:int,region_type:string>"


def _region(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("region_type"))


def _forwards(body: Column) -> Column:
    """The first match of each forward pattern, to the end of the body."""
    found = [F.when(body.rlike(f"(?s){p}"), _region(F.length(F.regexp_extract(body, f"(?s)^(.*?)(?:{p})", 1)), F.length(body), "forward_header")) for p in FORWARDS]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def _line_regions(body: Column) -> Column:
    """Quoted blocks in order, then the signature.

    A block opens at a line like "... wrote:" that isn't quoted itself, or at the first '>'
    line of a run of quoted and blank lines, and goes on to the end of that run.
    """
    total = F.length(body)
    none = F.lit(-1)
    start = F.struct(F.lit(0).alias("at"), none.alias("open"), none.alias("end"), none.alias("sig"), F.array().cast(f"array<{REGION}>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        after = s["at"] + F.length(line) + 1
        quoted = line.startswith(">")
        inside = quoted | (strip(line) == "")
        wrote = ~inside & line.rlike(WROTE)
        is_open = s["open"] >= 0
        closed = F.when(is_open & ~inside, F.concat(s["out"], F.array(_region(s["open"], F.least(s["end"], total), "quoted_reply")))).otherwise(s["out"])
        opens = wrote | (quoted & ~is_open)
        goes_on = inside & is_open
        return F.struct(
            after.alias("at"),
            F.when(opens, s["at"]).when(goes_on, s["open"]).otherwise(none).alias("open"),
            F.when(opens | goes_on, after).otherwise(none).alias("end"),
            F.when((s["at"] > total * 0.5) & line.rlike(SIGNATURE), s["at"]).otherwise(s["sig"]).alias("sig"),
            closed.alias("out"),
        )

    def finish(s: Column) -> Column:
        last = F.when(s["open"] >= 0, F.array(_region(s["open"], F.least(s["end"], total), "quoted_reply"))).otherwise(F.array().cast(f"array<{REGION}>"))
        sig = F.when(s["sig"] >= 0, F.array(_region(s["sig"], total, "signature"))).otherwise(F.array().cast(f"array<{REGION}>"))
        return F.concat(s["out"], last, sig)

    return F.aggregate(F.split(body, "\n"), start, step, finish)


def regions(body: Column) -> Column:
    """array<struct<start,end,region_type>>: forwards, quoted blocks, signature; [] for null or ''."""
    return F.when(F.coalesce(F.length(body), F.lit(0)) > 0, F.concat(_forwards(body), _line_regions(body))).otherwise(F.array().cast(f"array<{REGION}>"))


def in_noise(start: Column, end: Column, found: Column) -> Column:
    """Whether start..end meets a region. Callers pass the place of a quote's last character as end."""
    return F.exists(found, lambda r: (start < r["end"]) & (end > r["start"]))


def original(body: Column, found: Column) -> Column:
    """The body's text outside all regions: parts stripped, empty ones left out, joined by LF."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, r: Column) -> Column:
        part = F.substring(body, s["at"] + 1, r["start"] - s["at"])
        return F.struct(F.greatest(s["at"], r["end"]).alias("at"), F.when(r["start"] > s["at"], F.concat(s["parts"], F.array(part))).otherwise(s["parts"]).alias("parts"))

    def finish(s: Column) -> Column:
        parts = F.concat(s["parts"], F.array(F.substring(body, s["at"] + 1, F.length(body))))
        return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n")

    ordered = F.array_sort(found, lambda x, y: x["start"] - y["start"])
    return F.when(F.size(found) == 0, body).otherwise(F.aggregate(ordered, begin, step, finish))


def with_regions(mails: DataFrame) -> DataFrame:
    return mails.withColumn("regions", regions(F.col("body")))


def with_original(mails: DataFrame) -> DataFrame:
    """mails with original_content; '' for a blank body."""
    body = F.coalesce("body", F.lit(""))
    kept = F.when(strip(body) == "", F.lit("")).otherwise(original(body, F.col("regions")))
    return with_regions(mails).withColumn("original_content", kept).drop("regions")


def region_stats(mails: DataFrame) -> DataFrame:
    """(region_type, regions, mails) over all mails."""
    rows = with_regions(mails).select("message_id", F.explode("regions").alias("r"))
    return rows.groupBy(F.col("r.region_type").alias("region_type")).agg(F.count("*").alias("regions"), F.countDistinct("message_id").alias("mails"))
