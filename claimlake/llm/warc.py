"""A content-addressed WARC archive.

Two tables under one folder. ``payloads`` holds each distinct payload once, under its SHA-256
address. ``records`` holds one exact WARC/1.1 record header a page and the address of its
payload. Reading joins them again: a record is its header, its payload (a revisit has none) and
the closing line ends; the bytes of a payload are checked against its address, and what a record
says is parsed from its rebuilt bytes alone.

Equal payloads of MIN_BYTES or more become one response (the largest page_id) and revisits that
refer to it by record id and page. The copies of a payload are combined before the shuffle, so a
payload that a third of all pages share moves once a task; joins on addresses are plain
equi-joins that AQE may split. Page ids travel as extension fields, as record ids must differ
even where page ids repeat or are null.

Defined cases: null html is empty; rows that share the largest page_id of a payload are all
responses (revisits refer to one of them); a null page_id ranks below all others and its record
has no page field; an empty table writes empty tables; extra columns are not read. The date of
all records is a parameter: pages have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.scratch import cut, new_path

MIN_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def _uuid(*values: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*values)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def _header(date: str) -> Column:
    """The header block of a record, with its empty last line, from the columns that write() makes."""
    revisit = F.col("refers_to").isNotNull()

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    # a line end in a url would end the header line
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record_id")),
        F.lit(f"WARC-Date: {date}"),
        line("WARC-Target-URI", url),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        line("WARC-Refers-To", F.col("refers_record")),  # left out where null
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        line("X-Payload-Length", F.col("length").cast("string")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))),
    ]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Archive (page_id, url, html) under path."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    heads = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("length"), F.sha1("payload").alias("sha1"))
    # written once: the row's number makes the ids of equal rows differ
    heads = cut(heads.withColumn("record_id", _uuid(F.col("page_id"), F.col("url"), F.col("address"), F.monotonically_increasing_id())), "heads")
    owner = F.max(F.struct("page_id", "record_id")).alias("owner")
    owners = heads.where(F.col("length") >= min_bytes).groupBy("address").agg(owner, F.count("*").alias("n")).where("n > 1").select("address", "owner")
    heads = heads.join(owners, "address", "left")
    refers = F.when(~F.col("owner.page_id").eqNullSafe(F.col("page_id")), F.col("owner"))
    heads = heads.withColumn("refers_to", refers["page_id"]).withColumn("refers_record", refers["record_id"])
    heads.select(_header(date).alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/records")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(header, payload) of every record, each payload checked.

    A payload that doesn't match its address, or is missing, raises an error.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    payloads = payloads.where(F.when(F.sha2("payload", 256) == F.col("address"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("boolean")))
    found = records.join(payloads, "address", "left")
    return found.select("header", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), F.col("address"))).cast("binary")).alias("payload"))


def _field(header: Column, name: str) -> Column:
    """The value of a header line; null where there is none."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def record_bytes(found: DataFrame) -> DataFrame:
    """(record): the exact bytes of each WARC record; revisits have no block."""
    block = F.when(_field(F.col("header"), "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return found.select(F.concat(F.encode("header", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def parse(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, block) from
    the bytes of records. A response whose block isn't what its header says raises an error."""
    # no header line is empty: the first empty line ends the header
    head = F.concat(F.substring_index(F.decode("record", "UTF-8"), END + END, 1), F.lit(END))
    rows = records.select("record", head.alias("head"))
    names = {"page_id": "X-Page-ID", "refers_to": "X-Refers-To-Page", "payload_bytes": "X-Payload-Length", "length": "Content-Length"}
    rows = rows.select("record", "head", *(_field(F.col("head"), v).cast("long").alias(k) for k, v in names.items()), *(_field(F.col("head"), v).alias(k) for k, v in {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "digest": "WARC-Payload-Digest"}.items()))
    rows = rows.withColumn("block", F.substring("record", F.octet_length("head") + 3, F.col("length").cast("int"))).withColumn("payload_digest", F.substring_index("digest", ":", -1))
    right = (F.col("record_type") == "revisit") | (F.sha1("block") == F.col("payload_digest")) & (F.octet_length("block") == F.col("payload_bytes"))
    rows = rows.where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id"))).cast("boolean")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "block")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parse(record_bytes(read(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc_archive": op3_warc_archive}
SQL = {
    "op3_warc_archive": """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint n, sha1(h) s, max(page_id) over (partition by h) o from p)
select page_id, n payload_bytes, s payload_digest,
 case when n >= 1000 and o <> page_id then 'revisit' else 'response' end record_type,
 case when n >= 1000 and o <> page_id then o end refers_to from d
""",
}
