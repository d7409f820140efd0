"""python -m claimlake COMMAND ...: the batch runs, each from tables to tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from claimlake.functions.schemas import EMAIL, EXTRACTION
from claimlake.functions.text import prompt_hash
from claimlake.operators import dedup, extract, noise, reports, select, threads, versions
from claimlake.plans import enrich
from claimlake.scratch import cut
from claimlake.sources import mail, tables


def _mails(spark: SparkSession, path: str):
    return tables.read_ordered(spark, path, EMAIL)


def _keyed(spark: SparkSession, path: str):
    """One mail an id, the last one."""
    return tables.read_keyed(spark, path, EMAIL, "message_id")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="claimlake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str):
        c = sub.add_parser(name)
        for x in paths:
            c.add_argument(x)
        return c

    command("ingest", "folder", "out").add_argument("--limit", type=int, default=0)
    command("peek", "folder")
    command("threads", "mails", "out")
    command("quality", "mails")
    c = command("subset", "mails", "out")
    c.add_argument("--origins", nargs="+", required=True)
    c.add_argument("--per-origin", type=int, default=1500)
    c.add_argument("--most", type=int, default=10_000)
    c = command("dedup", "mails", "out")
    c.add_argument("--threshold", type=float, default=dedup.THRESHOLD)
    c.add_argument("--exact-only", action="store_true")
    c.add_argument("--vectors", help="Parquet of (message_id, vec_id, embedding)")
    c = command("enrich", "extractions", "mails", "out")
    c.add_argument("--prompt", default="")
    c.add_argument("--model", default="")
    c = command("reextract", "extractions", "mails", "out")
    c.add_argument("--prompt", required=True)
    c.add_argument("--model", default="rules")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--limit", type=int)
    c = command("review", "items")
    c.add_argument("start", type=int)
    c.add_argument("count", type=int)
    c.add_argument("--mails", help="show each item beside its mail")
    c = command("extract", "mails", "done", "out")
    c.add_argument("--prompt", default="")
    c.add_argument("--limit", type=int, default=extract.DAILY_LIMIT, help="0 for all")
    c.add_argument("--pace", type=float, default=0.0)
    command("versions", "extractions")
    c = command("sample", "mails", "out")
    c.add_argument("n", type=int)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName(f"claimlake {a.command}").getOrCreate()

    def digest(text: str) -> str:
        return spark.range(1).select(prompt_hash(F.lit(text)).alias("h")).first()["h"]

    if a.command == "ingest":
        mail.parse(mail.files(spark, a.folder, a.limit)).write.mode("overwrite").parquet(f"{a.out}/all")
        done = spark.read.parquet(f"{a.out}/all")
        tables.write_jsonl(mail.parsed(done), f"{a.out}/mails")
        tables.write_jsonl(mail.failures(done), f"{a.out}/failures")
    elif a.command == "peek":
        n, first = mail.peek(spark, a.folder)
        print(n, *first, sep="\n")
    elif a.command == "threads":
        found = threads.rebuild(_mails(spark, a.mails))
        tables.threads_json(found, f"{a.out}/threads")
        tables.write_report(threads.stats(found), f"{a.out}/stats")
    elif a.command == "quality":
        rows = _mails(spark, a.mails)
        for r in (reports.data_quality(rows), reports.id_duplicates(rows), reports.length_quantiles(rows)):
            print(tables.one_row(r))
    elif a.command == "subset":
        tables.write_jsonl(select.subset(_mails(spark, a.mails), a.origins, a.per_origin, a.most).drop("ord"), a.out)
    elif a.command == "dedup":
        rows = _mails(spark, a.mails)
        vectors = None if a.exact_only or not a.vectors else spark.read.parquet(a.vectors)
        groups = dedup.run(rows if vectors is None else noise.with_original(rows), vectors, a.threshold)
        tables.write_jsonl(groups, f"{a.out}/groups")
        tables.write_ids(groups.select(F.explode("duplicate_ids").alias("message_id")), f"{a.out}/duplicate_ids")
        print(tables.one_row(dedup.summary(groups)))
    elif a.command == "enrich":
        items = extract.to_items(tables.read_jsonl(spark, a.extractions, EXTRACTION))
        print(tables.one_row(enrich.run(items, _keyed(spark, a.mails), digest(a.prompt), a.model, a.out).report))
    elif a.command == "reextract":
        out = extract.reextract_stale(_keyed(spark, a.mails), tables.read_jsonl(spark, tables.first_existing(spark, a.extractions.split(",")), EXTRACTION), digest(a.prompt), a.model, limit=a.limit, dry_run=a.dry_run)
        out.show(truncate=False) if a.dry_run else tables.write_jsonl(out, a.out)
    elif a.command == "review":
        found = select.page(spark.read.parquet(a.items), a.start, a.count, ("message_id", "field", "idx"))
        if a.mails:
            found = found.join(_keyed(spark, a.mails).select("message_id", "from_addr", "subject", "date", "body"), "message_id", "left")
        found.orderBy("message_id", "field", "idx").show(truncate=False)
    elif a.command == "extract":
        done = spark.read.parquet(a.done) if tables.exists(spark, a.done) else spark.createDataFrame([], "message_id string")
        found = cut(extract.run_batch(_keyed(spark, a.mails), done, limit=a.limit or None, pace_s=a.pace), "extracted")
        tables.write_jsonl(extract.results(found, digest(a.prompt), "rules"), a.out, append=True)
        versions.mark_done(found.where("status <> 'retry'").select("message_id"), a.done)
        print(tables.one_row(found.agg(F.count("*").alias("mails"), *(F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "retry")))))
    elif a.command == "versions":
        versions.report(tables.read_jsonl(spark, a.extractions, EXTRACTION)).show(truncate=False)
    elif a.command == "sample":
        tables.write_jsonl(select.sample(_mails(spark, a.mails).where("body <> ''"), a.n).drop("ord"), a.out)


if __name__ == "__main__":
    main()
