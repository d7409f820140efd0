import json
from pathlib import Path

from pyspark.sql import functions as F

from claimlake.functions.schemas import EXTRACTION
from claimlake.operators import extract, noise, scoring
from claimlake.plans import enrich
from claimlake.sources import mail, tables

RAW = "Message-ID: <1@x>\nFrom: a@x\nTo: b@x, c@x\nSubject: Hi\nDate: Mon, 14 May 2001 16:39:00 -0700 (PDT)\nX-From:  Ann \n\nBody text\n"


def test_mail_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "1.").write_text(RAW)
    (tmp_path / "in" / "deep" / "2").write_text("Subject: only\n\n")
    (tmp_path / "in" / "3").write_bytes(b"Message-ID: <3@x>\nContent-Type: text/plain; charset=nonsense\n\n\xff")
    records = mail.parse(mail.files(spark, str(tmp_path / "in"))).cache()
    got = {r["message_id"]: r for r in mail.parsed(records).collect()}
    assert got["<1@x>"]["to_addrs"] == ["b@x", "c@x"] and got["<1@x>"]["date"] == "2001-05-14T16:39:00-07:00" and got["<1@x>"]["body"] == "Body text"
    assert got[""]["from_addr"] == "" and got[""]["in_reply_to"] is None
    assert mail.parsed(records).count() + mail.failures(records).count() == 3
    assert mail.peek(spark, str(tmp_path / "in"))[0] == 3
    assert mail.iso_date("Tue, 31 Dec 1979 23:59:00 -0000") is None and mail.iso_date("x") is None


def test_mailboxes(spark, tmp_path):
    bodies = ["plain", "From here\n>From there\n>>From\n\nFrom x\n", "", "\n\nFrom a\rFrom b\n\n\n", "é😀\r\nFrom c\n>", "> From"] + [f"From {k}\n" * (k % 40) + "\n" * (k % 3) for k in range(300)]
    raw = [f"Message-ID: <{k}@x>\nFrom: a@x\nTo: b@x\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n{b}" for k, b in enumerate(bodies)]
    mail.write_mailboxes(spark.createDataFrame([(r,) for r in raw], "value string").coalesce(2), str(tmp_path / "in" / "deep"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "777"):  # parted anywhere
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            records = mail.parse(mail.mailboxes(spark, str(tmp_path / "in")), quoted=True).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        want = sorted((m["message_id"], m["body"]) for m in (mail.decode(r.encode()) for r in raw))
        assert sorted((r["message_id"], r["body"]) for r in records) == want and not any(r["error"] for r in records)
        assert len({r["path"] for r in records}) == len(raw)


def test_ingest_files_do_not_grow(spark, sf_dir):
    """Files follow partitions: one a mail made 5012 at sf0.1."""
    from claimlake.plans import queries
    from claimlake.scratch import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    count = lambda: sum(1 for _ in folder.rglob("part-*"))
    before = count()
    mails = queries.QUERIES["ingest_eml"](spark, sf_dir).count()
    assert 0 < count() - before < min(mails, 50)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "message_id string, ord int")
    tables.write_jsonl(df, path)
    assert tables.read_keyed(spark, path, "message_id string, ord int", "message_id", ("ord",)).count() == 2
    assert tables.first_existing(spark, [path + "-none", path]) == path
    tables.write_ids(df, str(tmp_path / "ids"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["a", "b"]
    assert json.loads(tables.one_row(df.agg(F.count("*").alias("n")))) == {"n": 3}


def test_extract_retries(spark):
    def model(prompt):
        if "bad" in prompt:
            return "{nope"
        if "busy" in prompt:
            raise RuntimeError("HTTP 429")
        if "dead" in prompt:
            raise RuntimeError("no key")
        return '{"people": [{"name": "Ann\nLee"}], "message_id": "lie"}'

    rows = [("1", "fine"), ("2", "bad"), ("3", "busy"), ("4", "dead"), ("5", "done before")]
    mails = spark.createDataFrame([(i, "a", ["b"], "", b, k) for k, (i, b) in enumerate(rows)], "message_id string, from_addr string, to_addrs array<string>, subject string, body string, ord int")
    done = spark.createDataFrame([("5",)], "message_id string")
    found = extract.run_batch(mails, done, model, sleep=lambda s: None)
    got = {r["message_id"]: r["status"] for r in found.collect()}
    assert got == {"1": "done", "2": "failed", "3": "retry", "4": "failed"}
    records = extract.results(found, "v1", "m")
    assert records.first()["message_id"] == "1" and records.columns == spark.createDataFrame([], EXTRACTION).columns
    items = extract.to_items(records).collect()
    assert [(r["field"], r["name"]) for r in items] == [("people", "Ann\nLee")]
    assert extract.run_batch(mails, done, model, limit=1, sleep=lambda s: None).count() == 1


def test_enrichment_end_to_end(spark, tmp_path):
    mails = spark.createDataFrame([("1", "Ann reports directly to Bob since the spring of last year.\n-- \nme")], "message_id string, body string")
    schema = "message_id string, field string, idx int, name string, email string, description string, made_by string, person_a string, person_b string, relationship_type string, evidence string, source string, target string, has_endpoint_keys boolean"
    rel = lambda m, k, a, b, q: (m, "relationships", k, None, None, None, None, a, b, "reports_to", q, None, None, False)
    items = spark.createDataFrame([rel("1", 0, "Ann", "Bob", "Ann reports directly to Bob since the spring"), rel("1", 1, "Ann", " ann", "Ann reports directly to Bob since the spring"), rel("2", 0, "Ann", "Bob", "a quote that nobody can look up in any mail")], schema)
    out = enrich.run(items, mails, "v1", "m", str(tmp_path))
    got = {(r["message_id"], r["idx"]): (r["status"], r["evidence_verified"], r["confidence"]) for r in out.items.collect()}
    assert got == {("1", 0): ("approved", True, 1.0), ("1", 1): ("rejected", True, 1.0), ("2", 0): ("approved", None, 1.0)}
    assert out.report.first()["items"] == 3
    assert enrich.enrich(items, mails, how="inner").count() == 2
    assert scoring.review_queue(out.items).count() == 0
    assert noise.region_stats(mails).first()["region_type"] == "signature"


def test_reextract(spark):
    mails = spark.createDataFrame([(i, "a", ["b"], "", "Ann Lee met Bob Ray", k) for k, i in enumerate("abc")], "message_id string, from_addr string, to_addrs array<string>, subject string, body string, ord int")
    old = spark.createDataFrame([(i, v, "m", [], [], [], [], []) for i, v in (("a", "old"), ("b", "new"), ("c", None))], EXTRACTION)
    assert {r[0] for r in extract.reextract_stale(mails, old, "new", "m2", dry_run=True).collect()} == {"a", "c"}
    got = {r["message_id"]: (r["prompt_version"], r["model_name"]) for r in extract.reextract_stale(mails, old, "new", "m2", limit=1).collect()}
    assert got == {"a": ("new", "m2"), "b": ("new", "m"), "c": (None, "m")}


def test_commands(spark, tmp_path):
    from claimlake.__main__ import main
    from claimlake.operators import dedup, graph

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / str(k)).write_text(RAW.replace("<1@x>", f"<{k}@x>"))
    out = str(tmp_path / "out")
    main(["ingest", str(tmp_path / "in"), out])
    main(["threads", f"{out}/mails", f"{out}/t"])
    main(["dedup", f"{out}/mails", f"{out}/d", "--exact-only"])
    assert [r[0] for r in spark.read.text(f"{out}/d/duplicate_ids").collect()] == ["<1@x>", "<2@x>"]
    mails = spark.read.json(f"{out}/mails")
    assert mails.count() == 3
    v = dedup.embed(mails, lambda texts: [[1.0, 0.0] for _ in texts])
    assert v.count() == 3 and dedup.near_pairs(v).count() == 3
    assert len(graph.statements()) == 20

    def refuse(s):
        raise RuntimeError("no")

    assert all(e == "no" for _, e in graph.issue(refuse))
    # a mail that comes twice counts once, with what its last file says
    (tmp_path / "in" / "9").write_text(RAW.replace("<1@x>", "<0@x>").replace("Body", "Later"))
    main(["ingest", str(tmp_path / "in"), out])
    from claimlake.functions.schemas import EMAIL

    assert {r["message_id"]: r["body"] for r in tables.read_keyed(spark, f"{out}/mails", EMAIL, "message_id").collect()} == {"<0@x>": "Later text", "<1@x>": "Body text", "<2@x>": "Body text"}
    ordered = [r["message_id"] for r in tables.read_ordered(spark, f"{out}/mails", EMAIL).orderBy("ord").collect()]
    assert ordered == ["<0@x>", "<1@x>", "<2@x>", "<0@x>"]
    for _ in range(2):  # two a day
        main(["extract", f"{out}/mails", f"{out}/done", f"{out}/extractions", "--limit", "2"])
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/done").collect()) == ["<0@x>", "<1@x>", "<2@x>"]
    assert spark.read.schema(EXTRACTION).json(f"{out}/extractions").count() == 3
