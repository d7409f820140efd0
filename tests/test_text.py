from pyspark.sql import functions as F

from claimlake.functions import text as X


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_blank_space_is_pythons(spark):
    s = "\x1c  a  b\x85\t"
    assert one(spark, X.strip, s) == s.strip()
    assert one(spark, X.squeeze, s) == " ".join(s.split())
    assert one(spark, X.collapse, " a \n\n b ") == " a b "
    assert one(spark, X.hash_form, "  The  BIG\n deal ") == "the big deal"
    assert one(spark, X.hash_form, None) == ""


def test_subjects(spark):
    cases = {"Re: Fw: Re: Trading desk update": "trading desk update", "RE: RE: Hello": "hello", "Fwd:Re:x": "x", " Re: kept": "re: kept", "Re[2]: x": "re[2]: x", "": "", None: ""}
    for given, wanted in cases.items():
        assert one(spark, X.subject_form, given) == wanted


def test_offset_map(spark):
    for given, wanted in {"a  \n  b": [0, 1, 6], "  a": [0, 2], "a  ": [0, 1], "": [], "😀  x": [0, 1, 3]}.items():
        assert one(spark, X.offset_map, given) == wanted or (given == "" and one(spark, X.offset_map, given) in ([], [0]))


def test_keys(spark):
    assert one(spark, X.org_key, " Some Corp ") == "org:some-corp"
    assert len(one(spark, X.deal_key, "x" * 70)) == len("deal:") + 60
    assert len(one(spark, X.prompt_hash, "p")) == 12
    assert one(spark, X.prompt_hash, "p") != one(spark, X.prompt_hash, "p ")
    assert one(spark, X.safe_file_name, "<a/b@c>") == "a_b@c"


def test_dates(spark):
    found = lambda s: one(spark, X.mail_date, s)
    assert str(found("Mon, 14 May 2001 16:39:00 -0700 (PDT)")) == "2001-05-14 23:39:00"
    assert found("Tue, 31 Dec 1979 23:59:00 -0000") is None
    assert found("not a real date") is None
    assert found("Sat, 31 Dec 2005 23:59:00 -0800") is not None  # 2005 by its own clock, 2006 in UTC
    assert found("Sun, 1 Jan 2006 00:30:00 +0800") is None


def test_lists(spark):
    assert one(spark, X.address_list, " a@x , ,b@y") == ["a@x", "b@y"]
    assert one(spark, X.address_list, None) == []
    assert one(spark, X.reference_list, " <a>\n <b> ") == ["<a>", "<b>"]
    assert one(spark, X.reference_list, None) == []
