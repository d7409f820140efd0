"""Text rules as Column expressions. Blank space means what Python's str.isspace means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \s is ASCII only; this class equals str.isspace().
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def trim_spaces(c: Column) -> Column:
    """What DuckDB's trim(x) does: space characters (Zs) go, line ends and tabs stay."""
    # $ would also match before a last line end
    return F.regexp_replace(c, r"\A\p{Zs}+|\p{Zs}+\z", "")


def collapse(c: Column) -> Column:
    """Runs of blank space become one blank; the ends stay."""
    return F.regexp_replace(c, f"{WS}+", " ")


def squeeze(c: Column) -> Column:
    """collapse() and strip()."""
    return F.btrim(collapse(c))


def hash_form(c: Column) -> Column:
    """What exact duplicates share: words joined by one blank, lower case."""
    return F.lower(squeeze(F.coalesce(c, F.lit(""))))


def subject_form(c: Column) -> Column:
    """A subject without its leading reply and forward marks; null gives ''.

    Blank space before the first mark keeps it: marks are looked for before stripping.
    """
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), f"(?i)^(?:(?:re|fw|fwd){WS}*:{WS}*)+", "")
    return F.lower(strip(bare))


def offset_map(body: Column) -> Column:
    """For each character of the text with blanks collapsed, its place in the original.

    Here only blank, tab, LF and CR collapse, unlike collapse(): other space characters make
    the two drift apart, as evidence offsets are defined to.
    """
    blanks = [" ", "\t", "\n", "\r"]
    return F.element_at(
        F.transform(
            F.array(F.split(body, "")),
            lambda ch: F.filter(F.transform(ch, lambda c, i: F.when(c.isin(blanks) & F.coalesce(F.get(ch, i - 1).isin(blanks), F.lit(False)), F.lit(None)).otherwise(i)), lambda x: x.isNotNull()),
        ),
        1,
    )


def prompt_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def short_digest(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by '::'; null counts as ''."""
    return F.substring(F.sha2(F.concat_ws("::", *(F.coalesce(p, F.lit("")) for p in parts)), 256), 1, 16)


def slug(c: Column) -> Column:
    return F.replace(strip(F.lower(c)), F.lit(" "), F.lit("-"))


def person_key(name: Column) -> Column:
    return F.concat(F.lit("person:"), slug(name))


def org_key(name: Column) -> Column:
    return F.concat(F.lit("org:"), slug(name))


def deal_key(name: Column) -> Column:
    """Cut to 60 characters before blanks become dashes."""
    return F.concat(F.lit("deal:"), F.replace(F.substring(strip(F.lower(name)), 1, 60), F.lit(" "), F.lit("-")))


def decision_key(message_id: Column, description: Column) -> Column:
    return F.concat(F.lit("decision:"), short_digest(message_id, description))


def claim_key(message_id: Column, kind: Column, subject_key: Column, object_key: Column, quote: Column) -> Column:
    return F.concat(F.lit("claim:"), short_digest(message_id, kind, subject_key, object_key, quote))


def evidence_key(message_id: Column, quote: Column) -> Column:
    return F.concat(F.lit("evidence:"), short_digest(message_id, quote))


def group_reason(digest: Column) -> Column:
    return F.concat(F.lit("Identical normalized body (SHA-256: "), F.substring(digest, 1, 12), F.lit("…)"))


def estimate(length: Column) -> Column:
    """Tokens of a text of so many characters."""
    return F.floor(length / 4).cast("long")


def token_estimate(c: Column) -> Column:
    return estimate(F.length(c))


def address_list(c: Column) -> Column:
    """Comma-separated addresses, stripped, without empty ones; null gives []."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def reference_list(c: Column) -> Column:
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def safe_file_name(message_id: Column) -> Column:
    return F.substring(F.translate(message_id, "/<>", "_"), 1, 100)


def mail_date(c: Column) -> Column:
    """An RFC-2822 date as a timestamp; null if it can't be read or its own year isn't 1995 to 2005."""
    s = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"^[A-Za-z]{3},\s*|\s*\([^()]*\)$", "")
    year = F.regexp_extract(s, r"^\d{1,2} [A-Za-z]{3} (\d{4}) ", 1).try_cast("int")
    return F.when(year.between(1995, 2005), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")))


def prompt(from_addr: Column, to_addrs: Column, subject: Column, body: Column) -> Column:
    """The mail as an extraction model is shown it."""
    to = F.when(F.size(to_addrs) > 0, F.array_join(to_addrs, ", ")).otherwise(F.lit("(none listed)"))
    about = F.coalesce(F.nullif(subject, F.lit("")), F.lit("(no subject)"))
    return F.concat(F.lit("From: "), from_addr, F.lit("\nTo: "), to, F.lit("\nSubject: "), about, F.lit("\n\n"), body)
