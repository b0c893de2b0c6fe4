"""Strings, keys, dates and presentation buckets as column expressions."""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters with Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """All white space off both ends (SQL trim takes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def stripped_word(word: Column) -> Column:
    """As ``stripped``, sooner for a column of single words: visible ASCII alone has nothing to strip."""
    return F.when(word.rlike("^[!-~]+$"), word).otherwise(stripped(word))


def label_key(label: Column) -> Column:
    return F.lower(stripped(label))


def matches(column: Column, query: str) -> Column:
    """Case-insensitive containment; % and _ of the query stay wildcards, a backslash is itself."""
    return column.ilike("%" + query.replace("\\", "\\\\") + "%")


def before_after(text: Column, sign: str) -> tuple[Column, Column, Column]:
    """The part before the first sign, whether there is one, and the part after it."""
    at = F.instr(text, sign)
    before = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    after = F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))
    return before, at > 0, after


def record_key(document_id: Column, page_id: Column, page_number: Column, record_id: Column, fallback: Column) -> Column:
    """document:page id, else document:page number, else the record's id (unless empty), else its place."""
    page = F.coalesce(page_id, page_number)
    joined = F.when(document_id.isNotNull() & page.isNotNull(), F.concat_ws(":", document_id.cast("string"), page.cast("string")))
    return F.coalesce(joined, F.nullif(record_id.cast("string"), F.lit("")), fallback.cast("string"))


def dataset_identity(path: Column) -> tuple[Column, Column]:
    """`dir/page-7.png` is page 7 of `dir`; any other path is page 1 of itself without its suffix."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?<=[^/])\.[^./]+$", "")
    name = F.regexp_extract(clean, r"([^/]*)$", 1)
    parent = F.regexp_replace(F.regexp_extract(clean, r"^(.*)/[^/]*$", 1), "/+$", "")
    number = F.regexp_extract(name, r"(?i)^page-(\d+)$", 1)
    paged = (number != "") & (parent != "")
    return F.when(paged, parent).otherwise(clean), F.when(paged, number.try_cast("int")).otherwise(1)


def media_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def page_file(number: Column) -> Column:
    return F.format_string("page-%03d.png", number)


def export_file(document_id: Column, suffix: str) -> Column:
    return F.format_string(f"document-%d-validated-attributes.{suffix}", document_id)


def image_url(document_id: Column, page_number: Column) -> Column:
    return F.concat(F.lit("/documents/"), document_id.cast("string"), F.lit("/pages/"), page_number.cast("string"), F.lit("/image"))


def is_device_id(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{16,128}$")


def search_instant(value: str, end_of_day: bool = False) -> datetime:
    """A date or date and time of a search; a bare end date means the end of that day. ValueError for anything else."""
    parsed = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    bare = len(value.strip()) == 10
    return datetime.combine(parsed.date(), time.max) if bare and end_of_day else parsed


def unit_confidence(percent: Column) -> Column:
    """0..100 to 0..1, clamped."""
    return F.least(F.greatest(percent / 100.0, F.lit(0.0)), F.lit(1.0))


def percent_shown(score: Column) -> Column:
    """Scores over 1 are percentages already."""
    return F.when(score > 1, score).otherwise(score * 100.0)


def confidence_tone(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").when(score >= 0.5, "low").otherwise("very_low")


def border_tone(score: Column) -> Column:
    return F.when(score >= 0.9, "good").when(score >= 0.75, "fair").otherwise("poor")


def progress(status: Column) -> Column:
    """How far a status is, in percent."""
    known = F.upper(F.coalesce(status, F.lit("")))
    return F.when(known == "QUEUED", 35).when(known == "PROCESSING", 67).when(known.isin("PROCESSED", "FAILED"), 100).otherwise(20)


def date_shown(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MMM d, yyyy"), F.lit("Unknown date"))


def age_shown(value: Column, now: Column) -> Column:
    """How long ago, in rounded minutes (one at least), hours or days; each is rounded from the one before it."""
    minutes = F.greatest(F.lit(1), F.floor(F.timestamp_diff("MICROSECOND", value, now) / 60e6 + 0.5))
    hours = F.floor(minutes / 60 + 0.5)
    text = F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit(" hr ago")))
    return F.when(value.isNull(), "Just now").otherwise(text.otherwise(F.concat(F.floor(hours / 24 + 0.5).cast("string"), F.lit(" d ago"))))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def stable_id(*parts: Column) -> Column:
    """A deterministic id (a random one would change when a task runs again)."""
    return F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)
