"""Text, time and hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.split take as white space.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalised(c: Column | str) -> Column:
    """Null as empty, lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), SPACE, " "))


def blank(c: Column | str) -> Column:
    return F.length(stripped(F.coalesce(col(c), F.lit("")))) == 0


def or_text(c: Column | str, other: str) -> Column:
    """The stripped text, or other where that is empty or null."""
    return F.coalesce(F.nullif(stripped(col(c)), F.lit("")), F.lit(other))


def iso_utc(c: Column | str) -> Column:
    """ISO text of a time; microseconds only where there are any. Needs a UTC session."""
    micros = F.date_format(col(c), "SSSSSS")
    return F.concat(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def _sealed(*parts: Column) -> Column:
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\x1f"))]), 256)


def dedup_key(source: Column | str, url: Column | str, title: Column | str, published: Column | str) -> Column:
    """The identity of an item: the same story from another source or at another address is another item."""
    return _sealed(normalised(source), stripped(F.coalesce(col(url), F.lit(""))), normalised(title), F.coalesce(iso_utc(published), F.lit("")))


def content_hash(title: Column | str, summary: Column | str) -> Column:
    return _sealed(normalised(title), normalised(summary))


def embedding_text(title: Column | str, summary: Column | str) -> Column:
    return stripped(F.concat(stripped(F.coalesce(col(title), F.lit(""))), F.lit("\n"), stripped(F.coalesce(col(summary), F.lit("")))))


def parsed_time(c: Column | str) -> Column:
    """ISO text with or without Z; null where it is none."""
    return F.try_to_timestamp(F.nullif(stripped(col(c)), F.lit("")))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def entity_label(kind: Column | str, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, F.lower(stripped(F.coalesce(col(kind), F.lit("")))))


def has_any(c: Column | str, words: tuple[str, ...]) -> Column:
    """Whether any word stands anywhere in the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def period_label(start: Column | str, end: Column | str) -> Column:
    day = lambda c: F.coalesce(F.date_format(col(c), "yyyy-MM-dd"), F.lit("?"))
    return F.when(col(start).isNull() & col(end).isNull(), "the current corpus").otherwise(F.concat(day(start), F.lit(" → "), day(end)))
