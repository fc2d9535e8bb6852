"""Normalising expressions over columns; all stay in the JVM."""

from __future__ import annotations

import os
import zoneinfo
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def clamp(c: Column) -> Column:
    """Counts are never negative; null counts as 0."""
    return F.greatest(F.coalesce(c, F.lit(0)).cast("long"), F.lit(0).cast("long"))


def split_overlap(total: Column, part: Column) -> Column:
    """The part of a total that lies outside another count."""
    return F.greatest(total - part, F.lit(0))


def model_name(c: Column) -> Column:
    """A model name without vendor prefix, family prefix and trailing date."""
    c = F.regexp_replace(c, r"^anthropic\.", "")
    return F.regexp_replace(F.regexp_replace(c, "^claude-", ""), "-[0-9]{8}$", "")


def endpoint(geo: Column) -> Column:
    """native, proxy or unknown from the inference location of a record."""
    return F.when(geo == "not_available", "native").when(geo == "", "proxy").otherwise("unknown")


def endpoint_order(name: Column) -> Column:
    """Canonical order of endpoints."""
    return F.when(name == "native", 0).when(name == "proxy", 1).otherwise(2)


def project_name(path: Column) -> Column:
    """Last component of a path; names without separators lose leading dashes."""
    bare = F.regexp_replace(path, r"[/\\]+$", "")
    return F.when(path.rlike(r"[/\\]"), F.regexp_extract(bare, r"([^/\\]*)$", 1)).otherwise(F.regexp_replace(path, "^-+", ""))


def percent_decoded(c: Column) -> Column:
    """One URL-encoded path component; a plus sign stays, what cannot be decoded stays whole."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def work_dir_slug(c: Column) -> Column:
    """Slug of names like wd_<slug>_<12 hex digits>, else null."""
    return F.nullif(F.regexp_extract(c, "^wd_(.+)_([0-9a-fA-F]{12})$", 1), F.lit(""))


def zone_name(text: str | None) -> str:
    """A time zone by name: none, blank and local are this machine's, z is UTC; anything else must be in the zone database."""
    name = (text or "").strip()
    if name.lower() in ("", "local"):
        path = os.path.realpath("/etc/localtime")
        name = os.environ.get("TZ") or (path.split("zoneinfo/")[-1] if "zoneinfo/" in path else "UTC")
    elif name.lower() in ("utc", "z"):
        name = "UTC"
    try:
        return zoneinfo.ZoneInfo(name).key
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        raise ValueError(f"no time zone {name!r}") from None


def local_date(ts_ms: Column, zone: str) -> Column:
    """Calendar date in a zone of an instant in milliseconds."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone))


def local_midnight_ms(day: Column, zone: str) -> Column:
    """First instant of a calendar date in a zone."""
    return F.unix_millis(F.to_utc_timestamp(day.cast("timestamp"), zone))


def instant_ms(text: Column) -> Column:
    """Milliseconds of an RFC 3339 timestamp, null if it is none."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.unix_millis(F.try_to_timestamp(F.regexp_replace(F.upper(text), " ", "T"))))


def day_literal(c: Column) -> Column:
    """YYYYMMDD or YYYY-MM-DD."""
    return F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd"), F.try_to_date(F.when(c.rlike(r"^\d{8}$"), c), "yyyyMMdd"))


def average_input(total: Column, calls: Column) -> Column:
    """Whole tokens for a call, 0 without calls."""
    return F.when(calls <= 0, F.lit(0)).otherwise(F.floor(total / calls)).cast("long")


def short_id(c: Column, width: int = 12) -> Column:
    """At most width characters, longer ids end in dots."""
    return F.when(F.char_length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def dotted_version(c: Column) -> Column:
    """Versions spelled with p for point: 5p2 becomes 5.2."""
    return F.regexp_replace(c, r"(?<=\d)p(?=\d)", ".")


#: Thousands and decimal marks by language.
MARKS = {"en": (",", "."), "zh": (",", "."), "de": (".", ","), "fr": (" ", ","), "ru": (" ", ",")}


def grouped(c: Column, language: str = "en") -> Column:
    """A whole number with grouped digits."""
    return F.regexp_replace(F.format_number(c, 0), ",", MARKS.get(language, MARKS["en"])[0])


def compact(c: Column) -> Column:
    """1234 as 1.2K, with M and B above."""
    out = F.format_string("%d", c.cast("long"))
    for limit, mark in ((1e3, "K"), (1e6, "M"), (1e9, "B")):
        out = F.when(F.abs(c) >= limit, F.format_string(f"%.1f{mark}", c / limit)).otherwise(out)
    return out


def money(c: Column, symbol: str = "$") -> Column:
    """Two decimals, N/A if unknown."""
    return F.when(c.isNull(), "N/A").otherwise(F.concat(F.lit(symbol), F.format_string("%.2f", c)))


def percent(c: Column) -> Column:
    """One decimal, N/A if unknown."""
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.1f%%", c))


def csv_field(c: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end."""
    text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def did_you_mean(text: str, choices: Iterable[str]) -> str | None:
    """The first choice that text begins or that begins it, else the nearest within two edits."""
    text, choices = text.lower(), list(choices)
    for c in choices:
        if text and (c.startswith(text) or text.startswith(c)):
            return c

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = min(((edits(text, c), i, c) for i, c in enumerate(choices)), default=(9, 0, None))
    return near[2] if near[0] <= 2 else None
