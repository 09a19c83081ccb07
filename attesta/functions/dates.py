"""Dates in free text, instants and wall clocks as column expressions.

Texts that hold no valid date give null. The day/month order of ambiguous numeric dates is a parameter
("dmy", "mdy" or "none"), never a global.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import clean_folder, filled, squeeze, strip_ext
from attesta.functions.vocab import MONTH_PATTERN, MONTHS

ORDERS = ("dmy", "mdy", "none")
# What is read as a date is defined by exactly these patterns.
_DAY, _YEAR, _SEP = r"(0?[1-9]|[12]\d|3[01])", r"(20\d{2})", "[-._/]"
_ANY_YEAR = r"(?:19|20)\d{2}"
_LOOKS = "|".join(
    (
        rf"{_ANY_YEAR}[-._/ ](?:0?[1-9]|1[0-2])[-._/ ](?:0?[1-9]|[12]\d|3[01])",
        rf"(?:0?[1-9]|[12]\d|3[01])[-._/ ](?:0?[1-9]|1[0-2])[-._/ ]{_ANY_YEAR}",
        rf"{_ANY_YEAR}\s+(?:{MONTH_PATTERN})\s+\d{{1,2}}",
        rf"(?:{MONTH_PATTERN})\.?\s+\d{{1,2}},?\s+{_ANY_YEAR}",
        rf"\d{{1,2}}\s+(?:{MONTH_PATTERN})\.?\s+{_ANY_YEAR}",
    )
)
#: Searches inside a text: pattern, then the groups of year, month and day.
_ISO = (rf"(?<!\d){_YEAR}{_SEP}(0[1-9]|1[0-2]){_SEP}{_DAY}(?!\d)", 1, 2, 3)
_SPELLED = (
    (rf"(?iU)(?<!\d){_YEAR}\s+({MONTH_PATTERN})\.?\s+{_DAY}(?!\d)", 1, 2, 3),
    (rf"(?iU)\b({MONTH_PATTERN})\.?\s+{_DAY},?\s+{_YEAR}\b", 3, 1, 2),
    (rf"(?iU)(?<!\d){_DAY}\s+({MONTH_PATTERN})\.?\s+{_YEAR}\b", 3, 2, 1),
)
_NUMERIC = rf"(?<!\d)(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}{_YEAR}(?!\d)"
# End of fixed values.


def looks_like_date(text: Column) -> Column:
    """Whether a whole text is a date of the 20th or 21st century."""
    return squeeze(filled(text)).rlike(rf"(?iU)^(?:{_LOOKS})$")


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD of three digit strings, null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def numeric_date(first: Column, second: Column, year: Column, order: str = "dmy") -> Column:
    """A date of two numbers and a year: a number above 12 is the day; else ``order`` decides."""
    if order not in ORDERS:
        raise ValueError(f"date order must be one of {ORDERS}, got {order!r}")
    a, b = first.try_cast("int"), second.try_cast("int")
    day_first, month_first = iso_date(year, second, first), iso_date(year, first, second)
    tied = {"dmy": day_first, "mdy": month_first, "none": F.lit(None).cast("string")}[order]
    return F.when((a > 12) & (b > 12), None).when(a > 12, day_first).when(b > 12, month_first).otherwise(tied)


def _month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("string"))


def _groups(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, g) for g in groups]


def parse_date(text: Column, order: str = "dmy") -> Column:
    """The first valid date of a text: as a whole, ISO inside, spelled month, then each numeric one in turn."""
    text = filled(text)
    whole = squeeze(text)
    y, m, d = _groups(whole, rf"^{_YEAR}[-._/ ](0?[1-9]|1[0-2])[-._/ ]{_DAY}$", 1, 2, 3)
    a, b, c = _groups(whole, rf"^(\d{{1,2}})[-._/ ](\d{{1,2}})[-._/ ]{_YEAR}$", 1, 2, 3)
    steps = [iso_date(y, m, d), F.when(c != "", numeric_date(a, b, c, order)), iso_date(*_groups(text, *_ISO))]
    for pattern, *at in _SPELLED:
        y, m, d = _groups(text, pattern, *at)
        steps.append(iso_date(y, _month_number(m), d))
    found = F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(0))
    dates = F.transform(found, lambda x: numeric_date(*_groups(x, _NUMERIC, 1, 2, 3), order))
    steps.append(F.try_element_at(F.filter(dates, lambda x: x.isNotNull()), F.lit(1)))
    return F.coalesce(*steps)


def date_prefix(text: Column) -> Column:
    """struct(head, title) of a text of the form ``DATE - Title``, else null."""
    plain = squeeze(F.regexp_replace(filled(text), r"[+_]+", " "))
    at = F.instr(plain, " - ")
    head, tail = F.trim(F.substring(plain, F.lit(1), at - 1)), F.trim(F.substring(plain, at + 3, F.length(plain)))
    return F.when((at > 0) & looks_like_date(head), F.struct(head.alias("head"), tail.alias("title")))


def date_prefix_title(text: Column) -> Column:
    return date_prefix(text)["title"]


def date_prefix_date(text: Column, order: str = "dmy") -> Column:
    head = date_prefix(text)["head"]
    return F.when(head.isNotNull(), parse_date(head, order))


def has_date_prefix(name: Column, folder: Column) -> Column:
    return date_prefix(clean_folder(folder)).isNotNull() | date_prefix(strip_ext(name)).isNotNull()


def unparsed_date_prefix(name: Column, folder: Column, order: str = "dmy") -> Column:
    """A prefix that looks like a date but names no day: the folder's, else the file's."""

    def lost(text: Column) -> Column:
        head = date_prefix(text)["head"]
        return F.when(head.isNotNull() & parse_date(head, order).isNull(), head)

    return F.coalesce(lost(clean_folder(folder)), lost(strip_ext(name)))


_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2}(?::\d{2})?)$"


def as_utc(text: Column) -> Column:
    """Instant of an ISO text with an offset; null for one without, or malformed."""
    return F.when(text.rlike(rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}.*{_OFFSET}"), text.try_cast("timestamp"))


def local(text: Column, zone: str) -> Column:
    """An ISO instant in a zone's wall clock; other texts unchanged."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(as_utc(text), zone), "yyyy-MM-dd'T'HH:mm:ss"), text)


def local_minute(text: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(as_utc(text), zone), "yyyy-MM-dd HH:mm"), text)


def local_times(zone: str):
    """Arrow function: every ISO instant inside a text, rewritten to a zone's minute (a callback per match)."""
    pattern = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})")

    def rewrite(found: re.Match) -> str:
        try:
            return datetime.fromisoformat(found[0]).astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M")
        except ValueError:
            return found[0]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else pattern.sub(rewrite, x))

    return run


def occurrence(day: Column, at: str, zone: Column | str) -> Column:
    """UTC instant of a wall-clock time on a day: the first reading of a repeated hour, pushed past a missing one."""
    wall = F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), F.lit(at)), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.to_utc_timestamp(wall.cast("timestamp"), zone)


def utc_now() -> datetime:
    return datetime.now(UTC)
