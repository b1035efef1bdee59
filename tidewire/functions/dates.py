"""Dates as strings and instants; `as_of` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import nz

#: Days of each unit of a relative age.
UNIT_DAYS = {"s": 1 / 86400, "sec": 1 / 86400, "m": 1 / 1440, "min": 1 / 1440, "mins": 1 / 1440, "h": 1 / 24, "hr": 1 / 24, "d": 1.0, "w": 7.0, "mo": 30.0, "y": 365.0}


def relative_age_days(text: Column) -> Column:
    """`3d` or `1 w` as days; null if the unit is unknown."""
    units = F.create_map(*[F.lit(x) for pair in UNIT_DAYS.items() for x in pair])
    parts = F.lower(F.trim(text))
    n, unit = F.regexp_extract(parts, r"^(\d+)\s*([a-z]+)", 1), F.regexp_extract(parts, r"^(\d+)\s*([a-z]+)", 2)
    return n.try_cast("double") * F.try_element_at(units, unit)


def estimated_date(as_of: Column, age_days: Column) -> Column:
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(as_of) - age_days * 86400))


def sort_ts(published: Column, collected: Column) -> Column:
    return F.coalesce(nz(published), collected)


def sort_key(published: Column, collected: Column, article_hash: Column) -> Column:
    """The order of every feed, descending; ties by the hash, descending too."""
    return F.concat(sort_ts(published, collected), F.lit("#"), article_hash)


def has_offset(c: Column) -> Column:
    return c.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")


def parse_instant(c: Column) -> Column:
    """Any of the stored shapes; without an offset UTC holds (with the session's time zone UTC); null on junk."""
    return F.try_to_timestamp(c)


def cutoff_days(mode: str, backfill_days: int, hours_back: float | None, days_back: float) -> float:
    """Days to look back: a backfill's own; else hours if given; else days."""
    return backfill_days if mode == "backfill" else hours_back / 24 if hours_back is not None else days_back


def after_cutoff(published: Column, cutoff: Column, strict: bool = False) -> Column:
    """Rows since the cutoff. Dates without an offset, unreadable or empty are kept unless strict."""
    old = F.coalesce(parse_instant(published) < cutoff, F.lit(strict))
    return ~old if strict else ~(F.coalesce(has_offset(published), F.lit(False)) & old)


def window_since(as_of: Column, hours: float) -> Column:
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(as_of) - hours * 3600), "yyyy-MM-dd'T'HH:mm:ss")


def relative_display(published: Column, as_of: Column) -> Column:
    """just now, Nh ago, Nd ago, then the day; unreadable values as they are."""
    then = parse_instant(published)
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(then)) / 3600
    whole = F.floor(hours + 0.5)
    days = F.floor(whole / 24 + 0.5)
    return (
        F.when(then.isNull(), published)
        .when(whole < 1, "just now")
        .when(whole < 24, F.concat(whole.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(then, "d MMM yyyy"))
    )


def same_day(published: Column, as_of: Column) -> Column:
    return F.coalesce(F.to_date(parse_instant(published)) == F.to_date(as_of), F.lit(False))
