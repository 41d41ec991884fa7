"""Times and URLs as column expressions; everything here stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below the first, an epoch value is in seconds; from the second on, in microseconds (fixed values: both lie centuries away from the data).
SECONDS_BELOW, MICROS_FROM = 100_000_000_000, 100_000_000_000_000

#: scheme, then authority without user info; port kept (fixed pattern).
URL_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:[^/?#]*@)?([^/?#]*)"


def spare(df, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has or starts with."""
    tag = "_"
    while any(c.startswith(tag) for c in df.columns):
        tag += "_"
    return [tag + n for n in names]


def epoch_ms(c: Column | str) -> Column:
    """Epoch seconds, milliseconds or microseconds as milliseconds (rounded down); null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < SECONDS_BELOW, c * 1000).when(c >= MICROS_FROM, (c - F.pmod(c, F.lit(1000))).cast("bigint") / 1000).otherwise(c).cast("bigint")


def text(c: Column | str) -> Column:
    """The empty string as null."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def url_host(c: Column | str) -> Column:
    """Lower-case host with port, without user info; null if there is no ``scheme://``, empty if the authority is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(URL_PARTS), F.lower(F.regexp_extract(c, URL_PARTS, 2)))


def utc_day(ms: Column | str) -> Column:
    """The UTC day of epoch milliseconds as ``YYYY-MM-DD``, whatever the session's time zone."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int")).cast("string")
