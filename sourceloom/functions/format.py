"""Values as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of months, units of relative times in seconds.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sept Oct Nov Dec".split()
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("week", 604_800), ("day", 86_400), ("hour", 3_600), ("minute", 60))
NEAR = {("year", -1): "last year", ("year", 1): "next year", ("month", -1): "last month", ("month", 1): "next month", ("week", -1): "last week", ("week", 1): "next week", ("day", -1): "yesterday", ("day", 1): "tomorrow", ("hour", 0): "this hour", ("minute", 0): "this minute"}


def plural(n: Column, word: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(word)).otherwise(F.lit(many or f"{word}s")))


def show_date(t: Column) -> Column:
    """24 Sept 2026"""
    return F.concat_ws(" ", F.day(t), F.get(F.array(*map(F.lit, MONTHS)), F.month(t) - 1), F.year(t))


def show_time(t: Column) -> Column:
    """24 Sept 2026, 10:00 UTC, in a session whose time zone is UTC"""
    return F.concat(show_date(t), F.lit(", "), F.date_format(t, "HH:mm"), F.lit(" UTC"))


def show_relative(t: Column, now: Column) -> Column:
    """3 hours ago, yesterday, in 2 days, just now: the largest unit that fits, halves rounded up."""
    seconds = (F.unix_millis(t) - F.unix_millis(now)) / 1000.0
    out = F.lit("just now")
    for unit, size in reversed(UNITS):
        n = F.floor(seconds / size + 0.5).cast("long")
        count = plural(F.abs(n), unit)
        text = F.when(n < 0, F.concat(count, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), count))
        for (u, k), named in NEAR.items():
            if u == unit:
                text = F.when(n == k, F.lit(named)).otherwise(text)
        out = F.when(F.abs(seconds) >= size, text).otherwise(out)
    return F.when(t.isNotNull(), out)


def show_duration(ms: Column) -> Column:
    """42s, 3m 05s"""
    s = F.greatest(F.floor(ms / 1000.0 + 0.5), F.lit(0)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
