"""Time offsets in microseconds: renderings and their parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000

#: ``[N day[s], ]H:MM:SS[.ffffff]``, ``HH:MM:SS`` and ``HH:MM:SS,mmm``; hours are unbounded.
OFFSET_PATTERN = r"^\s*(?:(-?\d+) days?, )?(\d+):([0-5]\d):([0-5]\d)(?:[.,](\d{1,6}))?\s*$"


def parse_offset(text: Column) -> Column:
    """Microseconds of a rendered offset; null for null, ``None`` or any other text. The pattern is matched once."""
    number = lambda c: c.try_cast("bigint")

    def value(p: Column) -> Column:
        days = F.when(p[0] == "", F.lit(0).cast("bigint")).otherwise(number(p[0]))
        seconds = days * 86_400 + number(p[1]) * 3_600 + number(p[2]) * 60 + number(p[3])
        return F.when(F.size(p) == 5, seconds * 1_000_000 + F.coalesce(number(F.rpad(p[4], 6, "0")), F.lit(0)))

    parts = F.split(F.regexp_replace(text, OFFSET_PATTERN, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", -1)
    return F.transform(F.array(parts), value)[0]


def hms(us: Column) -> Column:
    """``HH:MM:SS``, the fraction cut off; null stays null."""
    s = F.floor(us / F.lit(1_000_000)).cast("bigint")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(us.isNotNull(), text)


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` of seconds, milliseconds cut off."""
    ms = F.floor(seconds.cast("double") * 1000 + F.lit(1e-6)).cast("bigint")
    text = F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000), ms % 1000
    )
    return F.when(seconds.isNotNull(), text)


def clock(us: Column) -> Column:
    """``[N day[s], ]H:MM:SS[.ffffff]``, as Python prints a duration; null stays null."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("bigint")
    rest = us - day * 86_400_000_000
    s = F.floor(rest / F.lit(1_000_000)).cast("bigint")
    fraction = rest - s * 1_000_000
    head = F.when(day == 0, "").otherwise(F.format_string("%d day%s, ", day, F.when(F.abs(day) == 1, "").otherwise("s")))
    body = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    tail = F.when(fraction == 0, "").otherwise(F.format_string(".%06d", fraction))
    return F.when(us.isNotNull(), F.concat(head, body, tail))
