"""Dates and times of scenes and jobs as column expressions. The session time zone is taken to be UTC."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layouts that each kind of record may use, tried in order.
CATALOG_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss")
RESULT_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
QUEUE_LAYOUTS = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm")
LISTING_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
DISPLAY_LAYOUTS = (("yyyy-MM-dd", "dd.MM.yyyy"), ("yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm"), ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss"))
SEASONS = {"spring": ((3, 1), (5, 31)), "summer": ((6, 1), (8, 31)), "autumn": ((9, 1), (11, 30)), "winter": ((12, 1), (2, 28))}
LOOK_BACK_DAYS = 15
DAY = 86_400_000_000


def parse_time_multi(text: Column, layouts: tuple[str, ...], date_prefix: bool = False) -> Column:
    """The timestamp by the first layout that fits, else null; with date_prefix the first ten characters may be a date."""
    trimmed = F.trim(text)
    tries = [F.try_to_timestamp(trimmed, F.lit(x)) for x in layouts]
    if date_prefix:
        tries.append(F.when(F.length(trimmed) >= 10, F.try_to_timestamp(F.left(trimmed, F.lit(10)), F.lit("yyyy-MM-dd"))))
    return F.coalesce(*tries)


def captured_at(text: Column) -> Column:
    return parse_time_multi(text, CATALOG_LAYOUTS, date_prefix=True)


def season_dates(season: Column, year: Column) -> tuple[Column, Column]:
    """First and last day of a season; winter ends on 28 February of the next year, in leap years too."""
    start = end = F.lit(None).cast("date")
    for name, (a, b) in SEASONS.items():
        later = year + 1 if b < a else year
        start = F.when(season == name, F.make_date(year, F.lit(a[0]), F.lit(a[1]))).otherwise(start)
        end = F.when(season == name, F.make_date(later, F.lit(b[0]), F.lit(b[1]))).otherwise(end)
    return start, end


def date_window(start: str | None, end: str | None, today: date | None = None) -> tuple[date, date]:
    """The days of a download: both given, or 15 days back from the end, or from today where `today` is given."""
    if today is not None:
        return today - timedelta(days=LOOK_BACK_DAYS), today
    if not end:
        raise ValueError("an end is needed" if start else "give an end, a start and an end, or today")
    last = date.fromisoformat(end)
    first = date.fromisoformat(start) if start else last - timedelta(days=LOOK_BACK_DAYS)
    if last < first:
        raise ValueError(f"the end {last} is before the start {first}")
    return first, last


def years_between(start: date, end: date) -> list[int]:
    """The years whose partitions a period reads."""
    if end < start:
        raise ValueError(f"the end {end} is before the start {start}")
    return list(range(start.year, end.year + 1))


def build_intervals(start: Column, end: Column, n: int) -> Column:
    """n equal half-open slices (i, from_us, to_us) of the days start to end, in microseconds; the last takes the rest."""
    if n <= 0:
        raise ValueError("the number of intervals must be positive")
    first = F.unix_micros(start.cast("timestamp"))
    stop = F.unix_micros(end.cast("timestamp")) + DAY
    step = F.floor((stop - first) / n)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(i.alias("i"), (first + i * step).alias("from_us"), F.when(i == n - 1, stop).otherwise(first + (i + 1) * step).alias("to_us")),
    )


def format_date(text: Column) -> Column:
    """Dates as day.month.year with the time that they have; other texts as they are; none as a dash."""
    shown = [F.date_format(F.try_to_timestamp(text, F.lit(a)), b) for a, b in DISPLAY_LAYOUTS]
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("—")).otherwise(F.coalesce(*shown, text))
