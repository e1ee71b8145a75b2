"""Dates, durations and calendar spines. The current day is always an argument, `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_key(c: Name) -> Column:
    """The day part of ISO text."""
    return F.substring(col(c), 1, 10)


def day(c: Name) -> Column:
    """ISO text, with or without a time, T or a space between, as a date; null where it is none."""
    return col(c).try_cast("timestamp_ntz").cast("date")


def day_of(rows: DataFrame) -> Column:
    """The day of reading rows: the stored column where there is one, so that filters reach the files, else worked out from the date's text."""
    return F.col("day") if "day" in rows.columns else day("date")


def stamp(c: Name) -> Column:
    """ISO text as a timestamp without zone; a date alone is its midnight, anything else null."""
    return col(c).try_cast("timestamp_ntz")


def tolerant_stamp(c: Name) -> Column:
    """As `stamp`, with the first space of the text read as T."""
    return F.regexp_replace(F.trim(col(c)), "^([^ T]+) ", "$1T").try_cast("timestamp_ntz")


def resolved_day(stored: Name, started: Name, raw: Name, as_of: str) -> Column:
    """The first that is a day: the stored timestamp, the session's start, the first ten characters of the raw text, as_of."""
    return F.coalesce(day(stored), day(started), day(day_key(raw)), F.lit(as_of).cast("date"))


def week_start(c: Name) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", col(c)).cast("date")


def month_start(c: Name) -> Column:
    return F.trunc(col(c), "month")


def month_end(c: Name) -> Column:
    return F.last_day(col(c))


def plain_week(c: Name) -> Column:
    """Calendar year and week number as text, the week counted from a 0-based day of the year: not the ISO week; may be 0 or 53."""
    weekday = F.weekday(col(c)) + 1
    week = F.floor((F.dayofyear(col(c)) - 1 - weekday + 10) / 7)
    return F.concat_ws("-", F.year(col(c)), week.cast("int"))


def duration(seconds: Name) -> Column:
    """Seconds as hours and minutes, minutes, or seconds."""
    s = col(seconds)
    h, m = F.floor(s / 3600).cast("string"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    return F.when(s >= 3600, F.concat(h, F.lit(" h "), m, F.lit(" min"))).when(s >= 60, F.concat(m, F.lit(" min"))).otherwise(F.concat(s.cast("string"), F.lit(" s")))


def _elapsed(c: Name, as_of: str) -> Column:
    return F.timestamp_diff("SECOND", col(c), F.lit(as_of).cast("timestamp_ntz"))


def relative(c: Name, as_of: str) -> Column:
    """How long ago: just now, minutes, hours, yesterday, days, months of 30 days, years of 365."""
    s = _elapsed(c, as_of)
    days = F.floor(s / 86400)
    months, years = F.floor(days / 30), F.floor(days / 365)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(col(c).isNull(), "--").when(s < 60, "just now").when(s < 3600, text(F.floor(s / 60), "minutes")).when(s < 86400, text(F.floor(s / 3600), "hours"))
        .when(days == 1, "yesterday").when(days < 30, text(days, "days")).when((days < 365) & (months <= 1), "last month").when(days < 365, text(months, "months"))
        .when(years <= 1, "last year").otherwise(text(years, "years"))
    )


def relative_plain(c: Name, as_of: str) -> Column:
    """The second wording: seconds are named, and there is no last month or last year."""
    s = _elapsed(c, as_of)
    days = F.floor(s / 86400)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(col(c).isNull(), "").when(s < 60, text(s, "s, just now")).when(s < 3600, text(F.floor(s / 60), "minutes ago")).when(s < 86400, text(F.floor(s / 3600), "hours ago"))
        .when(s < 172800, "yesterday").when(days < 30, text(days, "days ago")).when(days < 365, text(F.floor(days / 30), "months ago")).otherwise(text(F.floor(days / 365), "years ago"))
    )


def clock_seconds(c: Name) -> Column:
    """A media clock value in seconds: h:m:s, m:s, or a number with the unit h, min, s or ms; a bare number is seconds."""
    parts = F.split(F.trim(col(c)), ":")
    number = lambda x: x.try_cast("double")
    value = number(F.regexp_extract(F.trim(col(c)), r"^([0-9.]+)(h|min|s|ms)?$", 1))
    unit = F.regexp_extract(F.trim(col(c)), r"^([0-9.]+)(h|min|s|ms)?$", 2)
    factor = F.when(unit == "h", 3600.0).when(unit == "min", 60.0).when(unit == "ms", 0.001).otherwise(1.0)
    return (
        F.when(F.size(parts) == 3, number(parts[0]) * 3600 + number(parts[1]) * 60 + number(parts[2]))
        .when(F.size(parts) == 2, number(parts[0]) * 60 + number(parts[1])).otherwise(value * factor)
    )


def spine(spark: SparkSession, start: str, end: str, unit: str = "day") -> DataFrame:
    """One row for each day (or month) from start to end: column `day`."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 {unit})")).alias("day"))


def current_time() -> dict[str, Column]:
    """What a clock query returns: local text, UTC text, epoch milliseconds, zone."""
    now = F.current_timestamp()
    return {
        "local_time": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS"), "utc_time": F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "epoch_ms": F.unix_millis(now), "timezone": F.current_timezone(), "offset_minutes": (F.unix_timestamp(now) - F.unix_timestamp(F.to_utc_timestamp(now, F.current_timezone()))) / 60,
    }
