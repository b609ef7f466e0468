"""Texts about rows: sizes, dates, times, estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixels(width: Column, height: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(width, zero).cast("long") * F.coalesce(height, zero).cast("long")


def year(taken: Column) -> Column:
    return F.year(F.timestamp_seconds(taken))


def captured_label(taken: Column, otherwise: str = "unknown date") -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(taken), "yyyy-MM-dd"), F.lit(otherwise))


def dimensions(width: Column, height: Column) -> Column:
    return F.coalesce(F.concat(width.cast("string"), F.lit(" × "), height.cast("string")), F.lit("unknown"))


def format_bytes(size: Column) -> Column:
    """Decimal units: GB with one digit, MB and KB with none. Halves go to the even neighbour, as in C's printf; Java's rounds them up."""
    even = lambda unit: F.bround(size / unit, 0)
    return (
        F.when(size >= 1_000_000_000, F.format_string("%.1f GB", size / 1e9))
        .when(size >= 1_000_000, F.format_string("%.0f MB", even(1e6)))
        .when(size >= 1_000, F.format_string("%.0f KB", even(1e3)))
        .otherwise(F.format_string("%d bytes", size))
    )


def time_ago(seconds: Column) -> Column:
    """How long ago, in seven steps."""
    minutes, hours, days = seconds / 60, seconds / 3600, seconds / 86400
    whole = lambda x: F.bround(x, 0).cast("long")
    return (
        F.when(seconds < 45, F.lit("just now"))
        .when(minutes < 1.5, F.lit("1 minute ago"))
        .when(minutes < 59.5, F.format_string("%d minutes ago", whole(minutes)))
        .when(hours < 1.5, F.lit("1 hour ago"))
        .when(hours < 23.5, F.format_string("%d hours ago", whole(hours)))
        .when(hours < 36, F.lit("yesterday"))
        .otherwise(F.format_string("%d days ago", whole(days)))
    )


def format_eta(seconds: float) -> str:
    if seconds < 10:
        return "a few seconds"
    if seconds < 60:
        return f"{math.ceil(seconds)}s"
    if seconds < 3600:
        return f"{math.ceil(seconds / 60)}m"
    return f"{int(seconds // 3600)}h {int(seconds % 3600 // 60)}m"


def camera(make: Column, model: Column) -> Column:
    """Make and model in one; the model alone where it begins with the make; null where both are empty."""
    a, b = F.trim(F.coalesce(make, F.lit(""))), F.trim(F.coalesce(model, F.lit("")))
    joined = F.when((a != "") & (b != "") & F.startswith(F.upper(b), F.upper(a)), b).otherwise(F.trim(F.concat_ws(" ", a, b)))
    return F.when((a == "") & (b == ""), F.lit(None).cast("string")).otherwise(joined)


#: The forms in which a capture time is read.
TIME_FORMS = (
    "yyyy:MM:dd HH:mm:ss.SSS", "yyyy:MM:dd HH:mm:ss", "yyyy:MM:dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM", "yyyyMMdd", "yyyy",
)


def taken(original: Column, digitized: Column, modified: Column) -> Column:
    """The capture time of the first EXIF text that can be read (mostly yyyy:MM:dd HH:mm:ss), in seconds UTC."""
    parse = lambda c: F.unix_seconds(F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(form)) for form in TIME_FORMS]))
    return F.coalesce(parse(original), parse(digitized), parse(modified))
