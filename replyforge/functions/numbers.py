"""Numeric, id and time expressions that never fail under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from replyforge.functions.text import strip

# The forms times come in: plain, with an offset, and ISO 8601 with a T.
TIME_FORMS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss Z",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX",
)


def parse_id(value: Column) -> Column:
    """Nullable id out of text such as ``12`` or ``12.0``; junk gives NULL.

    Whole numbers parse straight to long, which keeps ids above 2**53 exact;
    only the decimal form goes through double.
    """
    text = value.cast("string")
    as_double = text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), as_double.try_cast("bigint"))


def parse_flag(value: Column) -> Column:
    """'True' / 'false' text to boolean; any other text gives NULL."""
    flag = F.lower(strip(value.cast("string")))
    return F.when(flag == "true", True).when(flag == "false", False)


def parse_time(value: Column, forms: tuple[str, ...] = TIME_FORMS) -> Column:
    """Timestamp or NULL; the first form that fits, then the weekday form.

    Text without an offset is read in the session's time zone.
    """
    return F.coalesce(
        *[F.try_to_timestamp(value, F.lit(f)) for f in forms], parse_weekday_time(value)
    )


def parse_weekday_time(value: Column) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017``; the weekday letters are cut off first."""
    return F.try_to_timestamp(F.substring(value, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def whole_percent_text(share: Column) -> Column:
    """'58%' from 0.585: half-even, as Python's ``:.0f`` prints it."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))
