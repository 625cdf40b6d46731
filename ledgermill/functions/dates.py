"""Dates written in several orders, ages, clinic days and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"


def _valid(text: Column, pattern: str) -> Column:
    return F.try_to_date(text, pattern)


def separator_shape(c: Column) -> Column:
    """iso, dash or slash by the separator; null for other writings."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "iso").when(c.rlike(r"^\d{2}-\d{2}-\d{4}$"), "dash").when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), "slash")


def read_by_separator(c: Column) -> Column:
    """9999-99-99 as year first, 99-99-9999 as day first, 99/99/9999 as month first; null if not a day."""
    s = separator_shape(c)
    return (
        F.when(s == "iso", _valid(F.when(s == "iso", c), "yyyy-MM-dd"))
        .when(s == "dash", _valid(F.when(s == "dash", c), "dd-MM-yyyy"))
        .when(s == "slash", _valid(F.when(s == "slash", c), "MM/dd/yyyy"))
    )


def swapped(d: Column) -> Column:
    """Day and month of a date exchanged, if that is another real day."""
    other = _valid(F.concat_ws("-", F.date_format(d, "yyyy"), F.date_format(d, "dd"), F.date_format(d, "MM")), "yyyy-MM-dd")
    return F.when(d.isNotNull(), F.nullif(other, d))


def alternative_reading(c: Column) -> Column:
    """Day and month swapped, if that is another real day."""
    return swapped(read_by_separator(c))


def age_in_years(born: Column, at: Column) -> Column:
    """Birthdays had; 29 February counts from 1 March in common years."""
    before = (F.month(at) < F.month(born)) | ((F.month(at) == F.month(born)) & (F.dayofmonth(at) < F.dayofmonth(born)))
    return F.year(at) - F.year(born) - before.cast("int")


def age_at(born: Column, at: Column) -> Column:
    """Null if the day lies before birth."""
    return F.when(at >= born, age_in_years(born, at))


def impossible_reason(d: Column, as_of: Column, signup: Column | None = None, oldest: int = 100) -> Column:
    """Why a readable date can't be, null if it can."""
    out = F.when(d > as_of, "after_as_of")
    return out.when(age_in_years(d, signup) > oldest, f"age_above_{oldest}_at_signup") if signup is not None else out


def _instant(utc: Column) -> Column:
    """The instant of a UTC clock reading, whatever zone the session has."""
    return F.make_timestamp(F.year(utc), F.month(utc), F.dayofmonth(utc), F.hour(utc), F.minute(utc), F.second(utc).cast("decimal(8,6)"), F.lit("UTC"))


def wall_to_instant(wall: Column, zone: str = ZONE) -> Column:
    """struct(at: instant, wall: its UTC clock reading, ambiguous, nonexistent) of a local wall time (timestamp_ntz).

    In the repeated hour the earlier instant; in the skipped hour the offset before it holds. Whole seconds."""
    w = wall.cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), w)
    back = lambda u: F.convert_timezone(F.lit("UTC"), F.lit(zone), u)
    return F.struct(_instant(utc).alias("at"), utc.alias("wall"), (back(utc + F.expr("INTERVAL 1 HOUR")) == w).alias("ambiguous"), (back(utc) != w).alias("nonexistent"))


def day_of(utc: Column, zone: str = ZONE) -> Column:
    """The calendar day at the clinic of a UTC clock reading (timestamp_ntz), whatever zone the session has."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")))


def is_calendar_date(c: Column) -> Column:
    """B31."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & _valid(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd").isNotNull(), F.lit(False))


def shift_years(d: Column, years: int) -> Column:
    """The same day in another year, 29 February becoming the 28th."""
    return F.add_months(d, 12 * years)


def dob_bounds(today: Column, youngest: int = 18, oldest: int = 100) -> Column:
    """Earliest and latest birth date of an age between the two."""
    return F.struct(F.date_add(shift_years(today, -(oldest + 1)), 1).alias("earliest"), shift_years(today, -youngest).alias("latest"))


def date_parts(c: Column) -> Column:
    """The numbers in a date-like text."""
    return F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))


def two_digit_year(y: Column, pivot: int = 26) -> Column:
    """00..pivot are 2000s, the rest 1900s; longer years as they are."""
    n = y.cast("int")
    return F.when(F.length(y) == 2, F.when(n <= pivot, n + 2000).otherwise(n + 1900)).otherwise(n)


def year_position(c: Column) -> Column:
    """First, last or none, by where a four-digit part stands."""
    p = date_parts(c)
    return F.when(F.size(p) != 3, "none").when(F.length(p[0]) == 4, "first").when(F.length(p[2]) == 4, "last").otherwise("none")


def classify_order(c: Column) -> Column:
    """What the two other parts allow: day-month, month-day, either, neither."""
    p = date_parts(c)
    first = year_position(c) == "first"
    a = F.when(first, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))).cast("int")
    b = F.when(first, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1))).cast("int")
    return (
        F.when(year_position(c) == "none", "unreadable")
        .when(a.between(1, 12) & b.between(1, 12), F.when(a == b, "same").otherwise("either"))
        .when(a.between(13, 31) & b.between(1, 12), "day-month")
        .when(a.between(1, 12) & b.between(13, 31), "month-day")
        .otherwise("neither")
    )


def candidate_dates(c: Column) -> Column:
    """All days that the text may stand for, sorted."""
    p = date_parts(c)
    first = year_position(c) == "first"
    y = two_digit_year(F.when(first, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(2))))
    a = F.when(first, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0)))
    b = F.when(first, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    made = lambda m, d: _valid(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    return F.when(F.size(p) == 3, F.array_sort(F.array_distinct(F.array_compact(F.array(made(a, b), made(b, a))))))
