"""Periods and calendars: days (``YYYY-MM-DD``) and ISO weeks (``YYYY-Www``).

Everything is a Column expression; no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that surrounds dirty keys: space, tab, line ends.
BLANKS = " \t\n\r"


def trimmed(c: Column) -> Column:
    """Without surrounding space, tab and line ends."""
    return F.trim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """Null instead of an empty or blank text."""
    return F.nullif(trimmed(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names
    it. Column expressions repeat what they name, and generated methods that
    grow too large are not compiled."""
    return F.transform(F.array(value), body)[0]


def monday_of_iso_week(year: Column, week: Column) -> Column:
    """Monday of ISO week ``week`` of ISO year ``year`` (both int)."""
    jan4 = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(jan4, F.weekday(jan4)), (week - 1) * 7)


def iso_week(d: Column) -> Column:
    """``YYYY-Www`` of a date."""
    return F.concat(
        F.lpad(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad(F.extract(F.lit("WEEK"), d).cast("string"), 2, "0"),
    )


def compact_period(c: Column) -> Column:
    """Any notation of a period without separators: ``20251120``, ``2025W47``."""
    return F.translate(F.upper(trimmed(c)), ".-/", "")


def period_code(compact: Column) -> Column:
    """Calendar place of a compact period as an int: twice the day number, plus
    one for a week, which stands at its Monday. Null if it is no period."""
    day = F.try_to_date(F.when(F.length(compact) == 8, compact), "yyyyMMdd")
    is_week = compact.rlike("^[0-9]{4}W(0[1-9]|[1-4][0-9]|5[0-3])$")
    year = F.when(is_week, F.substring(compact, 1, 4)).try_cast("int")
    week = F.when(is_week, F.substring(compact, 6, 2)).try_cast("int")
    monday = monday_of_iso_week(year, week)
    return F.coalesce(F.unix_date(day) * 2, F.unix_date(monday) * 2 + 1)


def period_label(code: Column) -> Column:
    """The canonical text of a ``period_code``."""
    day = F.date_from_unix_date(F.shiftright(code, 1))
    return F.when(code.bitwiseAND(1) == 1, iso_week(day)).otherwise(day.cast("string"))


def canonical_period(c: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-Www`` from any notation; null if it is neither."""

    def form(t: Column) -> Column:
        day = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
        week = F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 3))
        return F.when((F.length(t) == 8) & t.rlike("^[0-9]{8}$"), let(day, lambda x: F.when(x.try_cast("date").isNotNull(), x))).when(t.rlike("^[0-9]{4}W[0-9]{2}$"), week)

    return let(compact_period(c), form)


def period_place(period: Column) -> Column:
    """Calendar place of a canonical period (see ``period_code``)."""
    return period_code(compact_period(period))


def align_back(d: Column, weekday: Column) -> Column:
    """The last day on or before ``d`` that is ``weekday`` (Monday = 0)."""
    return F.date_sub(d, F.pmod(F.weekday(d) - weekday, F.lit(7)).cast("int"))


def history_date(anchor: Column) -> Column:
    """The day after the anchor; an anchor that is no date stays as it is."""
    d = anchor.try_cast("date")
    return F.coalesce(F.date_add(d, 1).cast("string"), anchor)


def cutoff_date(date: Column) -> Column:
    """The day before; a text that is no date stays as it is."""
    d = date.try_cast("date")
    return F.coalesce(F.date_sub(d, 1).cast("string"), date)


def week_sort_key(period: Column) -> Column:
    """``struct(year, week)``; (0, 0) if it is no week."""
    ok = period.rlike("^[0-9]{4}-W[0-9]{2}$")
    part = lambda at, n: F.when(ok, F.substring(period, at, n)).try_cast("int")
    return F.struct(
        F.coalesce(part(1, 4), F.lit(0)).alias("year"), F.coalesce(part(7, 2), F.lit(0)).alias("week")
    )


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` of a dashed date."""
    return F.replace(c, F.lit("-"), F.lit(""))


def dashed_date(c: Column) -> Column:
    """``YYYY-MM-DD`` of a compact date; other texts stay."""
    return F.when(
        c.rlike("^[0-9]{8}$"),
        F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)),
    ).otherwise(c)


def week_start(end: Column) -> Column:
    """First day of the seven days that end with ``end``."""
    return F.date_sub(end, 6)


def crawl_date(c: Column) -> Column:
    """Date text of a crawl stamp: an ISO prefix as it is; a compact UTC stamp
    as the date in Seoul; else the first ten characters."""
    stamp = F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    seoul = F.date_format(F.from_utc_timestamp(stamp, "Asia/Seoul"), "yyyy-MM-dd")
    return (
        F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(c, 1, 10))
        .when(c.rlike("^[0-9]{8}T[0-9]{6}Z$"), F.coalesce(seoul, F.substring(c, 1, 10)))
        .otherwise(F.substring(c, 1, 10))
    )


def dotted_period(c: Column) -> Column:
    """``YYYY.MM.DD`` as a day; ``YYYY.MM.DD ~ ...`` as the ISO week of its
    first day; null if there is no such date."""
    y, m, d = (F.regexp_extract(c, r"(\d{4})\.(\d{2})\.(\d{2})", i) for i in (1, 2, 3))
    day = F.nullif(F.concat_ws("-", y, m, d), F.lit("--")).try_cast("date")
    return F.when(F.contains(c, F.lit("~")), iso_week(day)).otherwise(day.cast("string"))


def month_day(c: Column, today: Column) -> Column:
    """``MM.DD`` as the last such day that is not after ``today``."""
    m, d = (F.regexp_extract(c, r"^\s*(\d{1,2})\.(\d{1,2})", i) for i in (1, 2))
    def at(year: Column) -> Column:
        return F.concat_ws("-", year.cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    this = at(F.year(today))
    return F.when(this > today, at(F.year(today) - 1)).otherwise(this)


def age_days(since: Column, now: Column) -> Column:
    """Whole days from ``since`` to ``now``; null if ``since`` is."""
    return F.datediff(now, since)


def reference_period(weekly: Column, aligned_weekday: Column, shift: Column, date: Column, explicit: Column) -> Column:
    """Period of a delivery. A valid ``explicit`` period wins; else an aligned
    series goes back to its weekday, a weekly one gets the ISO week, and any
    other the date less ``shift`` days."""
    return F.coalesce(
        canonical_period(explicit),
        align_back(date, aligned_weekday).cast("string"),
        F.when(weekly, iso_week(date)),
        F.date_sub(date, F.coalesce(shift, F.lit(0))).cast("string"),
    )


def friday_of_iso_week(period: Column) -> Column:
    """The Friday of a week period; null if it is none."""
    ok = period.rlike("^[0-9]{4}-W[0-9]{2}$")
    part = lambda at, n: F.when(ok, F.substring(period, at, n)).try_cast("int")
    return F.date_add(monday_of_iso_week(part(1, 4), part(7, 2)), 4)


def period_of_file(path: Column) -> Column:
    """The last date that a file name holds, dashed or compact, as text."""
    dates = F.regexp_extract_all(F.substring_index(path, "/", -1), F.lit(r"(\d{4}-?\d{2}-?\d{2})"), 1)
    return dashed_date(compact_date(F.try_element_at(dates, F.lit(-1))))
