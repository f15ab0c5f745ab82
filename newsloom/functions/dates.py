"""Date parsing and date windows. All values are zone-less wall-clock times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import let

# Spanish month names in calendar order.
SPANISH_MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)

# Spanish weekday names, Monday first.
SPANISH_WEEKDAYS = (
    "lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo",
)

# English month names in calendar order.
ENGLISH_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Units of relative dates, by their first letters, as (months, seconds).
UNITS = (
    ("segundo", "second", 0, 1),
    ("minuto", "minute", 0, 60),
    ("hora", "hour", 0, 3600),
    ("día", "day", 0, 86400),
    ("semana", "week", 0, 7 * 86400),
    ("mes", "month", 1, 0),
    ("año", "year", 12, 0),
)

# Days named by their distance from today.
NAMED_DAYS = (
    ("hoy", 0), ("today", 0), ("ayer", 1), ("yesterday", 1), ("anteayer", 2), ("antier", 2),
)

_CLOCK = r"(?:\D+(\d{1,2}):(\d{2}))?\D*$"
_DAY_MONTH = r"^(?:\p{L}+,?\s+)?(\d{1,2})\s+(?:de\s+)?(\p{L}{3,})\.?,?\s+(?:del?\s+)?(\d{4})" + _CLOCK
_MONTH_DAY = r"^(?:\p{L}+,\s+)?(\p{L}{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _CLOCK
_AGO = r"^(?:hace\s+)?(\d{1,6}|una?|an?)\s+(\p{L}+)(\s+ago|\s+atrás)?$"
_NAMED_DAY = r"^(\p{L}+)(?:\D+(\d{1,2}):(\d{2}))?$"
_SPANISH_DATE = r"^\D*(\d{1,2}) (\p{L}+),? (\d{4}),? (\d{1,2}):(\d{2})$"
_DAY_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
_ZONE = r"(:\d{2}(?:\.\d+)?)\s*(?:Z|[+-]\d{2}:?\d{2})$"


def as_column(value) -> Column:
    """A moment given as a column, a datetime or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def spanish_date(text: Column) -> Column:
    """Parse `weekday DD month, YYYY HH:mm`, with or without ' | ' before the time.

    Empty and unparsable texts give NULL.
    """
    flat = F.lower(F.replace(F.btrim(text), F.lit(" | "), F.lit(" ")))
    fields = F.split(F.regexp_replace(flat, _SPANISH_DATE, "$3,$2,$1,$4,$5"), ",")
    months = F.array(*[F.lit(m) for m in SPANISH_MONTHS])

    def moment(f: Column) -> Column:
        two = lambda i: F.lpad(F.get(f, F.lit(i)), 2, "0")
        month = F.array_position(months, F.get(f, F.lit(1)))
        iso = F.concat(
            F.get(f, F.lit(0)), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), two(2),
            F.lit(" "), two(3), F.lit(":"), two(4),
        )
        return F.when((F.size(f) == 5) & (month > 0), iso.try_cast("timestamp_ntz"))

    return let(fields, moment)


def spanish_text(moment: Column) -> Column:
    """The form `spanish_date` reads, with the pipe separator."""
    names = F.array(*[F.lit(m) for m in SPANISH_MONTHS])
    days = F.array(*[F.lit(d) for d in SPANISH_WEEKDAYS])
    return F.concat(
        F.element_at(days, F.weekday(moment) + 1),
        F.lit(" "),
        F.date_format(moment, "dd"),
        F.lit(" "),
        F.element_at(names, F.month(moment)),
        F.lit(", "),
        F.date_format(moment, "yyyy"),
        F.lit(" | "),
        F.date_format(moment, "HH:mm"),
    )


def drop_zone(text: Column) -> Column:
    """Remove the zone label behind a time, without converting the time."""
    return F.regexp_replace(text, _ZONE, "$1")


def _fields(text: Column, pattern: str, order: str) -> Column:
    """The groups of a pattern as an array; the whole text alone where it does not match."""
    return F.split(F.regexp_replace(text, pattern, order), ",")


def named_date(text: Column) -> Column:
    """Day, month name and year, or month name, day and year, in Spanish or English, with or without a time.

    A month may be cut short to three letters or more. Without a time it is midnight.
    """
    flat = F.lower(F.btrim(text))
    day_first = _fields(flat, _DAY_MONTH, "$3,$2,$1,$4,$5,x")
    month_first = _fields(flat, _MONTH_DAY, "$3,$1,$2,$4,$5,x")

    def number(name: Column) -> Column:
        of = lambda names: F.array_position(F.transform(F.array(*[F.lit(m) for m in names]), lambda m: F.startswith(m, name)), True)
        return F.greatest(of(SPANISH_MONTHS), of(ENGLISH_MONTHS))

    def moment(f: Column) -> Column:
        get = lambda i: F.get(f, F.lit(i))
        clock = lambda i: F.lpad(F.when(get(i) == "", "0").otherwise(get(i)), 2, "0")

        def made(month: Column) -> Column:
            day = F.concat_ws("-", get(0), F.lpad(month.cast("string"), 2, "0"), F.lpad(get(2), 2, "0"))
            return F.when(month > 0, F.concat(day, F.lit(" "), clock(3), F.lit(":"), clock(4)).try_cast("timestamp_ntz"))

        return F.when(F.size(f) == 6, let(number(get(1)), made))

    return F.coalesce(let(day_first, moment), let(month_first, moment))


def relative_date(text: Column, captured: Column) -> Column:
    """A moment told from the one of capture: `hace 3 horas`, `2 days ago`, `ayer`, `yesterday at 18:30`.

    A named day has the time of the capture unless it names another. NULL for other texts.
    """
    flat = F.regexp_replace(F.lower(F.btrim(text)), r"^(hace|hoy|today|ayer|yesterday|anteayer|antier)\s+", "$1 ")
    ago = F.regexp_like(flat, F.lit(r"^hace .*|.*\s(ago|atrás)$"))

    def told(f: Column) -> Column:
        count, unit = F.get(f, F.lit(0)), F.get(f, F.lit(1))
        n = F.coalesce(count.try_cast("int"), F.lit(1))
        out = None
        for spanish, english, months, seconds in UNITS:
            # No more years than the calendar has.
            far = F.make_ym_interval(F.lit(0), F.when(n <= 9999, n) * months)
            step = far if months else F.make_dt_interval(secs=(n.cast("long") * seconds).cast("decimal(18,6)"))
            hit = F.startswith(unit, F.lit(spanish)) | F.startswith(unit, F.lit(english))
            out = F.when(hit, captured - step) if out is None else out.when(hit, captured - step)
        return F.when((F.size(f) == 3) & (out >= F.lit("0001-01-01").cast("timestamp_ntz")), out)

    def named(f: Column) -> Column:
        days = None
        for name, n in NAMED_DAYS:
            hit = F.get(f, F.lit(0)) == name
            days = F.when(hit, F.lit(n)) if days is None else days.when(hit, F.lit(n))
        minutes = F.get(f, F.lit(1)).try_cast("int") * 60 + F.get(f, F.lit(2)).try_cast("int")
        clock = F.date_trunc("day", captured).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)
        day = F.make_dt_interval(days=days)
        return F.when(F.size(f) == 4, F.coalesce(clock, captured) - day)

    since = let(_fields(flat, _AGO, "$1,$2,x"), told)
    return F.coalesce(F.when(ago, since), let(_fields(flat, _NAMED_DAY, "$1,$2,$3,x"), named))


def free_date(text: Column, captured: Column | None = None) -> Column:
    """Year-first or day-first numbers, else the Spanish long form, else month names, else NULL.

    With the moment of `captured`, texts that tell a date relative to it are
    read as well. The time is optional. Day-first dates are put in year-first
    order, so that one cast reads both and no format is tried in vain.
    """
    bare = drop_zone(F.btrim(text))
    ordered = F.regexp_replace(bare, _DAY_FIRST, "$3-$2-$1")
    ways = [ordered.try_cast("timestamp_ntz"), spanish_date(bare), named_date(bare)]
    return F.coalesce(*ways, *([] if captured is None else [relative_date(bare, captured)]))


def iso_or_null(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def before(moment, hours: int) -> Column:
    return as_column(moment) - F.make_dt_interval(hours=F.lit(hours))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)


def lookback_floor(as_of, mode: str = "rolling") -> Column:
    """Oldest moment a run looks back to.

    `rolling` is 24 hours before `as_of`; `prev_midnight` is the day before at
    hour zero with the minutes and seconds kept, which is 24 to 48 hours back.
    """
    now = as_column(as_of)
    if mode == "rolling":
        return before(now, 24)
    if mode == "prev_midnight":
        return before(now, 24) - F.make_dt_interval(hours=F.hour(now))
    raise ValueError(f"unknown look-back mode: {mode}")


def strictly_after(upper: Column, lower: Column, strict: bool = False) -> Column:
    """`upper > lower`, NULL when either moment is missing; with `strict` a missing one raises."""
    if not strict:
        return upper > lower
    return F.when(
        upper.isNull() | lower.isNull(), F.raise_error(F.lit("one or both dates are invalid"))
    ).otherwise(upper > lower)
