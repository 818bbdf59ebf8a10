"""Scalar functions: coercion of states to numbers, units, criteria, calendar spans, names.

Three vocabularies of on and off words exist on purpose; they belong to different operators.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the numeric coercion reads as 1 and 0.
ON_WORDS = ("active", "on", "true", "running", "1")
OFF_WORDS = ("inactive", "off", "false", "stopped", "0")


def numeric(value: Column, text: Column, boolean: Column) -> Column:
    """Booleans and state words as 1 and 0, numbers as they are, other text as null."""
    word = F.lower(F.trim(text))
    return F.coalesce(boolean.cast("int").cast("double"), value, F.when(word.isin(*ON_WORDS), 1.0).when(word.isin(*OFF_WORDS), 0.0))


# Spellings of degrees Fahrenheit, without their blanks and in lower case.
FAHRENHEIT = ("°f", "degf", "f", "fahrenheit", "degreesfahrenheit", "℉")
# Words that sequence checks read as 1 and 0.
SEQUENCE_ON = ("true", "on", "active", "1", "yes", "run", "running")
SEQUENCE_OFF = ("false", "off", "inactive", "0", "no", "stop", "stopped")


def is_fahrenheit(unit: Column) -> Column:
    return F.replace(F.lower(F.trim(unit)), F.lit(" "), F.lit("")).isin(*FAHRENHEIT)


def sequence_number(value: Column, text: Column, boolean: Column, unit: Column | None = None, kind: str = "number") -> Column:
    """A number for sequence checks of a role of `kind`: number, temperature or binary.

    Booleans are 1 and 0. State words count for binary roles only, whose numbers are 1 unless zero.
    Temperatures in degrees Fahrenheit come out in Celsius. Text that holds no number is null.
    """
    word = F.lower(F.trim(text))
    number = F.coalesce(value, word.try_cast("double"))
    if kind == "binary":
        number = F.coalesce(F.when(word.isin(*SEQUENCE_ON), 1.0).when(word.isin(*SEQUENCE_OFF), 0.0), (number != 0).cast("int").cast("double"))
    elif kind == "temperature" and unit is not None:
        number = F.when(F.coalesce(is_fahrenheit(unit), F.lit(False)), (number - 32) * 5 / 9).otherwise(number)
    return F.coalesce(boolean.cast("int").cast("double"), number)


def path_segment(text: Column) -> Column:
    """Percent-encoded UTF-8 of everything but letters, digits and _ . - ~"""
    coded = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    return F.replace(coded, F.lit("%7E"), F.lit("~"))


def celsius(value: Column, unit: Column) -> Column:
    return F.when(is_fahrenheit(unit), (value - 32) / 1.8).otherwise(value)


def load_tons(gpm: Column, supply_f: Column, return_f: Column) -> Column:
    return gpm * (return_f - supply_f) / 24


def meets(value: Column, op: str, lo: float, hi: float | None = None) -> Column:
    """Criterion operators; `between` includes both ends."""
    return {
        "between": lambda: value.between(lo, hi), ">=": lambda: value >= lo, "<=": lambda: value <= lo,
        ">": lambda: value > lo, "<": lambda: value < lo, "==": lambda: value == lo,
    }[op]()


def in_hours(ts: Column, zone: str, days: tuple[int, ...], first: int, last: int) -> Column:
    """Local weekday (Monday 0) among `days` and local hour in [first, last)."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.weekday(local).isin(*days) & (F.hour(local) >= first) & (F.hour(local) < last)


def ratio(now: Column, base: Column) -> Column:
    return now / F.greatest(base, F.lit(1.0))


def alarm_severity(priority: Column) -> Column:
    return F.when(priority <= 63, "critical").when(priority <= 127, "warning").otherwise("info")


def in_scope(column: str, allowed: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> Column:
    """Prefix scope: under an allowed prefix (all if none is named) and under no excluded one."""
    keep = F.lit(not allowed)
    for prefix in allowed:
        keep = keep | F.col(column).startswith(prefix)
    for prefix in excluded:
        keep = keep & ~F.col(column).startswith(prefix)
    return keep


def span(name: str, today: date, zone: str = "UTC") -> tuple[datetime, datetime]:
    """[start, end) of a named span at local midnights, in UTC without a zone.

    today, yesterday, this/last/past Week, Month, Quarter, Year; past spans reach back from
    today, today included.
    """
    month = lambda d, n: date(d.year + (d.month - 1 + n) // 12, (d.month - 1 + n) % 12 + 1, 1)
    week, first, year = today - timedelta(days=today.weekday()), today.replace(day=1), date(today.year, 1, 1)
    quarter = month(year, 3 * ((today.month - 1) // 3))
    after = today + timedelta(days=1)
    spans = {
        "today": (today, after), "yesterday": (today - timedelta(days=1), today),
        "thisWeek": (week, week + timedelta(days=7)), "lastWeek": (week - timedelta(days=7), week), "pastWeek": (today - timedelta(days=7), after),
        "thisMonth": (first, month(first, 1)), "lastMonth": (month(first, -1), first), "pastMonth": (today - timedelta(days=30), after),
        "thisQuarter": (quarter, month(quarter, 3)), "lastQuarter": (month(quarter, -3), quarter),
        "thisYear": (year, month(year, 12)), "lastYear": (month(year, -12), year), "pastYear": (today - timedelta(days=365), after),
    }
    utc = lambda d: datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
    lo, hi = spans[name]
    return utc(lo), utc(hi)
