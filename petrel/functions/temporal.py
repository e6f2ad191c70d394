"""Clinical date, time and datetime values: ISO 8601 text to and from SAS and Unix numbers.

All are Catalyst expressions.  Guards come first: Spark's own casts accept texts that the
ISO grammars do not, so a value is picked apart only after one regular expression matched.
The session's zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SAS_EPOCH = "1960-01-01"
SAS_TO_UNIX = 315_619_200  # seconds from 1960-01-01 to 1970-01-01
_OFFSET = r"([Zz]|[+-]((0[0-9]|1[0-7]):[0-5][0-9](:[0-5][0-9])?|18:00(:00)?))"  # up to 18 hours
_ZONE = rf"{_OFFSET}?"
_REGION = r"\[[A-Za-z][A-Za-z0-9~/._+-]+\]"  # may follow an offset, which alone decides the moment
_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?)?"
DATE = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_ZONE}$"
TIME = rf"^{_CLOCK}{_ZONE}$"
DATETIME = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt]{_CLOCK}({_OFFSET}({_REGION})?)?$"


def _number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def _clock_seconds(clock: Column) -> Column:
    """Seconds of HH:mm[:ss[.f]][zone], less the zone's offset."""
    has_seconds = F.substring(clock, 6, 1) == ":"
    tail = F.when(has_seconds, F.substring(clock, 9, 32)).otherwise(F.substring(clock, 6, 32))
    fraction = _number(F.concat(F.lit("0"), F.regexp_extract(tail, r"^\.[0-9]+", 0)))
    zone = F.regexp_extract(tail, r"[+-].*$", 0)
    offset = _number(F.substring(zone, 2, 2)) * 3600 + _number(F.substring(zone, 5, 2)) * 60 + _number(F.substring(zone, 8, 2))
    offset = F.when(F.substring(zone, 1, 1) == "-", -offset).otherwise(offset)
    whole = _number(F.substring(clock, 1, 2)) * 3600 + _number(F.substring(clock, 4, 2)) * 60 + F.when(has_seconds, _number(F.substring(clock, 7, 2))).otherwise(F.lit(0.0))
    return whole - offset + fraction


def _days(text: Column) -> Column:
    return F.datediff(F.substring(text, 1, 10).try_cast("date"), F.lit(SAS_EPOCH).cast("date"))


def sas_datetime(text: Column) -> Column:
    """ISO datetime to seconds since 1960; offsets go to UTC, a naive value is UTC; null where it is no datetime."""
    return F.when(text.rlike(DATETIME), _days(text) * 86400.0 + _clock_seconds(F.regexp_replace(F.substring(text, 12, 128), r"\[.*$", "")))


def sas_date(text: Column) -> Column:
    """ISO date to days since 1960; a zone suffix is ignored."""
    return F.when(text.rlike(DATE), _days(text).cast("double"))


def sas_time(text: Column) -> Column:
    """ISO time to seconds of the day; an offset is taken off and the result wraps within the day."""
    return F.when(text.rlike(TIME), F.pmod(_clock_seconds(text), F.lit(86400.0)))


def split_seconds(x: Column) -> tuple[Column, Column]:
    """Whole seconds (floor) and rounded microseconds, a full million carried over."""
    whole = F.floor(x).cast("long")
    micros = F.floor((x - F.floor(x)) * 1e6 + 0.5).cast("long")
    return whole + (micros >= 1_000_000).cast("long"), micros % 1_000_000


def _fraction(micros: Column) -> Column:
    return F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")))


def _sound(x: Column, limit: float) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)


def _datetime_text(x: Column, shift: int) -> Column:
    safe = F.when(_sound(x, 2.5e11), x)
    whole, micros = split_seconds(safe)
    return F.concat(F.date_format(F.timestamp_seconds(whole - shift), "yyyy-MM-dd'T'HH:mm:ss"), _fraction(micros))


def iso_from_sas_datetime(x: Column) -> Column:
    """Seconds since 1960 to ISO text with as many fraction digits as needed; null for null, NaN and beyond the calendar."""
    return _datetime_text(x, SAS_TO_UNIX)


def iso_from_unix_datetime(x: Column) -> Column:
    return _datetime_text(x, 0)


def _date_text(x: Column, epoch: str) -> Column:
    days = F.floor(F.when(_sound(x, 2.9e6), x) + 0.5).cast("int")
    return F.date_format(F.date_add(F.lit(epoch).cast("date"), days), "yyyy-MM-dd")


def iso_from_sas_date(x: Column) -> Column:
    return _date_text(x, SAS_EPOCH)


def iso_from_unix_date(x: Column) -> Column:
    return _date_text(x, "1970-01-01")


def iso_from_sas_time(x: Column) -> Column:
    """Seconds to a time of day; beyond a day, either way, it wraps."""
    whole, micros = split_seconds(F.when(_sound(x, 9e15), x))
    day = F.pmod(whole, F.lit(86400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(two(F.floor(day / 3600)), F.lit(":"), two(F.floor(day / 60) % 60), F.lit(":"), two(day % 60), _fraction(micros))


def sas_timestamp(x: Column) -> Column:
    """Seconds since 1960 to a timestamp without zone, floored toward the earlier on both sides of 1960."""
    return F.timestamp_seconds(F.floor(x).cast("long") - SAS_TO_UNIX).cast("timestamp_ntz")


def moment_text(ts: Column) -> Column:
    """Date and clock with a blank between; years beyond 9999 and before 0 are plain integers, without a plus or zeros in front."""
    year = F.year(ts)
    digits = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.concat(digits, F.date_format(ts, "-MM-dd HH:mm:ss"))


_MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
HEADER_TIME = r"^[0-9]{2}(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)([0-9]{2}|[0-9]{4}):[0-9]{2}:[0-9]{2}:[0-9]{2}$"


def header_timestamp(text: Column, this_year: Column | int | None = None) -> Column:
    """ddMMMyy:HH:mm:ss of a transport header; two digits mean a year of the hundred that end with this one."""
    now = F.year(F.current_date()) if this_year is None else F.lit(this_year) if isinstance(this_year, int) else this_year
    t = F.upper(F.trim(text))
    date = F.regexp_extract(t, r"^[^:]+", 0)
    clock = F.right(t, F.lit(8))
    yy = F.substring(date, 6, 4).try_cast("int")
    century = F.when(F.length(date) > 7, yy).otherwise(now - F.pmod(now - yy, F.lit(100)))
    month = ((F.instr(F.lit(_MONTHS), F.substring(date, 3, 3)) + 2) / 3).cast("int")
    made = F.concat(F.lpad(century.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.substring(date, 1, 2), F.lit(" "), clock)
    return F.when(t.rlike(HEADER_TIME), made.try_cast("timestamp_ntz"))


def header_text(ts: Column) -> Column:
    """Header timestamp text of a Dataset-JSON table; fractions of a second are dropped."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
