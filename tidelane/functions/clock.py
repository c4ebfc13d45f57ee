"""Service-day times: seconds since midnight, which may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
_TIME = r"^([0-9]{1,3}):([0-5][0-9]):([0-5][0-9])$"


def gtfs_seconds(text: Column) -> Column:
    """``H:MM:SS`` up to ``HHH:MM:SS`` as seconds; anything else is null."""
    # Minutes and seconds have two digits each, so one match tells where all parts are.
    hours, minutes, seconds = (c.cast("int") for c in (F.substring_index(text, ":", 1), F.substring(text, -5, 2), F.substring(text, -2, 2)))
    return F.when(text.rlike(_TIME), hours * 3600 + minutes * 60 + seconds)


def hhmm(seconds: Column) -> Column:
    """``HH:MM`` without wrapping at midnight."""
    whole = F.floor(seconds / 60).cast("int")
    two = lambda c: F.when(F.length(c.cast("string")) < 2, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat(two(F.floor(whole / 60).cast("int")), F.lit(":"), two(F.pmod(whole, F.lit(60))))


def clock_text(seconds: Column, next_day: str = "+1 ") -> Column:
    """``HH:MM`` of the day, with a mark from the next day on."""
    return F.concat(F.when(seconds >= DAY, F.lit(next_day)).otherwise(F.lit("")), hhmm(F.pmod(seconds, F.lit(DAY))))


def duration_text(seconds: Column) -> Column:
    """Rounded minutes, one at least, as ``N min`` or ``H h M min``."""
    m = F.greatest(F.round(seconds / 60).cast("int"), F.lit(1))
    h = F.floor(m / 60).cast("int")
    rest = F.pmod(m, F.lit(60))
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(h.cast("string"), F.lit(" h"))).otherwise(F.concat(h.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min")))


def departure_parts(text: Column) -> tuple[Column, Column]:
    """(service date YYYYMMDD as int, seconds) at UTC+9 of an ISO instant; null without an offset or if unreadable."""
    stated = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    local = F.when(stated, F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(text, "(T[0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")), F.current_timezone()), "+09:00"))
    return F.date_format(local, "yyyyMMdd").cast("int"), F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def date_input(text: Column) -> Column:
    """``YYYY-MM-DD`` as YYYYMMDD; anything else is null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.replace(text, F.lit("-"), F.lit("")).cast("int"))


def time_input(text: Column) -> Column:
    """``HH:MM`` as seconds; anything else is null."""
    return F.when(text.rlike(r"^[0-9]{2}:[0-9]{2}$"), F.left(text, F.lit(2)).cast("int") * 3600 + F.right(text, F.lit(2)).cast("int") * 60)


def to_date_input(day: Column) -> Column:
    return F.concat_ws("-", F.floor(day / 10000).cast("string"), F.lpad((F.floor(day / 100) % 100).cast("string"), 2, "0"), F.lpad((day % 100).cast("string"), 2, "0"))


def to_time_input(seconds: Column) -> Column:
    """``HH:MM`` of the day."""
    return hhmm(F.pmod(seconds, F.lit(DAY)))


def walk_amount(metres: Column) -> Column:
    """How much there is to walk: little up to 300 m, some up to 800 m, else much."""
    return F.when(metres <= 300, "little").when(metres <= 800, "some").otherwise("much")
