"""Booking deadlines of pre-booked services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelane.functions.clock import DAY, clock_text, duration_text, hhmm


def deadline(kind: Column, minutes: Column, last_day: Column, last_time: Column, board: Column) -> Column:
    """Seconds of the service day until which a boarding can be booked; null without a deadline or if it can't be known."""
    return F.when(kind == 1, board - minutes * 60).when(kind == 2, last_time - F.coalesce(last_day, F.lit(0)) * DAY)


def feasible(due: Column, same_day: Column, now: Column) -> Column:
    """False only where the search is on the service day and the deadline has passed; the very second still counts."""
    return ~F.coalesce(same_day & (now > due), F.lit(False))


def notice_kind(kind: Column, minutes: Column, last_day: Column) -> Column:
    return F.when(kind == 0, "real_time").when((kind == 1) & minutes.isNotNull(), "same_day_minutes_before").when((kind == 2) & last_day.isNotNull(), "prior_days").otherwise("unknown")


def display(due: Column, same_day: Column, now: Column) -> Column:
    """How a deadline is shown."""
    left = due - now
    return F.when(due.isNull(), "unknown").when(~same_day, "other_day").when(left <= 0, "passed").when(left < 600, "soon").otherwise("ok")


def guidance(message: Column, phone: Column, due_text: Column) -> Column:
    """The operator's message as it is, else a sentence from the rule."""
    made = F.concat(F.lit("Please book"), F.coalesce(F.concat(F.lit(" by "), due_text), F.lit("")), F.coalesce(F.concat(F.lit(" at "), phone), F.lit("")), F.lit("."))
    return F.coalesce(message, made)


def reason(kind: Column, minutes: Column, last_day: Column, last_time: Column, due: Column, same_day: Column, now: Column) -> Column:
    """Why a boarding can't be booked, or why its deadline says nothing; null if there is nothing to say."""
    unknown = F.when((kind == 1) & minutes.isNull(), "minutes_missing").when((kind == 2) & (last_day.isNull() | last_time.isNull()), "last_time_missing")
    known = F.when(due.isNull(), None).when(~same_day, "other_day_deadline_only").when(now > due, F.concat(F.lit("deadline_passed "), hhmm(due)))
    return F.coalesce(unknown, known)


def requirement(kind: Column, minutes: Column) -> Column:
    """What a service asks for, in a sentence."""
    return (
        F.when(kind == 0, "No booking needed.").when((kind == 1) & minutes.isNotNull(), F.concat(F.lit("Book at least "), minutes.cast("string"), F.lit(" minutes before boarding."))).when(kind == 2, "Book by the day before.").otherwise("See the booking rules.")
    )


def deadline_text(due: Column, day: Column, same_day: Column, now: Column) -> Column:
    """How a deadline reads: ``day`` is the date of service (YYYYMMDD); minutes that are left are rounded down."""
    left = due - now
    by = F.concat(F.lit("Book by "), clock_text(due))
    date = F.concat((F.floor(day / 100) % 100).cast("string"), F.lit("/"), (day % 100).cast("string"))
    return (
        F.when(due.isNull(), "Booking needed, ask for the deadline").when(~same_day, F.concat(F.lit("Book by "), date, F.lit(" "), clock_text(due))).when(left <= 0, "Too late to book")
        .when(left < 60, F.concat(by, F.lit(" (closing now)"))).otherwise(F.concat(by, F.lit(" ("), duration_text(F.floor(left / 60) * 60), F.lit(" left)")))
    )


def request_script(start: Column, goal: Column, day: Column, seconds: Column) -> Column:
    """What to say on the phone: weekday, part of the day, time and places."""
    hour, minute = F.floor(seconds / 3600) % 24, F.floor(seconds % 3600 / 60)
    part = F.when(hour.between(5, 10), "morning").when(hour.between(11, 15), "midday").when(hour.between(16, 18), "evening").when(hour.between(19, 23), "night").otherwise("early morning")
    time = F.concat(hour.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return F.concat(F.lit("I would like to ride on "), _weekday(day), F.lit(" "), part, F.lit(" at "), time, F.lit(" from "), start, F.lit(" to "), goal, F.lit("."))


def _weekday(day: Column) -> Column:
    names = F.array(*(F.lit(d) for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")))
    return names[F.weekday(F.to_date(day.cast("string"), "yyyyMMdd"))]


def date_label(day: Column) -> Column:
    """``M/D (Weekday)`` of a service date YYYYMMDD."""
    return F.concat((F.floor(day / 100) % 100).cast("string"), F.lit("/"), (day % 100).cast("string"), F.lit(" ("), F.left(_weekday(day), F.lit(3)), F.lit(")"))
