"""Shareable links to a search: ``?from=..&fromLabel=..&to=..&toLabel=..&when=..`` and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"-?[0-9]+(?:\.[0-9]+)?"


def place(stop: Column, lat: Column, lon: Column) -> Column:
    """A stop by its id, any other place by its position in five decimals."""
    return F.when(stop.isNotNull(), F.concat(F.lit("stop:"), stop)).otherwise(F.format_string("coord:%.5f,%.5f", lat, lon))


def departure(day: Column, seconds: Column) -> Column:
    """``now`` where there is no day."""
    return F.when(day.isNull(), "now").otherwise(F.format_string("%08d-%02d%02d", day, F.floor(seconds / 3600), F.floor(seconds / 60) % 60))


def link(**values: Column) -> Column:
    """A query string of the given parameters, in their order; the names of labels end in Label."""
    return F.concat(F.lit("?"), F.concat_ws("&", *(F.concat(F.lit(f"{name}="), F.url_encode(v)) for name, v in values.items())))


def parameter(search: Column, name: str) -> Column:
    """The first value of a parameter, decoded; null if it is missing or can't be decoded."""
    found = F.regexp_substr(search, F.lit(f"(?<=[?&]){name}=[^&#]*"))
    return F.try_url_decode(F.substr(found, F.lit(len(name) + 2)))


def read_place(value: Column, label: Column) -> Column:
    """struct(stop, lat, lon, label), null if invalid; a stop without a label is shown by its id."""
    stop = F.nullif(F.regexp_extract(value, r"(?s)^stop:(.+)$", 1), F.lit(""))
    part = lambda k: F.nullif(F.regexp_extract(value, f"^coord:({_DECIMAL}),({_DECIMAL})$", k), F.lit("")).cast("double")
    made = F.struct(stop.alias("stop"), part(1).alias("lat"), part(2).alias("lon"), F.coalesce(label, stop).alias("label"))
    return F.when(stop.isNotNull() | part(1).isNotNull(), made)


def read_departure(value: Column) -> Column:
    """struct(day, seconds), both null for ``now``; null if invalid."""
    digits = lambda k: F.nullif(F.regexp_extract(value, "^([0-9]{8})-([0-9]{2})([0-9]{2})$", k), F.lit("")).cast("int")
    made = F.struct(digits(1).alias("day"), (digits(2) * 3600 + digits(3) * 60).alias("seconds"))
    return F.when((value == "now") | digits(1).isNotNull(), made)


def read(search: Column) -> Column:
    """struct(origin, goal, departure) of a link; null if a part is missing or invalid."""
    origin, goal = (read_place(parameter(search, n), parameter(search, f"{n}Label")) for n in ("from", "to"))
    when = read_departure(parameter(search, "when"))
    made = F.struct(origin.alias("origin"), goal.alias("goal"), when.alias("departure"))
    return F.when(origin.isNotNull() & goal.isNotNull() & when.isNotNull(), made)
