"""Cell cleaning, names and phone numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"[\s 　﻿]+"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean(cell: Column) -> Column:
    """Trimmed of every kind of blank; empty is null."""
    return F.nullif(F.regexp_replace(cell, f"^{_BLANK}|{_BLANK}$", ""), F.lit(""))


def number(cell: Column) -> Column:
    """A finite decimal number, else null."""
    own = clean(cell)
    value = F.when(own.rlike(_NUMBER), own).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def flag(cell: Column) -> Column:
    return F.coalesce(clean(cell) == "1", F.lit(False))


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    return "".join(chr(ord(c) + 0x60) if 0x3041 <= ord(c) <= 0x3096 else c for c in unicodedata.normalize("NFKC", text).lower().strip())


def _fold_all(names: pd.Series) -> pd.Series:
    return names.map(_fold)


def match_name(name: Column) -> Column:
    """A name as it is compared: compatibility forms folded, lower case, hiragana as katakana.

    Plain ASCII stays in the JVM's functions; only other names go through Python.
    """
    ascii_only = name.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.lower(F.trim(name))).otherwise(F.pandas_udf(_fold_all, T.StringType())(F.when(~ascii_only, name)))


def phone_text(phone: Column) -> Column:
    """Eleven digits as 3-4-4, ten as 3-3-4, anything else unchanged."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    cut = lambda *ends: F.concat_ws("-", *(F.substring(d, a, n) for a, n in ends))
    return F.when(F.length(d) == 11, cut((1, 3), (4, 4), (8, 4))).when(F.length(d) == 10, cut((1, 3), (4, 3), (7, 4))).otherwise(phone)


def phone_link(phone: Column) -> Column:
    """``tel:`` and the digits."""
    return F.concat(F.lit("tel:"), F.regexp_replace(phone, "[^0-9]", ""))


def route_name(short: Column, long: Column, id_: Column) -> Column:
    """The short name, else the long one, else the id; empty names don't count."""
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(long, F.lit("")), id_)


def service_name(long: Column, short: Column, group: Column) -> Column:
    """The route's long name, else its short one, else the group's; an empty name counts."""
    return F.coalesce(long, short, group)
