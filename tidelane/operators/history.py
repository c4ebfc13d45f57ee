"""Saved searches: the newest of each kind, changes to them, recent stops, and tolerant reading of stored text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Searches that are kept for a user; stops that are offered.
KEPT, OFFERED = 20, 5

_PLACE = "struct<kind: string, stopId: string, name: string, lat: double, lon: double, label: string>"
_RECORDS = f"array<struct<`from`: {_PLACE}, to: {_PLACE}, `when`: struct<type: string>, savedAt: double>>"


def place_key(place: Column) -> Column:
    """A stop by its id, any other place by its position in four decimals."""
    return F.when(place["kind"] == "stop", F.concat(F.lit("stop:"), place["stopId"])).otherwise(F.format_string("coord:%.4f,%.4f", place["lat"], place["lon"]))


def _whole(place: Column) -> Column:
    stop = (place["kind"] == "stop") & place["stopId"].isNotNull() & place["name"].isNotNull()
    return F.coalesce(stop | ((place["kind"] == "coord") & place["lat"].isNotNull() & place["lon"].isNotNull() & place["label"].isNotNull()), F.lit(False))


def stored(texts: DataFrame) -> DataFrame:
    """(user_id, n, key, start, goal, saved_at) of stored JSON lists (user_id, text); what can't be read, or lacks a part, is left out."""
    each = texts.select("user_id", F.posexplode(F.from_json("text", _RECORDS)).alias("n", "r"))
    good = _whole(F.col("r.from")) & _whole(F.col("r.to")) & F.col("r.when").isNotNull() & F.col("r.savedAt").isNotNull()
    key = F.concat(place_key(F.col("r.from")), F.lit(">"), place_key(F.col("r.to")), F.lit("@"), F.coalesce("r.when.type", F.lit("")))
    return each.where(good).select("user_id", "n", key.alias("key"), F.col("r.from").alias("start"), F.col("r.to").alias("goal"), F.col("r.savedAt").alias("saved_at"))


def newest(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """The newest search of each user and key, at most ``kept``, ranked; ``records``: user_id, key, saved_at and a tie-breaking n (the lower the newer)."""
    order = [F.desc("saved_at"), "n"]
    once = records.withColumn("__k", F.row_number().over(Window.partitionBy("user_id", "key").orderBy(*order))).where("__k = 1").drop("__k")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("rank") <= kept)


def changed(records: DataFrame, saved: DataFrame, deleted: DataFrame, kept: int = KEPT) -> DataFrame:
    """The records after some are saved (as the newest) and some are deleted (user_id, key)."""
    first = saved.withColumn("n", F.lit(-1))
    return newest(records.unionByName(first), kept).join(deleted.select("user_id", "key").distinct(), ["user_id", "key"], "left_anti")


def recent_stops(records: DataFrame, limit: int = OFFERED) -> DataFrame:
    """(user_id, stop_id, name, rank): the stops of the newest searches, each once, the start before the goal."""
    ranked = newest(records, 1 << 30)
    ends = ranked.select("user_id", F.posexplode(F.array("start", "goal")).alias("end", "p"), "rank").where("p.kind = 'stop'")
    once = ends.groupBy("user_id", F.col("p.stopId").alias("stop_id")).agg(F.min(F.struct("rank", "end", F.col("p.name").alias("name"))).alias("x"))
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("x.rank", "x.end"))
    return once.withColumn("place", at).where(F.col("place") <= limit).select("user_id", "stop_id", F.col("x.name").alias("name"), F.col("place").alias("rank"))


#: Sizes of text that a display offers, the first by default.
SIZES = ["standard", "large", "xlarge"]


def settings(texts: DataFrame) -> DataFrame:
    """(user_id, font_scale, high_contrast) of stored JSON texts (user_id, text): the defaults where a text is missing, can't be read or has a part that is none."""
    value = F.try_parse_json("text")
    scale, contrast = (F.try_variant_get(value, f"$.{c}", "variant") for c in ("fontScale", "highContrast"))
    whole = (F.schema_of_variant(scale) == "STRING") & F.try_variant_get(value, "$.fontScale", "string").isin(SIZES) & (F.schema_of_variant(contrast) == "BOOLEAN")
    good = F.coalesce(whole, F.lit(False))
    return texts.select("user_id", F.when(good, F.try_variant_get(value, "$.fontScale", "string")).otherwise(SIZES[0]).alias("font_scale"), F.when(good, F.try_variant_get(value, "$.highContrast", "boolean")).otherwise(False).alias("high_contrast"))
