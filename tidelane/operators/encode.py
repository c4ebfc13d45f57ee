"""Normalised tables to the keyed tables of a network: surrogate keys, defaults, and what routing can run on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.operators.network import split_patterns

#: Route type where a feed names none.
BUS = 3


def stops(rows: DataFrame) -> DataFrame:
    """(sid, stop_id, name, lat, lon): a stop without a name shows its id, one without a position stands at 0, 0. ``rows``: position, stop_id, name, lat, lon."""
    return rows.select(F.col("position").cast("long").alias("sid"), "stop_id", F.coalesce("name", "stop_id").alias("name"), F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))


def routes(rows: DataFrame) -> DataFrame:
    """(route, route_id, short_name, long_name, route_type) with empty names and BUS for what is missing; ``rows``: position, route_id, ..."""
    return rows.select(F.col("position").cast("long").alias("route"), "route_id", F.coalesce("short_name", F.lit("")).alias("short_name"), F.coalesce("long_name", F.lit("")).alias("long_name"), F.coalesce("route_type", F.lit(BUS)).alias("route_type"))


def _keys(table: DataFrame, id_: str, key: str) -> DataFrame:
    """(id, key), of repeated ids the last."""
    return table.groupBy(id_).agg(F.max(key).alias(key))


def trips(rows: DataFrame, routes_: DataFrame) -> DataFrame:
    """(tid, trip_id, route, service_id, headsign): an unknown route counts as the first one; ``rows``: position, trip_id, route_id, service_id, headsign."""
    own = rows.join(_keys(routes_, "route_id", "route"), "route_id", "left")
    return own.select(F.col("position").cast("long").alias("tid"), "trip_id", F.coalesce("route", F.lit(0).cast("long")).alias("route"), "service_id", "headsign")


def stop_times(rows: DataFrame, trips_: DataFrame, stops_: DataFrame) -> DataFrame:
    """(tid, seq, sid, arr, dep, pickup, drop_off): places other than known stops are null; rows of unknown trips have none."""
    stop = F.when(F.col("place_kind") == "stop", F.col("place"))
    own = rows.join(_keys(trips_, "trip_id", "tid"), "trip_id").withColumn("stop_id", stop).join(_keys(stops_, "stop_id", "sid"), "stop_id", "left")
    return own.select("tid", "seq", "sid", F.col("arr").cast("long").alias("arr"), F.col("dep").cast("long").alias("dep"), "pickup", "drop_off")


def members(rows: DataFrame, groups: DataFrame, stops_: DataFrame) -> DataFrame:
    """(grp, sid): the stops of each group; what refers to nothing goes. ``rows``: location_group_id, stop_id; ``groups``: grp, location_group_id."""
    own = rows.join(_keys(groups, "location_group_id", "grp"), "location_group_id").join(_keys(stops_, "stop_id", "sid"), "stop_id")
    return own.select("grp", "sid").distinct()


def rules(rows: DataFrame) -> DataFrame:
    """(rule, booking_rule_id, kind, minutes, last_day, last_time, phone, message, info_url); ``rows``: position and the fields of a rule, absent ones null."""
    have = lambda c, kind: (F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    return rows.select(F.col("position").cast("long").alias("rule"), "booking_rule_id", F.col("booking_type").alias("kind"), "minutes", have("last_day", "int"), have("last_time", "int"), have("phone", "string"), have("message", "string"), have("info_url", "string"))


def flex_trips(pairs: DataFrame, trips_: DataFrame, groups: DataFrame, rules_: DataFrame) -> DataFrame:
    """(ft, tid, grp, ws, we, pickup_rule, drop_off_rule, kind, minutes, last_day, last_time): the pick-up rule decides about booking. ``pairs``: as of ``flex_pairs``."""
    key = _keys(rules_, "booking_rule_id", "rule")
    side = lambda name: key.select(F.col("booking_rule_id").alias(f"__{name}"), F.col("rule").alias(f"__{name}_rule"))
    own = pairs.join(_keys(trips_, "trip_id", "tid"), "trip_id").join(_keys(groups, "location_group_id", "grp"), F.col("location_group_id") == pairs["grp"]).drop(pairs["grp"])
    own = own.join(side("up"), F.col("pickup_rule") == F.col("__up"), "left").join(side("down"), F.col("drop_off_rule") == F.col("__down"), "left")
    booked = rules_.select(F.col("rule").alias("__up_rule"), "kind", "minutes", "last_day", "last_time")
    own = own.join(booked, "__up_rule", "left")
    return own.select(F.col("tid").alias("ft"), "tid", "grp", "ws", "we", F.col("__up_rule").alias("pickup_rule"), F.col("__down_rule").alias("drop_off_rule"), "kind", "minutes", "last_day", "last_time")


def fixed_calls(times: DataFrame, flex: DataFrame) -> DataFrame:
    """(tid, seq, sid, arr, dep) of trips on a line: calls at stops with a time (either stands in for the other), of trips that are not flexible and have two calls."""
    own = times.where("sid IS NOT NULL AND (arr IS NOT NULL OR dep IS NOT NULL)").join(flex.select("tid").distinct(), "tid", "left_anti")
    own = own.select("tid", "seq", "sid", F.coalesce("arr", "dep").alias("arr"), F.coalesce("dep", "arr").alias("dep"))
    return own.join(own.groupBy("tid").count().where("count > 1").select("tid"), "tid", "left_semi")


def by_pattern(calls: DataFrame, trips_: DataFrame) -> DataFrame:
    """``calls`` with ``rid``, a number for trips of one route with the same stops, and ``seq`` counted from 1 along the way."""
    from pyspark.sql import Window

    along = F.row_number().over(Window.partitionBy("tid").orderBy("seq", "arr"))
    own = calls.withColumn("seq", along).join(trips_.select("tid", F.col("route").alias("rid")), "tid")
    return own.drop("rid").join(split_patterns(own).select("tid", F.xxhash64("pattern").alias("rid")), "tid").select("tid", "rid", "seq", "sid", "arr", "dep")
