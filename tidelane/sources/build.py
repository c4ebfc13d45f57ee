"""From a feed folder to a network: normalise, encode, write with a version, load again."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import calendar, encode, normalise, routing
from tidelane.operators.network import walk_transfers
from tidelane.scan import dense_numbers
from tidelane.sources.derived import Network
from tidelane.sources.feed import locations_of, missing_files, table_of

#: Version of the written tables; others are not loaded.
SCHEMA_VERSION = 1

#: Days of service from the first one on.
DAYS = 35


@dataclass
class FeedTables:
    """The tables of one feed: meta is one row (schema_version, feed_id, first_day, last_day, status), warnings are in order, missing names the files that are not there."""

    meta: DataFrame
    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    trip_days: DataFrame
    stop_times: DataFrame
    groups: DataFrame
    members: DataFrame
    flex_trips: DataFrame
    rules: DataFrame
    agencies: DataFrame
    translations: DataFrame
    feed_info: DataFrame
    locations: DataFrame
    missing: DataFrame
    warnings: DataFrame


def _numbered(rows: DataFrame, id_: str) -> DataFrame:
    return dense_numbers(rows, [F.col(id_).try_cast("double").asc_nulls_last(), F.col(id_)], "position")


def feed_tables(raw: DataFrame, feed_id: str, first_day: str, days: int = DAYS) -> FeedTables:
    """All tables of a feed, from the raw rows of :func:`tidelane.sources.feed.read_raw`; ``first_day``: YYYY-MM-DD.

    A file that is missing is an empty table.  Every table reads its own files' part of ``raw``, which is parsed
    and stored already.  Booking rules come first, as stop times refer to them.
    """
    spark = raw.sparkSession
    own = raw.where(F.col("feed_id") == feed_id)
    of = lambda file, *columns: table_of(own, file, list(columns)).drop("feed_id")
    rule_fields = [*normalise.RULE_NUMBERS, *normalise.RULE_TIMES, *normalise.RULE_TEXTS]
    rules = normalise.booking_rules(of("booking_rules", "booking_rule_id", "booking_type", "prior_notice_duration_min", *rule_fields))
    stops = normalise.stops(of("stops", "stop_id", "stop_name", "stop_lat", "stop_lon"))
    routes = normalise.routes(of("routes", "route_id", "agency_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color").withColumnsRenamed({"route_color": "color", "route_text_color": "text_color"}))
    trips = normalise.projected(of("trips", "trip_id", "route_id", "service_id", "trip_headsign").withColumnRenamed("trip_headsign", "headsign"), ["trip_id", "route_id", "service_id", "headsign"], ["trip_id"])
    calendars = normalise.calendars(of("calendar", "service_id", *normalise.DAYS, "start_date", "end_date"))
    exceptions = normalise.calendar_dates(of("calendar_dates", "service_id", "date", "exception_type"))
    groups = normalise.location_groups(of("location_groups", "location_group_id", "location_group_name"))
    paired = normalise.logged_members(of("location_group_stops", "location_group_id", "stop_id"))
    members = normalise.kept(paired).select("location_group_id", "stop_id").distinct()
    agencies = normalise.agencies(of("agency", "agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone"))
    translations = normalise.translations(of("translations", *normalise.TRANSLATION))
    info = normalise.feed_info(table_of(own, "feed_info", list(normalise.FEED_INFO)), list(normalise.FEED_INFO)).withColumnsRenamed(normalise.FEED_INFO)
    texts = locations_of(own)
    locations = normalise.flex_locations(texts)
    names = {"start_pickup_drop_off_window": "start_window", "end_pickup_drop_off_window": "end_window", "pickup_booking_rule_id": "pickup_rule", "drop_off_booking_rule_id": "drop_off_rule"}
    raw_times = of("stop_times", "trip_id", "stop_sequence", "stop_id", "location_group_id", "location_id", "arrival_time", "departure_time", *names, "pickup_type", "drop_off_type", "timepoint").withColumnsRenamed(names)
    times = normalise.stop_times(raw_times, normalise.kept(rules))
    logged = {"booking_rules": rules, "locations": locations, "stops": stops, "routes": routes, "trips": trips, "calendar": calendars, "calendar_dates": exceptions, "location_groups": groups, "location_group_stops": paired, "stop_times": times}
    read = own.where("warning IS NOT NULL").select("file", "row_no", F.col("warning").alias("code"))
    read = read.unionByName(normalise.unreadable_locations(texts).select(F.lit("locations").alias("file"), F.lit(0).cast("long").alias("row_no"), "code"))
    warnings = normalise.ordered_warnings(read, logged)

    s, r, g = encode.stops(_numbered(normalise.kept(stops), "stop_id")), encode.routes(_numbered(normalise.kept(routes), "route_id")), _numbered(normalise.kept(groups), "location_group_id").select(F.col("position").cast("long").alias("grp"), "location_group_id", "name")
    t = encode.trips(_numbered(normalise.kept(trips), "trip_id"), r)
    b = encode.rules(_numbered(normalise.kept(rules), "booking_rule_id"))
    kept_times = normalise.kept(times)
    flex = encode.flex_trips(normalise.flex_pairs(kept_times), t, g, b)
    date = lambda c: F.to_date(F.col(c), "yyyyMMdd").alias(c)
    cal = normalise.kept(calendars).select("service_id", date("start_date"), date("end_date"), F.array(*normalise.DAYS).alias("days"))
    exc = normalise.kept(exceptions).select("service_id", date("date"), "exception_type")
    dates = calendar.service_dates(cal, exc, first_day, days).select("service_id", F.date_format("date", "yyyyMMdd").cast("int").alias("day"))
    last_day = F.date_add(F.lit(first_day).cast("date"), days - 1)
    status = F.when(F.count(F.lit(1)) > 0, "ok_with_warnings").otherwise("ok")
    day = lambda d: F.date_format(d, "yyyyMMdd").cast("int")
    meta = warnings.agg(status.alias("status")).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(feed_id).alias("feed_id"), day(F.lit(first_day).cast("date")).alias("first_day"), day(last_day).alias("last_day"), "status")
    plain = lambda df, *columns: normalise.kept(df).select("row_no", *columns)
    return FeedTables(
        meta, s, r, t, t.join(dates, "service_id").select("tid", "day"), encode.stop_times(kept_times, t, s), g, encode.members(members, g, s), flex, b,
        plain(agencies, "agency_id", "name", "url", "timezone", "lang", "phone"), plain(translations, *normalise.TRANSLATION), info.select(*normalise.FEED_INFO.values()),
        plain(locations, "location_id", "name", "geometry_type", "coordinates"), missing_files(own).select("file"), warnings,
    )


def _manifests(spark: SparkSession, path: str, feed_id: str):
    """The file system, the folder of a feed's manifests, and the numbers of those that are published."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{feed_id}/published")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return system, folder, sorted(int(n) for n in names if n.isdigit())


def write(tables: FeedTables, path: str, feed_id: str | None = None) -> int:
    """A new version of one feed under ``path``; its number.

    The tables go to a folder that no reader knows; when all are there a manifest with their place is
    published by a rename, which nobody sees half done.  A writer that fails leaves the version before
    as it was, readers stay on the version they opened, and other feeds are not touched.
    """
    spark = tables.meta.sparkSession
    feed_id = feed_id or tables.meta.first()["feed_id"]
    place = f"{path}/{feed_id}/data-{uuid.uuid4().hex}"
    for f in fields(tables):
        getattr(tables, f.name).write.parquet(f"{place}/{f.name}")
    system, folder, known = _manifests(spark, path, feed_id)
    version = (known[-1] if known else 0) + 1
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{feed_id}/draft-{uuid.uuid4().hex}")
    out = system.create(draft)
    out.write(bytearray(json.dumps({"place": place.rsplit("/", 1)[1], "schema_version": SCHEMA_VERSION}).encode()))
    out.close()
    system.mkdirs(folder)
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, str(version))
    if system.exists(target) or not system.rename(draft, target):
        raise RuntimeError(f"version {version} of {feed_id} has been published meanwhile")
    return version


def feeds(spark: SparkSession, path: str) -> list[str]:
    """The feeds that have a version under ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(n for n in names if _manifests(spark, path, n)[2])


def load(spark: SparkSession, path: str, feed_id: str | None = None, version: int | None = None) -> FeedTables:
    """The newest, or the given, version of a feed (by default of the only one); ValueError where there is none or its tables are of another schema version."""
    if feed_id is None:
        there = feeds(spark, path)
        if len(there) != 1:
            raise ValueError(f"which of the feeds {there} under {path}?")
        feed_id = there[0]
    _, folder, known = _manifests(spark, path, feed_id)
    version = version or (known[-1] if known else 0)
    if version not in known:
        raise ValueError(f"no version {version} of {feed_id} under {path}")
    manifest = json.loads(spark.read.text(f"{folder}/{version}", wholetext=True).first()[0])
    if manifest["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"tables of version {manifest['schema_version']} under {path}; this is version {SCHEMA_VERSION}")
    return FeedTables(*(spark.read.parquet(f"{path}/{feed_id}/{manifest['place']}/{f.name}") for f in fields(FeedTables)))


def forget(spark: SparkSession, path: str, feed_id: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions of a feed, manifests first; nobody should read them any more."""
    system, folder, known = _manifests(spark, path, feed_id)
    for version in known[:-keep]:
        manifest = json.loads(spark.read.text(f"{folder}/{version}", wholetext=True).first()[0])
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(version)), False)
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{feed_id}/{manifest['place']}"), True)


def network(tables: FeedTables, walk_m: float = 0.0) -> Network:
    """What routing reads, with footpaths of up to ``walk_m`` metres (none by default, as feeds bring none)."""
    calls = encode.by_pattern(encode.fixed_calls(tables.stop_times, tables.flex_trips), tables.trips)
    placed = tables.stops.where("lat <> 0 OR lon <> 0").select("sid", "lat", "lon")
    paths = walk_transfers(placed, walk_m) if walk_m else tables.stops.sparkSession.createDataFrame([], "a long, b long, metres double, seconds long")
    days = tables.trip_days.distinct()
    return Network(
        tables.stops.select("sid", F.lit(0).alias("nk"), "lat", "lon"), calls.select("rid", "seq", "sid").distinct(), tables.trips.select("tid", F.col("route").alias("rid")), calls, paths, tables.members,
        tables.flex_trips, days, days.join(tables.flex_trips.select("tid", "ft"), "tid").select("ft", "day"),
    )


def default_day(tables: FeedTables, requests: DataFrame) -> DataFrame:
    """``requests`` with ``day``: the feed's first day where a request names none."""
    first = tables.meta.select(F.col("first_day").alias("__first"))
    return requests.crossJoin(F.broadcast(first)).withColumn("day", F.coalesce("day", "__first")).drop("__first")


def smoke_check(tables: FeedTables) -> bool:
    """Whether the built network takes somebody somewhere by a flexible service on its first day with one.

    Asked is the way between the first two stops of a service's group at the start of its window, searched for the day before.
    """
    net, window = network(tables), F.struct("day", "tid")
    first = tables.trip_days.join(tables.flex_trips.select("tid", "grp", F.col("ws").alias("dep")), "tid").groupBy().agg(F.min_by(F.struct("day", "grp", "dep"), window).alias("x")).where("x IS NOT NULL").select("x.*")
    ends = tables.members.groupBy("grp").agg(F.slice(F.sort_array(F.collect_set("sid")), 1, 2).alias("s")).where("size(s) = 2")  # the stops of a group
    asked = first.join(ends, "grp").select(F.lit(0).cast("long").alias("query_id"), F.col("s")[0].alias("from_sid"), F.col("s")[1].alias("to_sid"), F.col("dep").cast("long").alias("dep"), "day", F.lit(False).alias("same_day"), F.lit(0).cast("long").alias("now"))
    asked = asked.withColumns({c: F.lit(None).cast("double") for c in ("from_lat", "from_lon", "to_lat", "to_lon")})
    return not routing.plan(net, asked, 1).where(F.exists("legs", lambda leg: leg["mode"] == "flex")).isEmpty()
