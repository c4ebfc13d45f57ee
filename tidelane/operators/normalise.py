"""Raw text rows to typed tables, with the reasons for dropped rows and doubtful values.

Each function takes raw rows (text columns, ``row_no``) and returns all of them typed, with
``drop_reason`` (null: kept) and ``warnings`` (codes); :func:`kept` and :func:`warning_log`
split these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.clock import DAY, gtfs_seconds
from tidelane.functions.text import clean, flag, number
from tidelane.scan import dense_numbers

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull())


def _done(df: DataFrame, drop: Column, *warnings: tuple[Column, str]) -> DataFrame:
    return df.withColumn("drop_reason", F.when(drop, "row_dropped")).withColumn("warnings", F.when(drop, F.array(F.lit("row_dropped"))).otherwise(_codes(*warnings) if warnings else F.array().cast("array<string>")))


def kept(df: DataFrame) -> DataFrame:
    return df.where("drop_reason IS NULL").drop("drop_reason", "warnings")


def warning_log(file: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(file).alias("file"), "row_no", F.explode("warnings").alias("code"))


#: The order in which a feed's files are read, and so that of their warnings.
READ_ORDER = ["booking_rules", "locations", "agency", "stops", "routes", "trips", "calendar", "calendar_dates", "location_groups", "location_group_stops", "stop_times", "translations", "feed_info"]


def ordered_warnings(read: DataFrame, logged: dict[str, DataFrame]) -> DataFrame:
    """(no from 1, file, row_no, code): what reading the files noted (``read``: file, row_no, code) and what their rows (``logged``) carry, file by file, then row by row."""
    at = F.array_position(F.array(*(F.lit(f) for f in READ_ORDER)), F.col("file"))
    every = read.select("file", "row_no", "code", F.lit(0).alias("stage"), F.lit(0).alias("k"))
    for file, df in logged.items():
        every = every.unionByName(df.select(F.lit(file).alias("file"), "row_no", F.posexplode("warnings").alias("k", "code"), F.lit(1).alias("stage")))
    order = [F.when(at > 0, at).otherwise(len(READ_ORDER) + 1), F.col("file"), F.col("stage"), F.col("row_no"), F.col("k"), F.col("code")]
    return dense_numbers(every, order, "no", start=1).select("no", "file", "row_no", "code")


def agencies(raw: DataFrame) -> DataFrame:
    """Agencies, cleaned; none is dropped."""
    names = {"agency_name": "name", "agency_url": "url", "agency_timezone": "timezone", "agency_lang": "lang", "agency_phone": "phone"}
    return projected(raw.withColumnsRenamed(names), ["agency_id", *names.values()], [])


#: Columns of the translations file, and of the feed file by the names they get.
TRANSLATION = ["table_name", "field_name", "language", "translation", "record_id", "record_sub_id", "field_value"]
FEED_INFO = {"feed_publisher_name": "publisher_name", "feed_publisher_url": "publisher_url", "feed_lang": "lang", "feed_start_date": "start_date", "feed_end_date": "end_date", "feed_version": "version", "feed_contact_email": "contact_email"}


def translations(raw: DataFrame) -> DataFrame:
    """Translations, cleaned; none is dropped."""
    return projected(raw, TRANSLATION, [])


def location_groups(raw: DataFrame) -> DataFrame:
    return projected(raw.withColumnRenamed("location_group_name", "name"), ["location_group_id", "name"], ["location_group_id"])


def projected(raw: DataFrame, columns: list[str], required: list[str]) -> DataFrame:
    """Cleaned text columns; rows without the required ones are dropped (agencies, routes, trips, groups, translations)."""
    own = raw.withColumns({c: clean(F.col(c)) for c in columns})
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return _done(own, missing)


def stops(raw: DataFrame) -> DataFrame:
    lat = number(F.col("stop_lat"))
    bad = clean(F.col("stop_lat")).isNotNull() & lat.isNull()
    own = raw.withColumn("__bad", bad).withColumns({"stop_id": clean(F.col("stop_id")), "name": clean(F.col("stop_name")), "lat": lat, "lon": number(F.col("stop_lon"))})
    return _done(own, F.col("stop_id").isNull(), (F.col("__bad"), "invalid_value")).drop("__bad", "stop_name", "stop_lat", "stop_lon")


def calendars(raw: DataFrame) -> DataFrame:
    own = raw.withColumns({"service_id": clean(F.col("service_id")), **{d: flag(F.col(d)) for d in DAYS}, "start_date": clean(F.col("start_date")), "end_date": clean(F.col("end_date"))})
    return _done(own, F.col("service_id").isNull())


def calendar_dates(raw: DataFrame) -> DataFrame:
    own = raw.withColumns({"service_id": clean(F.col("service_id")), "date": clean(F.col("date")), "exception_type": number(F.col("exception_type")).cast("int")})
    return _done(own, F.col("service_id").isNull() | F.col("date").isNull() | ~F.coalesce(F.col("exception_type").isin(1, 2), F.lit(False)))


#: Fields of a booking rule beside its id and type, by what they hold.
RULE_NUMBERS = {"prior_notice_duration_max": "minutes_max", "prior_notice_last_day": "last_day", "prior_notice_start_day": "start_day"}
RULE_TIMES = {"prior_notice_last_time": "last_time", "prior_notice_start_time": "start_time"}
RULE_TEXTS = {"prior_notice_service_id": "notice_service_id", "message": "message", "pickup_message": "pickup_message", "drop_off_message": "drop_off_message", "phone_number": "phone", "info_url": "info_url", "booking_url": "booking_url"}


def booking_rules(raw: DataFrame) -> DataFrame:
    """The last of rows with one id holds; a type 1 rule without minutes is kept with a warning.

    Of the other fields of a rule those that ``raw`` has are typed as well.
    """
    own = raw.withColumns({"booking_rule_id": clean(F.col("booking_rule_id")), "booking_type": number(F.col("booking_type")).cast("int"), "minutes": number(F.col("prior_notice_duration_min")).cast("int")})
    for names, typed in ((RULE_NUMBERS, lambda c: number(c).cast("int")), (RULE_TIMES, lambda c: gtfs_seconds(clean(c))), (RULE_TEXTS, clean)):
        for source, name in names.items():
            if source in raw.columns:
                own = own.withColumn(f"__{name}", typed(F.col(source))).drop(source).withColumnRenamed(f"__{name}", name)
    drop = F.col("booking_rule_id").isNull() | ~F.coalesce(F.col("booking_type").isin(0, 1, 2), F.lit(False))
    done = _done(own, drop, ((F.col("booking_type") == 1) & F.col("minutes").isNull(), "spec_violation")).drop("prior_notice_duration_min")
    last = F.row_number().over(Window.partitionBy("booking_rule_id", F.col("drop_reason").isNull()).orderBy(F.desc("row_no")))
    return done.withColumn("__k", last).withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.col("__k") > 1), "replaced").otherwise(F.col("drop_reason"))).drop("__k")


def routes(raw: DataFrame) -> DataFrame:
    """Route names, agency, type and colours; a type that is no number is null."""
    own = raw.withColumns({**{c: clean(F.col(c)) for c in ("route_id", "agency_id", "color", "text_color")}, "short_name": clean(F.col("route_short_name")), "long_name": clean(F.col("route_long_name")), "route_type": number(F.col("route_type")).cast("int")})
    return _done(own, F.col("route_id").isNull()).drop("route_short_name", "route_long_name")


def feed_info(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Of each feed its first row, cleaned; ``raw``: feed_id, row_no and ``columns``."""
    first = raw.groupBy("feed_id").agg(F.min_by(F.struct(*columns), "row_no").alias("x"))
    return first.select("feed_id", *(clean(F.col("x").getField(c)).alias(c) for c in columns))


def logged_members(raw: DataFrame) -> DataFrame:
    return projected(raw, ["location_group_id", "stop_id"], ["location_group_id", "stop_id"])


def group_members(raw: DataFrame) -> DataFrame:
    own = kept(logged_members(raw))
    return own.select("location_group_id", "stop_id").distinct()


def stop_times(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """Place, times, window, types and rules of each row; ``rules``: booking_rule_id.

    ``raw`` may have drop_off_rule and timepoint (0 or 1, anything else is null).
    """
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("drop_off_rule", "timepoint") if c not in raw.columns})
    text = {c: clean(F.col(c)) for c in ("trip_id", "stop_id", "location_group_id", "location_id", "start_window", "end_window", "arrival_time", "departure_time", "pickup_type", "drop_off_type", "pickup_rule", "drop_off_rule", "stop_sequence")}
    own = raw.withColumns(text)
    places = sum((F.col(c).isNotNull().cast("int") for c in ("stop_id", "location_group_id", "location_id")), F.lit(0))
    kind = F.when(F.col("stop_id").isNotNull(), "stop").when(F.col("location_group_id").isNotNull(), "group").when(F.col("location_id").isNotNull(), "location").otherwise("unresolved")
    start, end, arr, dep = (gtfs_seconds(F.col(c)) for c in ("start_window", "end_window", "arrival_time", "departure_time"))
    own = own.withColumns({"n_places": places, "place_kind": kind, "place": F.coalesce("stop_id", "location_group_id", "location_id"), "ws": start, "we": end, "arr": arr, "dep": dep})
    half = F.col("ws").isNull() != F.col("we").isNull()
    none = F.col("arr").isNull() & F.col("dep").isNull() & (F.col("ws").isNull() | F.col("we").isNull())
    own = own.withColumns({"half": half, "w0": F.when(none, 0).when(~half, F.col("ws")), "w1": F.when(none, DAY).when(~half, F.col("we"))})
    window = F.col("w0").isNotNull() & F.col("arr").isNull()
    typed = lambda c: F.when(F.col(c).rlike("^[0-3]$"), F.col(c).cast("int"))
    wrong = lambda c: F.col(c).isNotNull() & ~F.col(c).rlike("^[0-3]$")
    own = own.withColumn("window_row", window)
    other = F.when(F.col("window_row"), 2).otherwise(0)
    # Rows without a trip are dropped in any case: they are counted as they come, not as one trip.
    trip = F.coalesce("trip_id", F.concat(F.lit("\0"), F.col("row_no").cast("string")))
    occurrence = F.when(F.col("trip_id").isNotNull(), F.row_number().over(Window.partitionBy(trip).orderBy("row_no")))
    known = rules.select("booking_rule_id").distinct()
    own = own.join(known.select(F.col("booking_rule_id").alias("__rule")), F.col("pickup_rule") == F.col("__rule"), "left").join(known.select(F.col("booking_rule_id").alias("__drop")), F.col("drop_off_rule") == F.col("__drop"), "left")
    own = own.withColumns({"pickup": typed("pickup_type"), "drop_off": typed("drop_off_type"), "seq": F.coalesce(number(F.col("stop_sequence")).cast("int"), occurrence)})
    done = _done(
        own, F.col("trip_id").isNull(), (F.col("n_places") > 1, "spec_violation"), (F.col("n_places") == 0, "unresolved_location"), (F.col("half"), "spec_violation"),
        (number(F.col("stop_sequence")).isNull(), "invalid_value"), (wrong("pickup_type") | wrong("drop_off_type"), "invalid_value"),
        (F.col("window_row") & (F.coalesce(F.col("pickup").isin(0, 3), F.lit(False)) | F.coalesce(F.col("drop_off") == 0, F.lit(False))), "spec_violation"),
        (F.col("pickup_rule").isNotNull() & F.col("__rule").isNull(), "foreign_key_mismatch"), (F.col("drop_off_rule").isNotNull() & F.col("__drop").isNull(), "foreign_key_mismatch"),
    )
    point = number(F.col("timepoint"))
    return done.select(
        "row_no", "trip_id", "seq", "place_kind", "place", "arr", "dep", "w0", "w1", F.coalesce("pickup", other).alias("pickup"), F.coalesce("drop_off", other).alias("drop_off"), F.col("__rule").alias("rule"), F.col("__drop").alias("drop_rule"),
        F.when(point.isin(0, 1), point.cast("int")).alias("timepoint"), "drop_reason", "warnings"
    )


def role(pickup: Column, drop_off: Column) -> Column:
    """What a row of a flexible trip allows; type 1 forbids."""
    return F.when((pickup == 1) & (drop_off == 1), "neither").when(drop_off == 1, "pickup_only").when(pickup == 1, "dropoff_only").otherwise("both")


def flex_pairs(rows: DataFrame) -> DataFrame:
    """Per trip its first pickup-only and first drop-off-only row: (trip_id, grp, ws, we, pickup_rule, drop_off_rule)."""
    r = role(F.col("pickup"), F.col("drop_off"))
    up = F.min_by(F.struct("place_kind", "place", "w0", "w1", "rule"), F.when(r == "pickup_only", F.col("row_no")))
    down = F.min_by(F.struct(F.col("drop_rule").alias("rule")), F.when(r == "dropoff_only", F.col("row_no")))
    pairs = rows.groupBy("trip_id").agg(up.alias("u"), down.alias("d"), F.count(F.when(r == "pickup_only", 1)).alias("nu"), F.count(F.when(r == "dropoff_only", 1)).alias("nd"))
    pairs = pairs.where("nu > 0 AND nd > 0 AND u.place_kind = 'group' AND u.w0 IS NOT NULL")
    return pairs.select("trip_id", F.col("u.place").alias("grp"), F.col("u.w0").alias("ws"), F.col("u.w1").alias("we"), F.col("u.rule").alias("pickup_rule"), F.col("d.rule").alias("drop_off_rule"))


_FEATURES = "type string, features array<struct<id: string, properties: struct<stop_name: string>, geometry: struct<type: string, coordinates: string>>>"


def _collection(text: Column) -> tuple[Column, Column]:
    """(features, readable) of a GeoJSON text."""
    own = F.from_json(text, _FEATURES)
    good = F.try_parse_json(text).isNotNull() & (own["type"] == "FeatureCollection") & own["features"].isNotNull()
    return own["features"], F.coalesce(good, F.lit(False))


def flex_locations(files: DataFrame) -> DataFrame:
    """(feed, row_no, location_id, name, geometry_type, coordinates as JSON) of the features; ``files``: feed, text.

    Features without an id, and those that are no (multi)polygons, are dropped.
    """
    features, readable = _collection(F.col("text"))
    each = files.where(readable).select("feed", F.posexplode(features).alias("k", "f"))
    own = each.select("feed", (F.col("k") + 1).alias("row_no"), F.col("f.id").alias("location_id"), F.col("f.properties.stop_name").alias("name"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))
    shape = F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False))
    reason = F.when(F.col("location_id").isNull(), "row_dropped").when(~shape, "invalid_value")
    return own.withColumn("drop_reason", reason).withColumn("warnings", F.when(reason.isNotNull(), F.array(reason)).otherwise(F.array().cast("array<string>")))


def unreadable_locations(files: DataFrame) -> DataFrame:
    """(feed, code) of the files that are ignored whole: no JSON, or no feature collection."""
    return files.where(~_collection(F.col("text"))[1]).select("feed", F.lit("invalid_value").alias("code"))


def surrogate_keys(rows: DataFrame, feed: str, key: str) -> DataFrame:
    """``rows`` with ``position`` within their feed: numeric ids by value, then all others by text.

    Numbers over the ranges of a sort by feed and id, less each feed's first one.
    """
    order = [F.col(feed), F.col(key).try_cast("double").asc_nulls_last(), F.col(key)]
    numbered = dense_numbers(rows, order, "position")
    first = numbered.groupBy(F.col(feed).alias("__of")).agg(F.min("position").alias("__first"))
    joined = numbered.join(first, F.col(feed).eqNullSafe(F.col("__of")))
    return joined.select(*rows.columns, (F.col("position") - F.col("__first")).alias("position"))


def feed_status(feeds: DataFrame, warnings: DataFrame) -> DataFrame:
    """(feed, status): ``ok_with_warnings`` where a warning was logged, else ``ok``."""
    noted = warnings.select("feed").distinct().withColumn("__noted", F.lit(True))
    return feeds.join(noted, "feed", "left").select("feed", F.when(F.col("__noted"), "ok_with_warnings").otherwise("ok").alias("status"))
