"""Queries of the service layer and of the encoding of feeds, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.functions import booking, clock, text
from tidelane.operators import encode, history, isochrone, normalise, search, service
from tidelane.plans.catalogue import _BOARD_DUE, ORACLES, QUERIES, _board, _from, query  # noqa: F401
from tidelane.sources.derived import DATES_SQL, derive, service_dates, table

# Texts and small formats


@query(f"SELECT event_id, CASE WHEN kind = 1 AND minutes IS NULL THEN 'minutes_missing' WHEN due IS NULL THEN NULL WHEN NOT same_day THEN 'other_day_deadline_only' WHEN now > due THEN 'deadline_passed '||lpad(CAST(due//3600 AS VARCHAR), 2, '0')||':'||lpad(CAST(due//60%60 AS VARCHAR), 2, '0') END AS reason,"
       f" CASE WHEN kind = 0 THEN 'No booking needed.' WHEN kind = 1 AND minutes IS NOT NULL THEN 'Book at least '||minutes||' minutes before boarding.' WHEN kind = 2 THEN 'Book by the day before.' ELSE 'See the booking rules.' END AS requirement FROM {_BOARD_DUE}")
def booking_reasons(spark, d):
    own = _board(spark, d)
    c = {n: F.col(n) for n in ("kind", "minutes", "last_day", "last_time", "due", "same_day", "now")}
    return own.select("event_id", booking.reason(*c.values()).alias("reason"), booking.requirement(c["kind"], c["minutes"]).alias("requirement"))


_MIN = "greatest(CAST(round((due - now)//60*60/60.0) AS INT), 1)"
_DAY = "((due%86400 + 86400)%86400)"
_CLOCK = f"lpad(CAST({_DAY}//3600 AS VARCHAR), 2, '0')||':'||lpad(CAST({_DAY}//60%60 AS VARCHAR), 2, '0')"


@query(f"SELECT event_id, CASE WHEN due IS NULL THEN 'Booking needed, ask for the deadline' WHEN NOT same_day THEN 'Book by '||(1 + event_id%12)||'/'||(1 + event_id%28)||' '||{_CLOCK} WHEN due - now <= 0 THEN 'Too late to book' WHEN due - now < 60 THEN 'Book by '||{_CLOCK}||' (closing now)' "
       f"ELSE 'Book by '||{_CLOCK}||' ('||(CASE WHEN {_MIN} < 60 THEN {_MIN}||' min' WHEN {_MIN}%60 = 0 THEN ({_MIN}//60)||' h' ELSE ({_MIN}//60)||' h '||({_MIN}%60)||' min' END)||' left)' END AS shown FROM {_BOARD_DUE}")
def booking_deadline_texts(spark, d):
    e = F.col("event_id")
    day = 20240000 + (1 + e % 12) * 100 + (1 + e % 28)
    return _board(spark, d).select("event_id", booking.deadline_text(F.col("due"), day, F.col("same_day"), F.col("now")).alias("shown"))


@query("WITH e AS (SELECT event_id, user_id, make_date(2024, CAST(1 + event_id%12 AS INT), CAST(1 + event_id%28 AS INT)) AS d, (event_id*67)%90000 AS s FROM events), h AS (SELECT *, s//3600%24 AS h, s%3600//60 AS m FROM e) "
       "SELECT event_id, month(d)||'/'||day(d)||' ('||left(dayname(d), 3)||')' AS label, 'I would like to ride on '||dayname(d)||' '||CASE WHEN h BETWEEN 5 AND 10 THEN 'morning' WHEN h BETWEEN 11 AND 15 THEN 'midday' WHEN h BETWEEN 16 AND 18 THEN 'evening' WHEN h BETWEEN 19 AND 23 THEN 'night' ELSE 'early morning' END||' at '||h||':'||lpad(CAST(m AS VARCHAR), 2, '0')||' from A'||user_id||' to B.' AS said FROM h")
def booking_scripts(spark, d):
    e = F.col("event_id")
    day, seconds = (20240000 + (1 + e % 12) * 100 + (1 + e % 28)).cast("int"), (e * 67) % 90000
    return table(spark, d, "events").select("event_id", booking.date_label(day).alias("label"), booking.request_script(F.concat(F.lit("A"), F.col("user_id")), F.lit("B"), day, seconds).alias("said"))


@query("SELECT event_id, CASE WHEN event_id%7 > 0 THEN CAST(20240000 + (1 + event_id%12)*100 + (1 + event_id%28) AS INT) END AS day, CASE WHEN event_id%5 > 0 THEN CAST(event_id%24*3600 + event_id%60*60 AS INT) END AS seconds, "
       "'2024-'||lpad(CAST(1 + event_id%12 AS VARCHAR), 2, '0')||'-'||lpad(CAST(1 + event_id%28 AS VARCHAR), 2, '0') AS date_text, lpad(CAST(event_id%24 AS VARCHAR), 2, '0')||':'||lpad(CAST(event_id%60 AS VARCHAR), 2, '0') AS time_text FROM events")
def date_time_inputs(spark, d):
    e = F.col("event_id")
    day, seconds = 20240000 + (1 + e % 12) * 100 + (1 + e % 28), e % 24 * 3600 + e % 60 * 60
    dates, times = clock.to_date_input(day), clock.to_time_input(seconds)
    typed = clock.date_input(F.when(e % 7 == 0, F.concat(dates, F.lit(" "))).otherwise(dates)), clock.time_input(F.when(e % 5 == 0, F.substring(times, 2, 4)).otherwise(times))
    return table(spark, d, "events").select("event_id", typed[0].alias("day"), typed[1].cast("int").alias("seconds"), dates.alias("date_text"), times.alias("time_text"))


@query("SELECT s_suppkey, CASE WHEN m <= 300 THEN 'little' WHEN m <= 800 THEN 'some' ELSE 'much' END AS amount, 'tel:'||regexp_replace(s_phone, '[^0-9]', '', 'g') AS phone, coalesce(nullif(sh, ''), nullif(lo, ''), CAST(s_suppkey AS VARCHAR)) AS route, coalesce(lo, sh, 'group') AS service "
       "FROM (SELECT s_suppkey, s_suppkey*13%1200 AS m, (s_suppkey%100)||'-(42) 1'||s_suppkey AS s_phone, CASE s_suppkey%3 WHEN 0 THEN '' WHEN 1 THEN 'S'||s_suppkey END AS sh, CASE s_suppkey%4 WHEN 0 THEN '' WHEN 1 THEN s_name END AS lo FROM supplier)")
def display_names(spark, d):
    k = F.col("s_suppkey")
    short, long = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("S"), k)), F.when(k % 4 == 0, "").when(k % 4 == 1, F.col("s_name"))
    phone = F.concat(k % 100, F.lit("-(42) 1"), k)
    return table(spark, d, "supplier").select(
        "s_suppkey", clock.walk_amount(k * 13 % 1200).alias("amount"), text.phone_link(phone).alias("phone"), text.route_name(short, long, k.cast("string")).alias("route"), text.service_name(long, short, F.lit("group")).alias("service")
    )


# Encoding of feeds

_STOPS = "SELECT CAST(s_suppkey AS INT) AS position, 's'||s_suppkey AS stop_id, CASE WHEN s_suppkey%3 > 0 THEN s_name END AS name, CASE WHEN s_suppkey%5 > 0 THEN s_suppkey*0.5::DOUBLE END AS lat, CASE WHEN s_suppkey%5 > 0 THEN 139.0::DOUBLE END AS lon FROM supplier"
_ROUTES = "SELECT CAST(n_nationkey AS INT) AS position, 'r'||n_nationkey AS route_id, CASE WHEN n_nationkey%2 = 0 THEN n_name END AS short_name, CASE WHEN n_nationkey%3 = 0 THEN n_name END AS long_name, CASE WHEN n_nationkey%4 = 0 THEN 0 END AS route_type FROM nation"
_TRIPS = "SELECT CAST(o_orderkey AS INT) AS position, 't'||o_orderkey AS trip_id, CASE WHEN o_orderkey%6 > 0 THEN 'r'||(o_orderkey%30) END AS route_id, CAST(o_custkey AS VARCHAR) AS service_id, CASE WHEN o_orderkey%2 = 0 THEN o_orderpriority END AS headsign FROM orders"
_TIMES = "SELECT 't'||l_orderkey AS trip_id, CAST(l_linenumber AS INT) AS seq, CASE WHEN l_partkey%4 > 0 THEN 'stop' ELSE 'group' END AS place_kind, 's'||(l_suppkey + l_partkey%3) AS place, CASE WHEN l_partkey%3 > 0 THEN CAST(l_linenumber*600 AS INT) END AS arr, CASE WHEN l_partkey%5 > 0 THEN CAST(l_linenumber*600 + 30 AS INT) END AS dep, CAST(l_partkey%4 AS INT) AS pickup, CAST(l_suppkey%4 AS INT) AS drop_off FROM lineitem"
_S, _R, _T = (f"(SELECT CAST(position AS BIGINT) AS {k}, * EXCLUDE (position) FROM ({raw}))" for k, raw in (("sid", _STOPS), ("route", _ROUTES), ("tid", _TRIPS)))


def _encoded(spark, d):
    plain = lambda q: q.replace("::DOUBLE", "D")
    s, r = encode.stops(_from(spark, d, plain(_STOPS), "supplier")), encode.routes(_from(spark, d, _ROUTES, "nation"))
    return s, r, encode.trips(_from(spark, d, _TRIPS.replace("VARCHAR", "STRING"), "orders"), r)


@query(f"SELECT CAST(position AS BIGINT) AS sid, stop_id, coalesce(name, stop_id) AS name, coalesce(lat, 0) AS lat, coalesce(lon, 0) AS lon FROM ({_STOPS})")
def encoded_stops(spark, d):
    return _encoded(spark, d)[0]


@query(f"SELECT CAST(position AS BIGINT) AS route, route_id, coalesce(short_name, '') AS short_name, coalesce(long_name, '') AS long_name, coalesce(route_type, 3) AS route_type FROM ({_ROUTES})")
def encoded_routes(spark, d):
    return _encoded(spark, d)[1]


@query(f"SELECT tid, trip_id, coalesce(r.route, 0) AS route, service_id, headsign FROM {_T} t LEFT JOIN {_R} r USING (route_id)")
def encoded_trips(spark, d):
    return _encoded(spark, d)[2]


_ENC = f"(SELECT t.tid, m.seq, s.sid, CAST(m.arr AS BIGINT) AS arr, CAST(m.dep AS BIGINT) AS dep, m.pickup, m.drop_off FROM ({_TIMES}) m JOIN {_T} t USING (trip_id) LEFT JOIN {_S} s ON m.place_kind = 'stop' AND s.stop_id = m.place)"


def _encoded_times(spark, d):
    s, _, t = _encoded(spark, d)
    return encode.stop_times(_from(spark, d, _TIMES, "lineitem"), t, s)


@query(f"SELECT * FROM {_ENC}")
def encoded_stop_times(spark, d):
    return _encoded_times(spark, d)


@query(f"WITH c AS (SELECT tid, seq, sid, coalesce(arr, dep) AS arr, coalesce(dep, arr) AS dep FROM {_ENC} WHERE sid IS NOT NULL AND (arr IS NOT NULL OR dep IS NOT NULL) AND tid%7 > 0) SELECT * FROM c WHERE tid IN (SELECT tid FROM c GROUP BY tid HAVING count(*) > 1)")
def fixed_calls(spark, d):
    return encode.fixed_calls(_encoded_times(spark, d), _encoded(spark, d)[2].where("tid % 7 = 0"))


@query(f"SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS grp, s.sid FROM supplier JOIN {_S} s ON s.stop_id = 's'||(s_suppkey*3%1100) WHERE s_nationkey < 20")
def encoded_members(spark, d):
    k = F.col("n_nationkey")
    groups = table(spark, d, "nation").where("n_nationkey < 20").select(k.cast("long").alias("grp"), F.concat(F.lit("g"), k).alias("location_group_id"))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("g"), F.col("s_nationkey")).alias("location_group_id"), F.concat(F.lit("s"), F.col("s_suppkey") * 3 % 1100).alias("stop_id"))
    return encode.members(rows, groups, _encoded(spark, d)[0])


_RULES = "SELECT CAST(o_orderkey AS INT) AS row_no, CAST(o_custkey%97 AS VARCHAR) AS booking_rule_id, CAST(o_orderkey%4 AS VARCHAR) AS booking_type, '30' AS prior_notice_duration_min, CASE WHEN o_orderkey%3 = 0 THEN '2' ELSE 'x' END AS prior_notice_last_day, CASE WHEN o_orderkey%5 = 0 THEN '17:00:00' ELSE '17:99' END AS prior_notice_last_time, ' '||(o_custkey%97)||' ' AS phone_number, CASE WHEN o_orderkey%2 = 0 THEN ' ' ELSE 'm' END AS message FROM orders"


@query(f"SELECT CAST(row_number() OVER (ORDER BY CAST(booking_rule_id AS INT)) - 1 AS BIGINT) AS rule, booking_rule_id, kind, 30 AS minutes, last_day, last_time, phone, message, CAST(NULL AS VARCHAR) AS info_url FROM (SELECT booking_rule_id, CAST(booking_type AS INT) AS kind, CASE WHEN prior_notice_last_day = '2' THEN 2 END AS last_day, CASE WHEN prior_notice_last_time = '17:00:00' THEN 61200 END AS last_time, trim(phone_number) AS phone, nullif(trim(message), '') AS message, row_number() OVER (PARTITION BY booking_rule_id ORDER BY row_no DESC) AS k FROM ({_RULES}) WHERE booking_type <> '3') WHERE k = 1")
def encoded_rules(spark, d):
    rows = normalise.kept(normalise.booking_rules(_from(spark, d, _RULES.replace("VARCHAR", "STRING"), "orders"))).withColumn("feed", F.lit(0))
    return encode.rules(normalise.surrogate_keys(rows, "feed", "booking_rule_id"))


@query("SELECT n_regionkey AS feed_id, CASE WHEN arg_min(n_nationkey, n_nationkey)%2 = 0 THEN arg_min(n_name, n_nationkey) END AS publisher, CASE WHEN arg_min(n_nationkey, n_nationkey)%3 = 0 THEN 'v1' END AS version FROM nation GROUP BY n_regionkey")
def feed_infos(spark, d):
    k = F.col("n_nationkey")
    raw = table(spark, d, "nation").select(F.col("n_regionkey").alias("feed_id"), k.alias("row_no"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("n_name"))).otherwise(" ").alias("publisher"), F.when(k % 3 == 0, "v1 ").otherwise("").alias("version"))
    return normalise.feed_info(raw, ["publisher", "version"])


@query("SELECT CAST(n_nationkey AS INT) AS row_no, CASE WHEN n_nationkey%6 > 0 THEN 'r'||n_nationkey END AS route_id, 'a' AS agency_id, CASE WHEN n_nationkey%2 = 0 THEN 'n' END AS short_name, n_name AS long_name, CASE WHEN n_nationkey%3 > 0 THEN 3 END AS route_type, CASE WHEN n_nationkey%6 = 0 THEN 'row_dropped' END AS drop_reason FROM nation")
def raw_normalize_routes(spark, d):
    k = F.col("n_nationkey")
    raw = table(spark, d, "nation").select(k.cast("int").alias("row_no"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("r"), k)).alias("route_id"), F.lit("a ").alias("agency_id"), F.when(k % 2 == 0, "n").otherwise("").alias("route_short_name"), F.col("n_name").alias("route_long_name"), F.when(k % 3 == 0, "bus").otherwise("3").alias("route_type"), F.lit("").alias("color"), F.lit("").alias("text_color"))
    return normalise.routes(raw).drop("warnings", "color", "text_color")


# Services


@query("WITH q AS (SELECT event_id AS query_id, CASE WHEN event_id%11 = 0 THEN '2024-07-09T08:00' ELSE '2024-07-09T08:00Z' END AS departure, event_id%9 AS max_rides, event_id*37%2200 AS walk_m, event_id*7%200 - 100 AS lat FROM events), "
       "i AS (SELECT query_id, list_filter([CASE WHEN abs(lat) > 90 THEN 'from: not on the globe' END, CASE WHEN NOT ends_with(departure, 'Z') THEN 'departure: needs a date, a time and an offset' END, CASE WHEN max_rides > 6 THEN 'max_rides: 0 to 6' END, CASE WHEN walk_m NOT BETWEEN 50 AND 2000 THEN 'walk_m: 50 to 2000' END], lambda x: x IS NOT NULL) AS x FROM q) "
       "SELECT query_id, CASE WHEN len(x) > 0 THEN 'INVALID_INPUT' END AS error_code, CASE WHEN len(x) > 0 THEN array_to_string(x, ' / ') END AS error_detail, CASE WHEN len(x) > 0 THEN false END AS retryable FROM i")
def request_errors(spark, d):
    e = F.col("event_id")
    asked = table(spark, d, "events").select(e.alias("query_id"), F.when(e % 11 == 0, "2024-07-09T08:00").otherwise("2024-07-09T08:00Z").alias("departure"), (e % 9).alias("max_rides"), (e * 37 % 2200).alias("walk_m"), (e * 7 % 200 - 100).cast("double").alias("from_lat"), F.lit(139.0).alias("from_lon"))
    return service.checked(asked).select("query_id", "error_code", "error_detail", "retryable")


_AREAS = [(0, 0.0, 35.75, 0.0, 139.35), (1, 35.74, 90.0, 139.34, 180.0)]


@query(""",, a(area, south, north, west, east) AS (VALUES (0, 0.0, 35.75, 0.0, 139.35), (1, 35.74, 90.0, 139.34, 180.0)),
q AS (SELECT sid AS query_id, sid%3 AS how, sid*3%130 AS asked, lat, lon FROM stops), n AS (SELECT sid, sid%2 AS area, 'stop '||(sid - sid%4) AS name FROM stops),
h AS (SELECT query_id, n.area, count(*) FILTER (WHERE name = 'stop '||asked) AS e, count(*) AS p, min(sid) FILTER (WHERE name = 'stop '||asked) AS es, min(sid) AS s FROM q JOIN n ON how = 2 AND contains(name, 'stop '||asked) GROUP BY ALL),
b AS (SELECT query_id, arg_min(area, area) AS area, arg_min(CASE WHEN e = 1 THEN es ELSE s END, area) AS sid FROM h WHERE e = 1 OR (e = 0 AND p = 1) GROUP BY query_id)
SELECT q.query_id, CASE how WHEN 0 THEN (SELECT min(area) FROM a WHERE lat BETWEEN south AND north AND lon BETWEEN west AND east) WHEN 1 THEN (SELECT min(area) FROM n WHERE n.sid = asked) ELSE b.area END AS area,
CASE how WHEN 1 THEN asked WHEN 2 THEN b.sid END AS sid FROM q LEFT JOIN b USING (query_id)""", net=True)
def located_places(spark, d):
    stops = derive(spark, d).stops
    sid = F.col("sid")
    areas = spark.createDataFrame(_AREAS, "area long, south double, north double, west double, east double")
    names = stops.select((sid % 2).alias("area"), "sid", F.concat(F.lit("stop "), sid - sid % 4).alias("name"))
    asked = stops.select(sid.alias("query_id"), F.when(sid % 3 == 1, sid * 3 % 130).alias("from_sid"), F.when(sid % 3 == 2, F.concat(F.lit("Stop "), sid * 3 % 130)).alias("from_name"), F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"))
    return service.located(asked, "from", names, areas).select("query_id", "area", "sid")


@query("SELECT sid, CASE WHEN g IS NULL THEN 'fixed' ELSE 'flex_member' END AS kind, coalesce(g, '') AS groups FROM stops LEFT JOIN (SELECT sid, string_agg(DISTINCT CAST(grp AS VARCHAR), ',' ORDER BY CAST(grp AS VARCHAR)) AS g FROM members WHERE grp < 3 GROUP BY sid) USING (sid)", net=True)
def stop_kinds(spark, d):
    net = derive(spark, d)
    return service.stop_kinds(net.stops.select("sid"), net.members.where("grp < 3")).withColumn("groups", F.array_join(F.col("groups").cast("array<string>"), ","))


_SERVICES = """,, """ + DATES_SQL.strip() + """, o AS (SELECT n_nationkey AS ft, CASE WHEN count(DISTINCT isodow(date)) = 7 THEN 'daily' ELSE array_to_string(list_transform(list_sort(list(DISTINCT isodow(date))), lambda k: ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][k]), ',') END AS days FROM dates JOIN nation ON service_id = n_nationkey GROUP BY 1),
m AS (SELECT grp, count(DISTINCT sid) AS n FROM members GROUP BY grp),
v AS (SELECT f.grp, f.grp||':'||f.ft AS service_id, CASE WHEN ft%2 = 0 THEN 'line '||ft WHEN ft%3 = 0 THEN '' ELSE 'region '||f.grp END AS name, coalesce(days, 'none') AS days, lpad(CAST(ws//3600 AS VARCHAR), 2, '0')||':'||lpad(CAST(ws//60%60 AS VARCHAR), 2, '0')||'-'||lpad(CAST(we//3600 AS VARCHAR), 2, '0')||':'||lpad(CAST(we//60%60 AS VARCHAR), 2, '0') AS hours,
CASE WHEN kind = 0 THEN 'No booking needed.' WHEN kind = 1 THEN 'Book at least '||minutes||' minutes before boarding.' ELSE 'Book by the day before.' END AS booking, coalesce(n, 0) AS n_members FROM flex f LEFT JOIN o USING (ft) LEFT JOIN m USING (grp))"""


def _services(spark, d):
    from tidelane.operators import calendar

    net = derive(spark, d)
    ft = F.col("ft")
    names = net.flex_trips.select("ft", F.when(ft % 3 == 0, "").alias("short_name"), F.when(ft % 2 == 0, F.concat(F.lit("line "), ft)).alias("long_name"))
    groups = net.flex_trips.select("grp", F.concat(F.lit("region "), F.col("grp")).alias("group_name")).distinct()
    days = calendar.weekday_summary(service_dates(spark, d)).withColumnRenamed("service_id", "ft")
    return service.described(net.flex_trips, groups, names, net.members, days)


@query(_SERVICES + " SELECT * EXCLUDE (grp) FROM v", net=True)
def service_catalogue(spark, d):
    return _services(spark, d)


@query(_SERVICES + ", q AS (SELECT n_nationkey AS query_id, n_regionkey AS r, n_nationkey%3 AS how FROM nation) SELECT query_id, CASE WHEN r = 4 THEN 'DATA_NOT_AVAILABLE' END AS error_code, service_id FROM q LEFT JOIN v ON r < 4 AND v.grp = r AND how < 2", net=True)
def services_of_areas(spark, d):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    asked = table(spark, d, "nation").select(k.alias("query_id"), F.concat(F.lit(" region"), r).alias("region"), F.when(k % 3 == 1, "town ").when(k % 3 == 2, "elsewhere").alias("place"))
    areas = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("area"), F.concat(F.lit("region"), F.col("r_regionkey")).alias("region"), F.array(F.lit("town"), F.lit("village")).alias("places"))
    services = _services(spark, d).withColumn("area", F.split("service_id", ":")[0].cast("int"))
    return service.services_in(areas, asked, services).select("query_id", "error_code", "service_id")


@query(",, q AS (SELECT n_nationkey AS query_id, CASE n_nationkey%5 WHEN 0 THEN 'x' WHEN 1 THEN n_regionkey||':99' ELSE n_regionkey||':'||n_nationkey END AS service_id FROM nation), "
       "r AS (SELECT query_id, service_id, f.ft, f.kind, f.minutes, f.last_day, f.last_time, CASE WHEN ft%2 = 0 THEN '04'||ft END AS phone, CASE WHEN ft%7 = 0 THEN 'call' END AS message FROM q LEFT JOIN flex f ON q.service_id = f.grp||':'||f.ft AND ft%4 > 0), k AS (SELECT r.*, (SELECT count(*) FROM flex f WHERE r.service_id = f.grp||':'||f.ft) > 0 AS there FROM r) "
       "SELECT query_id, CASE WHEN there THEN CASE WHEN kind IN (0, 2) THEN kind ELSE 1 END END AS kind, CASE WHEN there THEN CASE WHEN kind = 0 THEN 'real_time' WHEN kind = 1 THEN 'same_day_minutes_before' WHEN kind = 2 THEN 'prior_days' ELSE 'unknown' END END AS notice, minutes, "
       "CASE WHEN there THEN coalesce(message, 'Please book'||coalesce(' at '||phone, '')||'.') END AS said, CASE WHEN NOT contains(service_id, ':') THEN 'service_id: group and trip, with a colon between them' WHEN NOT there THEN 'service_id: unknown' END AS error_detail FROM k", net=True)
def booking_rule_detail(spark, d):
    net = derive(spark, d)
    k, ft = F.col("n_nationkey"), F.col("ft")
    asked = table(spark, d, "nation").select(k.alias("query_id"), F.when(k % 5 == 0, "x").when(k % 5 == 1, F.concat("n_regionkey", F.lit(":99"))).otherwise(F.concat("n_regionkey", F.lit(":"), k)).alias("service_id"))
    flex = net.flex_trips.select("ft", "grp", F.when(ft % 4 > 0, ft).alias("pickup_rule"))
    rules = net.flex_trips.select(ft.alias("rule"), "kind", "minutes", "last_day", "last_time", F.when(ft % 2 == 0, F.concat(F.lit("04"), ft)).alias("phone"), F.when(ft % 7 == 0, "call").alias("message"), F.lit(None).cast("string").alias("info_url"))
    return service.rules_of(asked, flex, rules).select("query_id", "kind", "notice", "minutes", "said", "error_detail")


_RINGS = "SELECT n_regionkey AS query_id, rid AS cutoff, ring FROM (SELECT rid, list(sid ORDER BY seq) AS ring FROM pat GROUP BY rid) JOIN nation ON n_nationkey = rid"


@query(f",, r AS ({_RINGS}), c AS (SELECT *, sum(len(ring)) OVER (PARTITION BY query_id) AS p, count(*) OVER (PARTITION BY query_id) AS n, max(cutoff) OVER (PARTITION BY query_id) AS l FROM r), e AS (SELECT *, CAST(greatest(4, floor(15/n)) AS INT) AS each FROM c), "
       "t AS (SELECT *, CASE WHEN p <= 15 OR len(ring) <= each THEN ring ELSE list_filter(ring, lambda x, i: (i-1) % CAST(greatest(ceil((len(ring)-1)/CAST(greatest(3, each-1) AS DOUBLE)), 1) AS INT) = 0 OR i = len(ring)) END AS thin FROM e), "
       "u AS (SELECT *, sum(len(thin)) OVER (PARTITION BY query_id) AS rest FROM t) SELECT CAST(query_id AS BIGINT) AS query_id, CAST(cutoff AS BIGINT) AS cutoff, p > 15 AS simplified, p > 15 AND rest > 15 AND cutoff <> l AS omitted, CASE WHEN p > 15 AND rest > 15 AND cutoff <> l THEN '' ELSE array_to_string(thin, ',') END AS ring FROM u", net=True)
def isochrone_capped(spark, d):
    pat = derive(spark, d).patterns.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sid"))), lambda s: s["sid"]).alias("ring"))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rid"), F.col("n_regionkey").cast("long").alias("query_id"))
    made = isochrone.capped(pat.join(regions, "rid").select("query_id", F.col("rid").cast("long").alias("cutoff"), "ring"), 15)
    return made.select("query_id", "cutoff", "simplified", "omitted", F.array_join(F.col("ring").cast("array<string>"), ",").alias("ring"))


@query("SELECT event_id AS query_id, user_id*60%4000 AS cutoff FROM events WHERE user_id*60%4000 BETWEEN 300 AND 3600 AND user_id*60%4000%300 = 0")
def isochrone_slider(spark, d):
    shapes = table(spark, d, "events").select(F.col("event_id").alias("query_id"), (F.col("user_id") * 60 % 4000).alias("cutoff"))
    return isochrone.pick(shapes, shapes)


@query(",, p AS (SELECT grp, lon, lat FROM members JOIN stops USING (sid) WHERE sid%5 > 0) SELECT CAST(grp AS BIGINT) AS grp, round(min(lon), 6) AS west, round(max(lon), 6) AS east, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM p GROUP BY grp", net=True)
def group_areas(spark, d):
    net = derive(spark, d)
    stops = net.stops.select("sid", *(F.when(F.col("sid") % 5 > 0, F.col(c)).otherwise(0.0).alias(c) for c in ("lat", "lon")))
    rings = isochrone.hulls(service.group_areas(net.members, stops), stops, keep_flat=True)
    ends = {n: F.round(f(F.col(f"ring.{c}")), 6) for n, f, c in (("west", F.array_min, "lon"), ("east", F.array_max, "lon"), ("south", F.array_min, "lat"), ("north", F.array_max, "lat"))}
    return rings.select(F.col("query_id").alias("grp"), *(c.alias(n) for n, c in ends.items()))


# History

_STORED = """WITH r AS (SELECT user_id, event_id, event_id%6 AS bad, 's'||(event_id%7) AS a, 's'||(event_id%3) AS b, (event_id*7919)%1000 AS saved FROM events),
g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, a, b, saved, bad FROM r), k AS (SELECT user_id, n, saved, a, b, CASE WHEN bad = 1 THEN 'coord:35.1235,139.0000' ELSE 'stop:'||a END||'>stop:'||b||'@now' AS key, bad FROM g WHERE bad > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY saved DESC, n) AS x FROM k), w AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY saved DESC, n) AS INT) AS rank FROM o WHERE x = 1)"""


def _stored(spark, d):
    """A list of searches for each user, as text; some lack a part."""
    e = F.col("event_id")
    stop = lambda s: F.concat(F.lit('{"kind":"stop","stopId":"'), s, F.lit('","name":"N'), s, F.lit('"}'))
    a, b = F.concat(F.lit("s"), e % 7), F.concat(F.lit("s"), e % 3)
    start = F.when(e % 6 == 1, '{"kind":"coord","lat":35.12345,"lon":139.0,"label":"L"}').otherwise(stop(a))
    one = F.concat(F.lit("{"), F.when(e % 6 == 0, "").otherwise(F.concat(F.lit('"from":'), start, F.lit(","))), F.lit('"to":'), stop(b), F.lit(',"when":{"type":"now"},"savedAt":'), e * 7919 % 1000, F.lit("}"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("t")))), lambda x: x["t"])
    return table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("text"))


@query(_STORED + " SELECT user_id, key, CAST(saved AS DOUBLE) AS saved_at, rank FROM w WHERE rank <= 20")
def history_stored(spark, d):
    return history.newest(history.stored(_stored(spark, d))).select("user_id", "key", "saved_at", "rank")


@query(_STORED + ", u AS (SELECT user_id, key, saved, n FROM k UNION ALL SELECT DISTINCT user_id, 'stop:s1>stop:s1@now', 5000, -1 FROM events WHERE user_id%2 = 0), v AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY saved DESC, n) AS x FROM u), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY saved DESC, n) AS INT) AS rank FROM v WHERE x = 1) "
       "SELECT user_id, key, CAST(saved AS DOUBLE) AS saved_at, rank FROM z WHERE rank <= 20 AND NOT (user_id%3 = 0 AND key = 'stop:s2>stop:s2@now')")
def history_changed(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    records = history.stored(_stored(spark, d)).select("user_id", "key", "saved_at", "n")
    saved = users.where("user_id % 2 = 0").select("user_id", F.lit("stop:s1>stop:s1@now").alias("key"), F.lit(5000.0).alias("saved_at"))
    deleted = users.where("user_id % 3 = 0").select("user_id", F.lit("stop:s2>stop:s2@now").alias("key"))
    return history.changed(records, saved, deleted).select("user_id", "key", "saved_at", "rank")


@query(_STORED + ", p AS (SELECT user_id, rank, 0 AS e, a AS s FROM w WHERE bad <> 1 UNION ALL SELECT user_id, rank, 1, b FROM w), q AS (SELECT user_id, s, min(rank*2 + e) AS f FROM p GROUP BY ALL), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY f) AS INT) AS k FROM q) SELECT user_id, s AS stop_id, 'N'||s AS name, k AS rank FROM t WHERE k <= 5")
def history_recent_stops(spark, d):
    return history.recent_stops(history.stored(_stored(spark, d)))
