"""A small feed from its files to itineraries: reading, normalising, encoding, writing, loading, routing, and the requests of the service layer."""

import json

import pytest
from pyspark.sql import functions as F

from tidelane.operators import isochrone, normalise, routing, search, service
from tidelane.sources import build, feed

FILES = {
    "agency.txt": "agency_id,agency_name\n1,Town\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\n10,Hall,35.70,139.30\n2,Clinic,35.71,139.31\n3,,35.72,139.32\n4,Depot,,\n",
    "routes.txt": "route_id,route_short_name,route_long_name,route_type\nr1,,Loop,3\nr2,D,,\n",
    "trips.txt": "route_id,service_id,trip_id,trip_headsign\nr1,wk,t1,To 3\nr1,wk,t2,\nr2,wk,f1,\nr9,wk,t3,\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240701,20241231\n",
    "calendar_dates.txt": "service_id,date,exception_type\nwk,20240709,2\nwk,20240713,1\n",
    "location_groups.txt": "location_group_id,location_group_name\ng1,All of town\n",
    "location_group_stops.txt": "location_group_id,stop_id\ng1,10\ng1,2\ng1,3\ng1,77\n",
    "booking_rules.txt": "booking_rule_id,booking_type,prior_notice_duration_min,phone_number,message\nb1,1,30,0421234567,\nb2,0,,,ring twice\n",
    "stop_times.txt": (
        "trip_id,stop_sequence,stop_id,location_group_id,arrival_time,departure_time,start_pickup_drop_off_window,end_pickup_drop_off_window,pickup_type,drop_off_type,pickup_booking_rule_id,drop_off_booking_rule_id,timepoint\n"
        "t1,1,10,,08:00:00,,,,,,,,1\nt1,2,2,,08:10:00,08:11:00,,,,,,,0\nt1,3,3,,,08:20:00,,,,,,,7\n"
        "t2,5,10,,09:00:00,09:00:00,,,,,,,\nt2,6,2,,09:10:00,09:10:00,,,,,,,\nt2,7,3,,09:20:00,09:20:00,,,,,,,\n"
        "t3,1,10,,07:00:00,07:00:00,,,,,,,\n"
        "f1,1,,g1,,,09:00:00,17:00:00,2,1,b1,,\nf1,2,,g1,,,09:00:00,17:00:00,1,2,,b2,\n"
        ",1,10,,06:00:00,,,,,,b9,b9,\n"
    ),
    "locations.geojson": '{"type":"FeatureCollection","features":[{"id":"z","geometry":{"type":"Polygon","coordinates":[]},"properties":{"stop_name":"Zone"}}]}',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("feeds")
    (out / "town").mkdir()
    for name, text in FILES.items():
        (out / "town" / name).write_text(text, encoding="utf-8")
    return str(out)


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    made = build.feed_tables(feed.read_raw(spark, folder), "town", "2024-07-08")
    out = str(tmp_path_factory.mktemp("built"))
    build.write(made, out)
    return build.load(spark, out), out


@pytest.fixture(scope="module")
def net(tables):
    return build.network(tables[0])


def asked(spark, *rows):
    """query_id, from_sid, to_sid, dep, day, same_day, now."""
    made = spark.createDataFrame(list(rows), "query_id long, from_sid long, to_sid long, dep long, day int, same_day boolean, now long")
    return made.withColumns({c: F.lit(None).cast("double") for c in ("from_lat", "from_lon", "to_lat", "to_lon")})


def test_encoding(tables):
    t = tables[0]
    stops = {r.stop_id: r for r in t.stops.collect()}
    # Numeric ids stand by value; what is missing has its default.
    assert [stops[k].sid for k in ("2", "3", "4", "10")] == [0, 1, 2, 3] and stops["3"].name == "3" and (stops["4"].lat, stops["4"].lon) == (0.0, 0.0)
    assert {r.trip_id: r.route for r in t.trips.collect()} == {"t1": 0, "t2": 0, "t3": 0, "f1": 1}
    assert {(r.route_id, r.short_name, r.long_name, r.route_type) for r in t.routes.collect()} == {("r1", "", "Loop", 3), ("r2", "D", "", 3)}
    assert {r.sid for r in t.members.collect()} == {0, 1, 3}
    f = t.flex_trips.first()
    rules = {r.booking_rule_id: r.rule for r in t.rules.collect()}
    assert (f.ws, f.we, f.pickup_rule, f.drop_off_rule, f.kind, f.minutes) == (32400, 61200, rules["b1"], rules["b2"], 1, 30)
    meta = t.meta.first()
    assert (meta.schema_version, meta.first_day, meta.last_day, meta.status) == (1, 20240708, 20240811, "ok_with_warnings")
    codes = sorted((r.file, r.code) for r in t.warnings.collect())
    assert ("stop_times", "row_dropped") in codes and ("stop_times", "foreign_key_mismatch") not in codes
    days = {r.day for r in t.trip_days.collect()}
    assert 20240709 not in days and 20240713 in days and 20240710 in days and 20240714 not in days


def test_other_versions_are_not_loaded(spark, tables, tmp_path, monkeypatch):
    build.write(tables[0], str(tmp_path))
    monkeypatch.setattr(build, "SCHEMA_VERSION", 2)
    with pytest.raises(ValueError, match="version 1"):
        build.load(spark, str(tmp_path))


def test_calls_and_patterns(net, tables):
    calls = sorted((r.tid, r.seq, r.sid, r.arr, r.dep) for r in net.stop_times.collect())
    t = {r.trip_id: r.tid for r in tables[0].trips.collect()}
    assert calls == sorted([(t["t1"], 1, 3, 28800, 28800), (t["t1"], 2, 0, 29400, 29460), (t["t1"], 3, 1, 30000, 30000), (t["t2"], 1, 3, 32400, 32400), (t["t2"], 2, 0, 33000, 33000), (t["t2"], 3, 1, 33600, 33600)])
    assert net.stop_times.select("rid").distinct().count() == 1  # the same stops, whatever the sequence numbers


def test_plans_by_day(spark, net):
    requests = asked(spark, (1, 3, 1, 28000, 20240710, True, 27000), (2, 3, 1, 28000, 20240709, True, 27000), (3, 3, 1, 36000, 20240710, True, 30000), (4, 3, 1, 36000, 20240710, True, 35000), (5, 3, 1, 36000, 20240710, False, 35000), (6, 3, 3, 28000, 20240710, True, 0), (7, 3, 99, 28000, 20240710, True, 0))
    front = routing.plan(net, requests, 3)
    got = {}
    for r in routing.summary(front, requests).collect():
        got.setdefault(r.query_id, []).append((r.arr, r.transfers, r.needs_booking))
    assert got[1] == [(30000, 0, False)] and 2 not in got and 6 not in got and 7 not in got
    # At 10:00 only the flexible service runs; its deadline is half an hour before, on the day itself.
    assert [x[1:] for x in got[3]] == [(0, True)] and 4 not in got and 5 in got
    legs = front.where("query_id = 3").first().legs
    assert legs[0].mode == "flex" and legs[0].due == 36000 - 1800


def test_default_day_and_search(spark, net, tables):
    first = build.default_day(tables[0], asked(spark, (1, 3, 1, 28000, None, True, 27000)))
    assert first.first().day == 20240708 and routing.plan(net, first, 2).count() == 1
    found = search.run_search(net, asked(spark, (1, 3, 1, 36000, 20240710, True, 35000), (2, 3, 1, 28000, 20240710, True, 27000)), 2)
    rows = {r.query_id: r for r in found.collect()}
    assert (rows[1].found, rows[1].board, rows[1].due, rows[1].shifted_dep) == (0, 36000, 34200, 37800) and rows[1].shifted_arr > 37800
    assert rows[2].found == 1 and rows[2].board is None


def test_smoke_check(tables):
    made = tables[0]
    assert build.smoke_check(made)
    assert not build.smoke_check(build.FeedTables(**{**vars(made), "flex_trips": made.flex_trips.limit(0)}))


def test_isochrone_from_a_place(spark, net, tables):
    near = spark.createDataFrame([(1, None, 35.7005, 139.3005, 28000, 20240710)], "query_id long, from_sid long, from_lat double, from_lon double, dep long, day int")
    got = {r.cutoff: r.n for r in isochrone.reached_within(net, near, [60, 900, 1800, 2000], 2).groupBy("cutoff").agg(F.count("*").alias("n")).collect()}
    assert got == {900: 1, 1800: 2, 2000: 2}  # a vehicle that arrives on the last cutoff is too late
    areas = isochrone.hulls(service.group_areas(net.members, tables[0].stops), tables[0].stops, keep_flat=True)
    assert areas.count() == 1


def test_journeys_and_their_errors(spark, net, tables):
    areas = spark.createDataFrame([(0, 35.0, 36.0, 139.0, 140.0), (1, 10.0, 11.0, 0.0, 1.0)], "area long, south double, north double, west double, east double")
    stops = tables[0].stops.select(F.lit(0).cast("long").alias("area"), "sid", "name").unionByName(spark.createDataFrame([(1, 500, "Far"), (1, 501, "Twin"), (1, 502, "Twin")], "area long, sid long, name string"))
    rows = [
        (1, "2024-07-10T07:00:00+09:00", None, "hall", 1, None, 3), (2, "2024-07-10T07:00:00", None, "Hall", 1, None, 3), (3, "2024-07-09T22:00:00Z", None, "Hall", None, "far", 3), (4, "2024-07-10T07:00:00+09:00", None, "Twin", 1, None, 3),
        (5, "2024-07-10T07:00:00+09:00", 3, None, 1, None, 9), (6, "2024-07-10T07:00:00+09:00", None, None, 1, None, 3), (7, "2024-07-10T07:00:00+09:00", 999, None, 1, None, 3),
    ]
    requests = spark.createDataFrame(rows, "query_id long, departure string, from_sid long, from_name string, to_sid long, to_name string, max_rides int")
    requests = requests.withColumns({c: F.lit(None).cast("double") for c in ("from_lat", "from_lon", "to_lat", "to_lon")}).withColumns({"same_day": F.lit(False), "now": F.lit(0)})
    found, errors = service.journeys(net, requests, stops, areas, 3)
    assert {(r.query_id, r.arr) for r in found.collect()} == {(1, 30000)}
    wrong = {r.query_id: (r.error_code, r.retryable) for r in errors.collect()}
    assert wrong == {2: ("INVALID_INPUT", False), 3: ("DATA_NOT_AVAILABLE", False), 4: ("INVALID_INPUT", False), 5: ("INVALID_INPUT", False), 6: ("INVALID_INPUT", False), 7: ("INVALID_INPUT", False)}


def test_other_files(spark, folder, tmp_path):
    texts = feed.locations_of(feed.read_raw(spark, folder))
    assert [(r.feed, r.location_id, r["name"]) for r in normalise.flex_locations(texts).collect()] == [("town", "z", "Zone")]
    (tmp_path / "credits.json").write_text(json.dumps({"generatedAt": "2024", "entries": [{"feedId": "town", "providerName": "Town", "licenseId": "CC"}]}, indent=1))
    assert [(r.feed_id, r.provider, r.license) for r in feed.read_credits(spark, str(tmp_path / "credits.json")).collect()] == [("town", "Town", "CC")]


def test_names_in_other_scripts(spark):
    names = spark.createDataFrame([(1, "ひがし駅"), (2, "ヒガシ公園"), (3, "ＡＢＣ"), (4, "x")], "id long, name string")
    queries = spark.createDataFrame([(1, "ヒガシ"), (2, "abc"), (3, ""), (4, "駅"), (5, "ひがし公園")], "query_id long, q string")
    got = {}
    for r in search.by_name(names, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {1: [1, 2], 2: [3], 4: [1], 5: [2]}
    solved = {r.query_id: (r.status, r.id, r.candidates) for r in search.resolve_name(names, queries).collect()}
    assert solved[5] == ("exact", 2, []) and solved[4] == ("partial", 1, []) and solved[1] == ("ambiguous", None, ["ひがし駅", "ヒガシ公園"]) and solved[3][0] == "not_found"
