"""Scalars against golden values, feeds with broken cells, and routing invariants."""

import pytest
from pyspark.sql import functions as F

from tidelane.functions import booking, clock, links, text
from tidelane.functions.geo import flex_seconds, haversine_m
from tidelane.operators import isochrone, legs, normalise, routing
from tidelane.sources import feed
from tidelane.sources.derived import Network
from tidelane.streaming import rate_limit

NETWORK = {
    "stops": ("sid long, nk int, lat double, lon double", [(1, 0, 35.0, 139.0), (2, 0, 35.1, 139.1), (3, 0, 35.2, 139.2)]),
    "times": ("tid long, rid long, seq int, sid long, arr long, dep long", [(1, 1, 1, 1, 36000, 36000), (1, 1, 2, 3, 37800, 37800), (2, 2, 1, 1, 36000, 36000), (2, 2, 2, 2, 36300, 36300), (3, 3, 1, 2, 36600, 36600), (3, 3, 2, 3, 37200, 37200)]),
    "transfers": ("a long, b long, metres double, seconds long", []),
    "members": ("grp int, sid long", [(0, 1), (0, 2), (0, 3)]),
    "flex": ("ft int, grp int, ws int, we int, kind int, minutes int, last_day int, last_time int", [(7, 0, 32400, 61200, 1, 30, None, None)]),
}


@pytest.fixture(scope="module")
def net(spark):
    made = {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in NETWORK.items()}
    return Network(made["stops"], None, None, made["times"], made["transfers"], made["members"], made["flex"])


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_golden_scalars(spark):
    lit = F.lit
    r = one(
        spark, d=haversine_m(lit(35.76512), lit(139.36366), lit(35.77551), lit(139.34549)), f=flex_seconds(lit(2000.0)), t=clock.gtfs_seconds(lit("25:30:00")), bad=clock.gtfs_seconds(lit("9:60:00")),
        c=clock.clock_text(lit(91800)), h=clock.hhmm(lit(91800)), m=clock.duration_text(lit(3600)), p=text.phone_text(lit("09012345678")), s=text.clean(lit("　 a ")), n=text.number(lit("1d")),
        k=text.match_name(lit("ひがし")), w=text.match_name(lit("ＡＢＣ")), due=booking.deadline(lit(1), lit(30), lit(None), lit(None), lit(36000)), ok=booking.feasible(lit(34200), lit(True), lit(34200)), late=booking.feasible(lit(34200), lit(True), lit(35100)),
    )
    assert round(r.d, 1) == 2005.5 and round(r.f, 2) == 758.18 and (r.t, r.bad) == (91800, None)
    assert (r.c, r.h, r.m, r.p, r.s, r.n) == ("+1 01:30", "25:30", "1 h", "090-1234-5678", "a", None)
    assert (r.k, r.w, r.due, r.ok, r.late) == ("ヒガシ", "abc", 34200, True, False)


def test_rounds_and_front(spark, net):
    asked = spark.createDataFrame([(1, 1, 35000)], "query_id long, sid long, dep long")
    labels = routing.arrivals(net, asked, rounds=4)
    got = {(r["round"], r.sid): r.arr for r in labels.collect()}
    assert got == {(0, 1): 35000, (1, 2): 36300, (1, 3): 37800, (2, 3): 37200}
    goal = spark.createDataFrame([(1, 3)], "query_id long, sid long")
    front = routing.pareto(labels, goal)
    assert sorted((r["round"], r.arr) for r in front.collect()) == [(1, 37800), (2, 37200)]
    s = {r["round"]: r for r in routing.summary(front, asked).collect()}
    assert (s[2].transfers, s[2].duration, s[2].needs_booking) == (1, 2200, False)
    legs = next(r.legs for r in front.collect() if r["round"] == 2)
    assert all(a["arr"] <= b["dep"] and a["to_sid"] == b["from_sid"] for a, b in zip(legs[:-1], legs[1:], strict=True))


@pytest.mark.parametrize(("dep", "now", "n"), [(36000, 32400, 2), (36000, 35100, 0), (64800, 32400, 0)])
def test_flex_window_and_deadline(spark, net, dep, now, n):
    asked = spark.createDataFrame([(1, 1, dep, True, now)], "query_id long, sid long, dep long, same_day boolean, now long")
    start = asked.select("query_id", "sid", F.col("dep").alias("arr"))
    assert routing.flex_ride(start, net, asked).count() == n


def test_hull():
    assert isochrone.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert isochrone.hull([(0, 0), (1, 1), (2, 2)]) == [] and isochrone.hull([(0, 0), (1, 1), (2, 2)], True) == [(0, 0), (2, 2)]


def test_feed_reading(spark, tmp_path):
    folder = tmp_path / "feeds" / "f1"
    folder.mkdir(parents=True)
    (folder / "stops.txt").write_bytes("﻿stop_id,stop_name,stop_lat,stop_lon\r\n1,A,35.1,139\r\n\r\n,B,1,2\r\n2,C,north,3\r\n".encode())
    (folder / "agency.txt").write_bytes("agency_id,agency_name\n1,バス\n".encode("shift_jis"))
    raw = feed.read_raw(spark, str(tmp_path / "feeds"))
    assert raw.where("warning = 'encoding_fallback'").count() == 1
    assert feed.table_of(raw, "agency", ["agency_name"]).first().agency_name == "バス"
    stops = normalise.stops(feed.table_of(raw, "stops", ["stop_id", "stop_name", "stop_lat", "stop_lon"]))
    assert {(r.stop_id, r.lat) for r in normalise.kept(stops).collect()} == {("1", 35.1), ("2", None)}
    assert sorted((r.row_no, r.code) for r in normalise.warning_log("stops", stops).collect()) == [(2, "row_dropped"), (3, "invalid_value")]
    assert "trips" in {r.file for r in feed.missing_files(raw).collect()}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 2).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = rate_limit.counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, rate_limit.counts(rows, 5).collect()))
    finally:
        q.stop()


def test_links_read_back_or_are_null(spark):
    good = "?from=coord%3A35.5%2C-139.25&fromLabel=%E9%A7%85&to=stop%3A9%3A1&when=20260102-2530"
    bad = [good.replace("when=20260102-2530", "when=2026"), good.replace("stop%3A9%3A1", "stop%3A"), good.replace("to=", "ato="), "", good.replace("35.5", "x"), None]
    got = [r.q for r in spark.createDataFrame([(x,) for x in [good, *bad]], "s string").select(links.read(F.col("s")).alias("q")).collect()]
    assert (got[0].origin.lat, got[0].origin.lon, got[0].origin.label) == (35.5, -139.25, "駅")
    assert (got[0].goal.stop, got[0].goal.label) == ("9:1", "9:1") and (got[0].departure.day, got[0].departure.seconds) == (20260102, 91800)
    assert got[1:] == [None] * len(bad)


def test_lines_and_ids_of_legs(spark, net):
    rows = [(1, 0, "walk", 1, 2, None, None, None), (1, 1, "transit", 2, 3, [1, 99], 5, None), (1, 2, "flex", 3, 99, None, None, 0)]
    made = spark.createDataFrame(rows, "query_id long, leg int, kind string, from_sid long, to_sid long, mids array<long>, rid long, grp int")
    assert {r.leg: [p.lat for p in r.path] for r in legs.lines(made, net.stops).collect()} == {0: [35.0, 35.1], 1: [35.1, 35.0, 35.2]}
    assert {(r.kind, r.id) for r in legs.ids(made).collect()} == {("stop", 1), ("stop", 2), ("stop", 3), ("stop", 99), ("route", 5), ("group", 0)}


def test_locations(spark):
    texts = ['{"type":"FeatureCollection","features":[{"id":7,"geometry":{"type":"Polygon","coordinates":[]}},{"id":"b","geometry":null},{"geometry":{"type":"Polygon"}}]}', "{", '{"type":"Feature"}', '{"type":"FeatureCollection","features":{}}', None]
    files = spark.createDataFrame(list(enumerate(texts)), "feed int, text string")
    assert [(r.row_no, r.location_id, r.drop_reason) for r in normalise.flex_locations(files).orderBy("row_no").collect()] == [(1, "7", None), (2, "b", "invalid_value"), (3, None, "row_dropped")]
    assert {r.feed for r in normalise.unreadable_locations(files).collect()} == {1, 2, 3, 4}


def test_plans_and_comparisons_ask_from_every_stop(spark):
    from tidelane.plans import catalogue

    d = "/root/testdata/sf0.001"
    stops = {r.sid for r in catalogue.stop_master(spark, d).collect()}
    compared = {r.query_id for r in catalogue.isochrone_before_after(spark, d).collect()}
    planned = {r.query_id for r in catalogue.plan_with_flex(spark, d).collect()}
    assert compared == stops and len(planned) > 1 and planned <= stops


def test_radius_in_the_far_north(spark):
    from tidelane.operators import network

    # At latitude 65, 0.0105 degrees are 493 m, two cells of latitude 60 apart.
    lons = [0.0089, 0.0194, 0.0300]
    stops = spark.createDataFrame([(i, 65.0, x) for i, x in enumerate(lons)], "sid long, lat double, lon double")
    got = {(r.a, r.b) for r in network.walk_transfers(stops, 500.0).collect()}
    assert got == {(a, b) for a in range(3) for b in range(3) if abs(a - b) == 1}
