"""CSV files read in splits: quotes, line breaks, flawed rows, encodings; the whole feed in one parse; versions of a feed."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidelane.operators import normalise
from tidelane.sources import build, feed
from tidelane.sources.records import read_records

rng = random.Random(7)


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder.parent)


def rows(spark, path):
    found, _, _ = read_records(spark, path)
    out = {}
    for r in found.orderBy("row_no").collect():
        out.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.cells, r.flawed))
    return out


def test_records_match_a_csv_reader_in_any_splits(spark, tmp_path):
    cells = ["", "x", "a b", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", "é駅", '",\n"', "end\n", "1"]
    made = [[str(k), *(rng.choice(cells) for _ in range(3))] for k in range(900)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([["id", "p", "q", "r"], *made])
    path = put(tmp_path / "in" / "f", big=out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(path + "/f").rdd.getNumPartitions() > 5
        found = rows(spark, path)["big.txt"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[0] for r in found] == list(range(1, 901)) and not any(r[2] for r in found)
    assert [[r[1][c] for c in "id p q r".split()] for r in found] == [[c.replace("\r\n", "\n") for c in own] for own in made]


def test_flawed_rows_cost_only_themselves(spark, tmp_path):
    text = 'stop_id,stop_name\n1,"A\n2,B\n3,"C\nD"\n4\n\n5,E,F\n6,"x"y\n7,"open, once ""more""\n8,"fine"\n9,"last'
    found = rows(spark, put(tmp_path / "in" / "f", stops=text))["stops.txt"]
    assert [(n, c.get("stop_id"), c.get("stop_name"), bad) for n, c, bad in found] == [
        (1, "1", "A", True), (2, "2", "B", False), (3, "3", "C\nD", False), (4, "4", None, True), (5, "5", "E", True), (6, "6", '"x"y', True), (7, "7", 'open, once "more"', True), (8, "8", "fine", False), (9, "9", "last", True),
    ]


def test_reopened_cells_and_headers(spark, tmp_path):
    text = '﻿ a ,b,a\n"1\nx","2\ny",3\n4,"5\n6"z,7\n8,9,10\n'
    found = rows(spark, put(tmp_path / "in" / "f", t=text, empty="", blank="\n\n", head="a,b\n"))
    assert found["t.txt"][0] == (1, {"a": "1\nx", "b": "2\ny", "a_2": "3"}, False)
    assert [(r[1]["a"], r[2]) for r in found["t.txt"][1:]] == [("4", True), ('6"z', True), ("8", False)] and set(found) == {"t.txt"}


def test_one_parse_of_all_files(spark, tmp_path):
    path = put(
        tmp_path / "in" / "my town+1",
        agency="agency_id,agency_name,agency_url,agency_timezone,agency_lang,agency_phone\n1, Bus ,u,Asia/Tokyo,ja,\n", stops='stop_id,stop_name,stop_lat,stop_lon\n1,"A,35,139\n,B,1,2\n2,駅,x,139\n'.encode("cp932"),
        location_group_stops="location_group_id,stop_id\ng,1\n,2\n", translations="table_name,field_name,language,translation,record_id\nstops,stop_name,en,Station,2\n", feed_info="feed_publisher_name,feed_lang,feed_version\nP,ja,7\nQ,,\n",
        booking_rules="booking_rule_id,booking_type\n,1\nb,1\n", trips="trip_id,route_id,service_id\n", stop_times="trip_id,stop_sequence,stop_id,pickup_booking_rule_id\nt,1,1,b\nt,2,2,zz\n",
    )
    (tmp_path / "in" / "my town+1" / "locations.geojson").write_text('{"type":"FeatureCollection","features":[{"id":"z","geometry":{"type":"Polygon","coordinates":[]},"properties":{"stop_name":"Zone"}},{"geometry":null}]}')
    raw = feed.read_raw(spark, path)
    assert {r.feed_id for r in raw.select("feed_id").distinct().collect()} == {"my town+1"}
    plan = feed.table_of(raw, "stops", ["stop_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file" in plan and "Text" not in plan and "BinaryFile" not in plan
    made = build.feed_tables(raw, "my town+1", "2024-07-08")
    assert [(r.name, r.phone, r.timezone) for r in made.agencies.collect()] == [("Bus", None, "Asia/Tokyo")]
    assert [(r.table_name, r.translation, r.record_id, r.field_value) for r in made.translations.collect()] == [("stops", "Station", "2", None)]
    assert [tuple(r) for r in made.feed_info.select("publisher_name", "lang", "version").collect()] == [("P", "ja", "7")]
    assert [(r.location_id, r["name"]) for r in made.locations.collect()] == [("z", "Zone")]
    assert {r.file for r in made.missing.collect()} == {"routes", "calendar", "calendar_dates", "location_groups"}
    assert [(r.no, r.file, r.row_no, r.code) for r in made.warnings.orderBy("no").collect()] == [
        (1, "booking_rules", 1, "row_dropped"), (2, "booking_rules", 2, "spec_violation"), (3, "locations", 2, "row_dropped"), (4, "stops", 0, "encoding_fallback"), (5, "stops", 1, "invalid_value"), (6, "stops", 2, "row_dropped"),
        (7, "stops", 3, "invalid_value"), (8, "location_group_stops", 2, "row_dropped"), (9, "stop_times", 2, "foreign_key_mismatch"),
    ]
    assert made.meta.first().status == "ok_with_warnings"


SMALL = {"stops": "stop_id,stop_name,stop_lat,stop_lon\n1,A,35,139\n2,B,35.1,139.1\n", "stop_times": "trip_id,location_group_id,stop_sequence,start_pickup_drop_off_window,end_pickup_drop_off_window,pickup_type,drop_off_type,pickup_booking_rule_id\nt,g,1,09:00:00,17:00:00,2,1,b\nt,g,2,09:00:00,17:00:00,1,2,b\n", "booking_rules": "booking_rule_id,booking_type,prior_notice_duration_min\nb,1,30\n"}


def times_of(spark, path):
    raw = feed.read_raw(spark, path)
    names = {"start_pickup_drop_off_window": "start_window", "end_pickup_drop_off_window": "end_window", "pickup_booking_rule_id": "pickup_rule"}
    rules = normalise.kept(normalise.booking_rules(feed.table_of(raw, "booking_rules", ["booking_rule_id", "booking_type", "prior_notice_duration_min"])))
    columns = ["trip_id", "stop_sequence", "stop_id", "location_group_id", "location_id", "arrival_time", "departure_time", *names, "pickup_type", "drop_off_type"]
    times = normalise.stop_times(feed.table_of(raw, "stop_times", columns).withColumnsRenamed(names), rules)
    return [(r.trip_id, r.seq, r.place, r.w0, r.w1, r.pickup, r.drop_off, r.rule) for r in times.orderBy("row_no").collect()], sorted(r.code for r in normalise.warning_log("stop_times", times).collect())


def test_mutations_of_a_feed(spark, tmp_path):
    want = ([("t", 1, "g", 32400, 61200, 2, 1, "b"), ("t", 2, "g", 32400, 61200, 1, 2, "b")], [])
    swapped = "\n".join(",".join(line.split(",")[k] for k in (3, 0, 7, 2, 1, 6, 5, 4)) for line in SMALL["stop_times"].strip().split("\n"))
    same = {"plain": SMALL, "mark": SMALL | {"stop_times": "﻿" + SMALL["stop_times"]}, "crlf": {k: v.replace("\n", "\r\n") for k, v in SMALL.items()}, "shuffled": SMALL | {"stop_times": swapped}}
    for name, files in same.items():
        assert times_of(spark, put(tmp_path / name / "f", **files)) == want, name
    found, codes = times_of(spark, put(tmp_path / "rules" / "f", **SMALL | {"booking_rules": "booking_rule_id,booking_type\n"}))
    assert codes == ["foreign_key_mismatch"] * 2 and {r[-1] for r in found} == {None}


def test_versions_are_whole_or_not_there(spark, tmp_path):
    path, out = put(tmp_path / "in" / "town", **SMALL), str(tmp_path / "out")
    made = build.feed_tables(feed.read_raw(spark, path), "town", "2024-07-08")
    assert build.write(made, out) == 1 and build.feeds(spark, out) == ["town"]
    opened = build.load(spark, out)
    broken = build.FeedTables(**{**vars(made), "stops": made.stops.limit(1), "rules": made.rules.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))})
    with pytest.raises(Exception, match="lost"):
        build.write(broken, out, "town")
    assert build.load(spark, out).stops.count() == 2
    assert build.write(build.FeedTables(**{**vars(made), "stops": made.stops.limit(1)}), out) == 2
    other = build.feed_tables(feed.read_raw(spark, put(tmp_path / "more" / "city", **SMALL)), "city", "2024-07-08")
    assert build.write(other, out) == 1 and build.feeds(spark, out) == ["city", "town"]
    assert build.load(spark, out, "town").stops.count() == 1 and opened.stops.count() == 2 and build.load(spark, out, "town", 1).stops.count() == 2
    build.forget(spark, out, "town", keep=1)
    with pytest.raises(ValueError, match="no version 1"):
        build.load(spark, out, "town", 1)
    assert build.load(spark, out, "town").stops.count() == 1 and build.load(spark, out, "city").stops.count() == 2
