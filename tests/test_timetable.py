"""Rounds on lines and starts find what rounds by joins find, without the stop times."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.operators import footpaths, isochrone, routing, timetable
from tidelane.operators.network import times_of
from tidelane.sources.derived import Network


def network(spark):
    """Two lines that cross, one with trips that start together, a flexible service for some stops, and footpaths."""
    spot = lambda s: (35.0 + (s * 7 % 20) * 0.002, 139.0 + (s * 3 % 20) * 0.002)
    stops = spark.createDataFrame([(s, 0, *spot(s)) for s in range(20)], "sid long, nk int, lat double, lon double")
    lines = [(1, k + 1, k, 60 * k, 60 * k + 20) for k in range(12)] + [(2, k + 3, (k * 3 + 5) % 20, 90 * k, 90 * k) for k in range(9)]
    lines = spark.createDataFrame(lines, "pid long, seq int, sid long, arr long, dep long")
    runs = spark.createDataFrame([(40 - t, 1, 28000 + 150 * (t // 2)) for t in range(20)] + [(50 + t, 2, 27900 + 400 * t) for t in range(9)], "tid long, pid long, start long")
    at = F.col("start") + F.col("arr"), F.col("start") + F.col("dep")
    times = runs.join(lines, "pid").select("tid", F.col("pid").alias("rid"), "seq", "sid", at[0].alias("arr"), at[1].alias("dep"))
    paths = spark.createDataFrame([(a, (a + d) % 20, 90.0 * d, 70 * d) for a in range(20) for d in (1, 2, 19)], "a long, b long, metres double, seconds long")
    members = spark.createDataFrame([(g, s) for g in (0, 1) for s in range(g, 20, 3)], "grp int, sid long")
    flex = spark.createDataFrame([(7, 0, 27000, 30000, 0, None, None, None), (5, 0, 28400, 29600, 1, 10, None, None), (9, 1, 27000, 31000, 2, None, 0, 28500), (3, 1, 27000, 31000, 2, None, 1, 61200)], "ft int, grp int, ws long, we long, kind int, minutes int, last_day int, last_time int")
    return Network(stops, None, None, times, paths, members, flex, lines=lines, runs=runs)


@pytest.mark.parametrize("dated", [False, True])
def test_lines_find_what_joins_find(spark, dated, monkeypatch):
    monkeypatch.setattr(timetable, "BLOCK", 2)
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", (28000 + F.col("sid") * 13).alias("dep"), (F.col("sid") % 2 == 0).alias("same_day"), (27600 + F.col("sid") * 20).alias("now"))
    if dated:
        asked = asked.withColumn("day", (F.col("sid") % 3).cast("int"))
        net.running = net.runs.select("tid", F.explode(F.array(F.lit(0), F.lit(1))).alias("day")).where("(tid + day) % 3 > 0")
        net.flex_running = net.flex_trips.select("ft", F.explode(F.array(F.lit(0), F.lit(2))).alias("day")).where("(ft + day) % 4 > 0")
    goals = asked.select("query_id", ((F.col("sid") + 9) % 20).alias("sid"))
    joined, lined = replace(net, lines=None, runs=None), replace(net, stop_times=None)
    for flex in (False, True):
        of = lambda n, **own: sorted(map(tuple, routing.arrivals(n, asked, 3, flex, **own).select("query_id", "round", "sid", "arr", "ride", "path").collect()), key=str)  # noqa: E731, B023
        assert of(lined) == of(joined)
        times = lambda n, **own: sorted(map(tuple, routing.arrivals(n, asked, 3, flex, ways=False, **own).select("query_id", "round", "sid", "arr").collect()))  # noqa: E731, B023
        bound = asked.select("query_id", (F.col("dep") + 700).alias("bound"))
        assert times(lined, bound=bound) == times(joined, bound=bound)
        front = lambda n: sorted(map(tuple, routing.pareto(routing.arrivals(n, asked, 3, flex, targets=goals), goals, 3).collect()), key=str)  # noqa: E731, B023
        assert front(lined) == front(joined)


def test_times_between_many_members_are_not_kept():
    group = timetable.Group(np.arange(5), np.linspace(35, 35.1, 5), np.linspace(139, 139.1, 5))
    some, to = np.array([3, 1]), np.array([0, 1, 4])
    kept = group.times(some, to)
    few, timetable.MOST_MEMBERS = timetable.MOST_MEMBERS, 4
    try:
        again = timetable.Group(group.places, group.lat, group.lon)
        assert (again.times(some, to) == kept).all() and again.seconds is None and kept[1, 1] > 10**9
    finally:
        timetable.MOST_MEMBERS = few


def test_more_than_can_be_sent_to_every_task_is_joined(spark, monkeypatch):
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"))
    assert timetable.gathered(net, asked, False) is not None
    monkeypatch.setattr(timetable, "MOST_ROWS", 30)
    assert timetable.gathered(net, asked, False) is None
    assert routing.arrivals(net, asked, 1).count() > 20


def test_who_is_left_out_could_not_be_sooner():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = 60
        group = timetable.Group(np.arange(n), 35 + rng.random(n) * 0.05, 139 + rng.random(n) * 0.05)
        arr, limit = rng.integers(28000, 30500, n), rng.integers(28300, 31000, n)
        some = np.flatnonzero(rng.random(n) < 0.7)
        limit[some] = np.minimum(limit[some], arr[some])  # a label is no later than the member's own
        cand = arr[some][:, None] + group.times(some, np.arange(n))
        want = {t: (int(cand[:, t].min()), int(some[cand[:, t].argmin()])) for t in range(n) if cand[:, t].min() < limit[t]}
        got = dict(zip((x := group.reached(some, arr, limit))[0].tolist(), zip(x[1].tolist(), x[2].tolist(), strict=True), strict=True))
        assert got == want


@pytest.mark.parametrize("dated", [False, True])
def test_a_goal_of_several_leaves_out_what_leads_nowhere(spark, dated):
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", (28000 + F.col("sid") * 13).alias("dep"), (F.col("sid") % 2 == 0).alias("same_day"), (27600 + F.col("sid") * 20).alias("now")).coalesce(1)
    if dated:
        asked = asked.withColumn("day", (F.col("sid") % 3).cast("int"))
        net.running = net.runs.select("tid", F.explode(F.array(F.lit(0), F.lit(1))).alias("day")).where("(tid + day) % 3 > 0")
        net.flex_running = net.flex_trips.select("ft", F.explode(F.array(F.lit(0), F.lit(2))).alias("day")).where("(ft + day) % 4 > 0")
    goals = asked.select("query_id", F.explode(F.array(F.struct(F.lit(4).alias("sid"), F.lit(90).alias("seconds"), F.lit(80.0).alias("metres")), F.struct(F.lit(17).alias("sid"), F.lit(0).alias("seconds"), F.lit(0.0).alias("metres")))).alias("x")).select("query_id", "x.*")
    joined, lined = replace(net, lines=None, runs=None), replace(net, stop_times=None)
    for flex in (False, True):
        labels = [routing.arrivals(n, asked, 3, flex, targets=goals) for n in (joined, lined)]
        front = [sorted(map(tuple, routing.pareto(x, goals, 3).collect()), key=str) for x in labels]
        assert front[0] == front[1] and len(front[0]) > 10
        assert labels[1].count() < labels[0].count()


def test_nobody_walks_on_from_an_origin_to_a_goal(spark):
    stops = spark.createDataFrame([(s, 0, 35.0 + s * 0.01, 139.0) for s in range(4)], "sid long, nk int, lat double, lon double")
    lines = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 2, 1, 60, 60), (2, 1, 1, 0, 0), (2, 2, 2, 900, 900)], "pid long, seq int, sid long, arr long, dep long")
    runs = spark.createDataFrame([(1, 1, 28000), (2, 2, 28100)], "tid long, pid long, start long")
    at = F.col("start") + F.col("arr"), F.col("start") + F.col("dep")
    times = runs.join(lines, "pid").select("tid", F.col("pid").alias("rid"), "seq", "sid", at[0].alias("arr"), at[1].alias("dep"))
    paths = spark.createDataFrame([(1, 2, 100.0, 100), (3, 1, 10.0, 10)], "a long, b long, metres double, seconds long")
    net = Network(stops, None, None, times, paths, None, None, lines=lines, runs=runs)
    # A ride from one origin to the other is no label there, so its footpath to the goal is not walked.
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.lit(28000).alias("dep"))
    access = asked.select("query_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<long>")).alias("sid"), F.lit(0).alias("seconds"), F.lit(0.0).alias("metres"))
    goals = asked.select("query_id", F.lit(2).cast("long").alias("sid"))
    front = lambda n: sorted((r.query_id, r.round, r.arr) for r in routing.pareto(routing.arrivals(n, asked, 2, targets=goals, access=access), goals, 2).collect())
    assert front(replace(net, stop_times=None)) == front(replace(net, lines=None, runs=None)) == [(q, 1, 29000) for q in range(30)]


def test_seconds_ahead_are_never_more_than_a_journey_takes(spark):
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"), F.lit(False).alias("same_day"), F.lit(0).alias("now"))
    paths = footpaths.gathered(net.transfers)
    table = timetable.gathered(net, asked, True, paths)
    goals, on = np.array([4]), np.array([0])
    assert table.ahead(paths, goals, on, 2, True) is None  # nobody else has asked for it yet
    ahead = table.ahead(paths, goals, on, 2, True)
    took = {(r.query_id, r.round): r.arr - 28000 for r in routing.arrivals(net, asked, 2, True, ways=False).where("sid = 4").collect()}
    assert all(ahead[k][q] <= t for (q, k), t in took.items()) and (ahead[1] <= ahead[0]).all() and (ahead[2] <= ahead[1]).all()
    assert ahead[0].tolist() == [0 if s == 4 else x for s, x in enumerate(ahead[0].tolist())] and len(took) > 20


def test_labels_without_ways_move_in_lists(spark, monkeypatch):
    monkeypatch.setattr(timetable, "PACKED", 3)
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"))
    found = routing.arrivals(replace(net, stop_times=None), asked, 2, ways=False)
    best = found.groupBy("query_id", "sid").agg(F.min("arr").alias("arr"))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and "sid#" not in "".join(x.split("hashpartitioning(")[1] for x in plan.splitlines() if "hashpartitioning(" in x)
    times = lambda df: sorted(map(tuple, df.select("query_id", "round", "sid", "arr").collect()))
    assert times(found) == times(routing.arrivals(replace(net, lines=None, runs=None), asked, 2, ways=False))


def test_no_round_after_the_last_ride_that_anyone_asks_for(spark, monkeypatch):
    net, calls, ridden = network(spark), [], timetable.ridden
    monkeypatch.setattr(timetable, "ridden", lambda *own: calls.append(own[-1]) or ridden(*own))
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"), (F.col("sid") % 2 + 1).alias("max_rides"))
    assert routing.arrivals(net, asked, 6).agg(F.max("round")).first()[0] == 2 and calls == [1, 0]


def test_times_of_few_trips_are_made_of_their_lines(spark):
    net = network(spark)
    few = net.runs.where("tid % 9 = 4").select("tid")
    times = lambda n: sorted(map(tuple, times_of(n, few).select("tid", "rid", "seq", "sid", "arr", "dep").collect()))
    assert times(replace(net, stop_times=None)) == times(replace(net, lines=None, runs=None)) and len(times(net)) > 20


def test_hulls_meet_few_points_from_inside(spark):
    rng = np.random.default_rng(5)
    spots = [(int(s), float(x), float(y)) for s, (x, y) in enumerate(np.round(rng.random((3000, 2)), 3))] + [(3000 + k, 0.5, 0.001 * k) for k in range(4)] + [(3010, 7.0, 7.0)]
    stops = spark.createDataFrame(spots, "sid long, lat double, lon double")
    groups = spark.createDataFrame([(q, 60, s) for q in (1, 2) for s in range(q - 1, 3000, q)] + [(3, 60, 3000 + k) for k in range(4)] + [(4, 60, 3010)], "query_id long, cutoff int, sid long")
    place = {s: (y, x) for s, x, y in spots}
    corners = {q: isochrone.hull([place[r.sid] for r in groups.collect() if r.query_id == q], True) for q in (1, 2, 3, 4)}
    got = {r.query_id: [tuple(p) for p in r.ring][:-1] for r in isochrone.hulls(groups, stops, keep_flat=True).collect()}
    assert {q: sorted(p) for q, p in got.items()} == {q: sorted(p) for q, p in corners.items()}
    points = groups.join(stops, "sid").select("query_id", "cutoff", "lon", "lat")
    left = {r.query_id: r["count"] for r in isochrone._outer(points).groupBy("query_id").count().collect()}
    assert left[1] < 600 and left[3] == 4 and left[4] == 1
