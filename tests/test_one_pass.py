"""All rounds of a request in one task: the same rows without stored labels, also where footpaths are too many to be sent."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tests.test_timetable import network
from tidelane.functions.geo import FLEX_BOARD_S
from tidelane.operators import footpaths, legs, routing, timetable
from tidelane.operators.network import earliest_trips, earliest_trips_on_lines, walk_transfers
from tidelane.sources.derived import Network


def near(n=300):
    rng = np.random.default_rng(7)
    return footpaths.Nearby(np.arange(n) * 3, 35 + rng.random(n) * 0.03, 139 + rng.random(n) * 0.03, 500.0)


def test_footpaths_of_positions_are_those_of_the_table(spark):
    own = near()
    stops = spark.createDataFrame([(int(s), float(y), float(x)) for s, y, x in zip(own.stops, own.lat, own.lon, strict=True)], "sid long, lat double, lon double")
    want = {(r.a, r.b): (r.metres, r.seconds) for r in walk_transfers(stops, 500.0).collect()}
    assert 2000 < len(want) and 0.7 < own.about() / len(want) < 1.4
    for few in (True, False):
        own.few = few
        n, to, seconds = own.on(at := np.arange(300))
        a = np.repeat(at, n)
        got = {(int(own.stops[i]), int(own.stops[j])): (m, s) for i, j, m, s in zip(a, to, own.lengths(a, to).tolist(), seconds.tolist(), strict=True)}
        assert got == want


def test_rounds_need_no_labels_stored(spark, monkeypatch):
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"), F.lit(False).alias("same_day"), F.lit(0).alias("now"), (1 + F.col("sid") % 3).alias("max_rides"))
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    times = ("query_id", "round", "sid", "arr")
    goals = asked.select("query_id", F.explode(F.array(F.lit(4), F.lit(17)).cast("array<long>")).alias("sid"))
    until = asked.select("query_id", F.explode(F.array(F.lit(600), F.lit(1800))).alias("cutoff")).withColumn("until", 28000 + F.col("cutoff"))
    of = lambda **own: routing.arrivals(net, asked, 3, True, **own)
    every = of(ways=False)
    want = rows(every, *times), rows(every.groupBy("query_id", "sid").agg(F.min("arr").alias("arr")), "query_id", "sid", "arr"), rows(every.join(goals, ["query_id", "sid"]), *times)
    hit = every.groupBy("query_id", "sid").agg(F.min("arr").alias("arr")).join(until, "query_id").where("arr <= until")
    counts = rows(hit.groupBy("query_id", "cutoff").count(), "query_id", "cutoff", "count")
    front = rows(routing.pareto(of(targets=goals), goals, 3), "query_id", "round", "sid", "arr", "legs")
    monkeypatch.setattr(timetable, "ridden", None)
    assert rows(of(ways=False, only="all"), *times) == want[0]
    assert rows(of(ways=False, only="best"), "query_id", "sid", "arr") == want[1]
    assert rows(of(ways=False, targets=goals, every=True, only="goals").join(goals, ["query_id", "sid"]), *times) == want[2]
    assert rows(of(ways=False, only="counts", cutoffs=until), "query_id", "cutoff", "n") == counts and len(counts) > 30
    assert rows(of(ways=False, only="reached", cutoffs=until), "query_id", "cutoff", "n") == counts
    labels = of(targets=goals, only="goals")
    assert rows(routing.pareto(labels, goals, 3), "query_id", "round", "sid", "arr", "legs") == front and len(front) >= 20
    assert labels.count() < every.count() / 2


def test_rounds_on_positions_equal_rounds_on_footpaths(spark, monkeypatch):
    stops = spark.createDataFrame([(s, 35.0 + (s * 7 % 40) * 0.0008, 139.0 + (s * 3 % 40) * 0.0008) for s in range(40)], "sid long, lat double, lon double")
    lines = spark.createDataFrame([(1, k + 1, k, 60 * k, 60 * k) for k in range(25)], "pid long, seq int, sid long, arr long, dep long")
    runs = spark.createDataFrame([(t, 1, 27000 + 200 * t) for t in range(20)], "tid long, pid long, start long")
    net = Network(stops, None, None, None, walk_transfers(stops, 500.0), None, None, lines=lines, runs=runs)
    asked = stops.select(F.col("sid").alias("query_id"), "sid", F.lit(28000).alias("dep"))
    goals = asked.select("query_id", F.lit(33).cast("long").alias("sid"))
    front = lambda n: sorted((tuple(r) for r in routing.pareto(routing.arrivals(n, asked, 2, targets=goals, only="goals"), goals, 2).collect()), key=str)
    want = front(net)
    monkeypatch.setattr(footpaths, "MOST_FOOTPATHS", 10)
    # Positions take the place of the table, which is not read then.
    assert front(replace(net, transfers=None, walk_m=500.0)) == want and any(x.mode == "walk" for r in want for x in r[4])


def test_least_rides_in_large_groups_are_no_more_than_they_take(monkeypatch):
    rng = np.random.default_rng(2)
    n = 400
    group = timetable.Group(np.arange(n), 35 + rng.random(n) * 0.1, 139 + rng.random(n) * 0.1)
    own = np.where(rng.random(n) < 0.2, timetable._NEVER, rng.integers(0, 4000, n))
    exact = (group.times(np.arange(n), np.arange(n)) + own).min(axis=1)
    monkeypatch.setattr(timetable, "MOST_MEMBERS", 10)
    monkeypatch.setattr(timetable, "NEAREST", 8)
    least = group.least(own)
    assert (least <= exact).all() and least.min() >= FLEX_BOARD_S and np.median(exact - least) < 200


def test_flexible_arrivals_are_those_of_the_joins_and_are_not_moved(spark, monkeypatch):
    net = network(spark)
    asked = net.stops.select(F.col("sid").alias("query_id"), F.lit(True).alias("same_day"), (27600 + F.col("sid") * 20).alias("now"))
    start = net.stops.select(F.col("sid").alias("query_id"), F.explode(F.array(F.col("sid"), (F.col("sid") + 5) % 20)).alias("sid"), F.lit(28450).cast("long").alias("arr"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "sid", "arr").collect()))
    made = routing.flex_arrivals(start, net, asked)
    want = routing.flex_ride(start, net, asked).groupBy("query_id", "sid").agg(F.min("arr").alias("arr"))
    assert rows(made) == rows(want) and len(rows(want)) > 100
    # What is reached leaves the task that found it: only what is asked is dealt, by request.
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("MapInArrow") and "sid#" not in "".join(x.split("hashpartitioning(")[1] for x in plan.splitlines() if "hashpartitioning(" in x)
    monkeypatch.setattr(timetable, "MOST_ROWS", 5)
    assert rows(routing.flex_arrivals(start, net, asked)) == rows(want)


def test_earliest_trips_on_lines_need_no_stop_times(spark):
    net = network(spark)
    calls = net.stops.select(F.explode(F.array(*(F.lit(k).cast("long") for k in range(12)))).alias("k"), "sid").select((F.col("k") * 100 + F.col("sid")).alias("query_id"), "sid", (27000 + F.col("k") * 411).alias("at"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "sid", "rid", "seq", "dep", "tid").collect()))
    got = rows(earliest_trips_on_lines(calls, net.lines, net.runs))
    assert got == rows(earliest_trips(calls, net.stop_times)) and 150 < len(got) < 12 * 21


def test_ids_of_many_trips_of_few_routes_hash_no_lists_of_trips(spark):
    rides = legs.named(spark.createDataFrame([(1, 5, 9, [6, 7], None), (2, 7, 5, [], None)], "rid long, from_sid long, to_sid long, mids array<long>, grp int"))
    trips = spark.range(200).select(F.col("id").alias("query_id"), (F.col("id") % 2 + 1).alias("rid"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "kind", "id").collect()))
    got = legs.ids(trips.join(rides.select("rid", "shape"), "rid"), rides)
    assert rows(got) == rows(legs.ids(trips.join(rides.drop("shape"), "rid"))) and len(rows(got)) == 100 * 5 + 100 * 3
