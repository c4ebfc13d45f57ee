"""What shows only where stops are many: points on the edges of a hull, nearest stops in dense places, walks between them."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import clock
from tidelane.functions.geo import haversine_m
from tidelane.operators import isochrone, legs, network, search


def test_points_on_the_edges_of_a_hull(spark):
    at = [(139.3 + x * 0.0001, 35.7 + y * 0.0001) for x in range(8) for y in range(8) if x + y < 12]
    want = {p for p in at if round((p[0] - 139.3) * 1e4) in (0, 7) or round((p[1] - 35.7) * 1e4) in (0, 7) or round((p[0] - 139.3) * 1e4) + round((p[1] - 35.7) * 1e4) == 11}
    got = isochrone.hull(at, on_edges=True)
    assert len(got) == len(set(got)) and set(got) == want
    assert len(isochrone.hull(at)) < len(want)
    line = [(139.3 + k * 0.0001, 35.7) for k in range(5)]
    assert sorted(isochrone.hull(line, on_edges=True)) == line and isochrone.hull(line) == []
    stops = spark.createDataFrame([(k, lat, lon) for k, (lon, lat) in enumerate(at)], "sid long, lat double, lon double").repartition(5)
    reached = stops.selectExpr("1L AS query_id", "0 AS cutoff", "sid")
    ring = isochrone.hulls(reached, stops, on_edges=True).first().ring
    assert {(p.lon, p.lat) for p in ring} == want and len(ring) == len(want) + 1


def broadcast_rows(spark, since: int) -> list[int]:
    """Rows of the broadcasts of all executions from number ``since`` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    listed = store.executionsList()
    for i in range(since, listed.size()):
        number = listed.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while node.name() == "BroadcastExchange" and metrics.hasNext():
                metric = metrics.next()
                shown = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and shown.isDefined():
                    out.append(int(shown.get().replace(",", "")))
    return out


def test_postings_of_names_are_never_broadcast(spark, tmp_path):
    spark.range(3000).selectExpr("id", "concat('name of stop ', id) AS name").write.parquet(f"{tmp_path}/names")
    spark.range(2000).selectExpr("id AS query_id", "concat('stop ', id % 3) AS q").write.parquet(f"{tmp_path}/asked")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    found = search.by_name(spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/asked"), 5).collect()
    assert len(found) == 7332 and {(r.id, r["rank"]) for r in found if r.query_id == 4} == {(1, 1), (10, 2), (11, 3), (12, 4), (13, 5)}
    assert max(broadcast_rows(spark, since)) <= 15


def test_nearest_looks_no_further_than_it_has_to(spark):
    rnd = random.Random(5)
    at = [(k, 35.7 + rnd.randrange(200) * 1e-5, 139.3 + rnd.randrange(200) * 1e-5) for k in range(3000)] + [(9000 + k, 35.9 + k * 0.003, 139.3) for k in range(3)]
    stops = spark.createDataFrame(at, "sid long, lat double, lon double")
    points = spark.createDataFrame([(k, 35.7 + rnd.randrange(200) * 1e-5, 139.3 + rnd.randrange(200) * 1e-5) for k in range(40)] + [(90, 35.9, 139.3), (91, 36.5, 139.3)], "query_id long, lat double, lon double")
    pairs = network.nearest(points.selectExpr("*", "800.0D AS radius", "20 AS most"), stops, 800.0)
    assert pairs.count() < 40 * 600  # all are within 800 m of each other
    every = points.crossJoin(stops.toDF("sid", "lat2", "lon2")).withColumn("m", haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where("m <= 800").withColumn("metres", F.round("m").cast("long"))
    order = Window.partitionBy("query_id").orderBy("metres", "sid")
    want = every.withColumn("rank", F.row_number().over(order)).where("rank <= 20").select("query_id", "sid", "metres", "rank")
    got = search.by_radius(stops, points, 800.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_are_dealt_to_all_tasks(spark):
    stops = spark.createDataFrame([(k, 35.7 + k % 50 * 1e-4, 139.3 + k // 50 * 1e-4) for k in range(2000)], "sid long, lat double, lon double").coalesce(1)
    walks = network.walk_transfers(stops, 100.0)
    used = walks.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(used) > 4 and max(r["count"] for r in used) < sum(r["count"] for r in used) / 2


def test_times_are_matched_once(spark):
    rows = [("9:05:07", 32707), ("25:30:00", 91800), ("100:00:59", 360059), ("9:60:00", None), ("9:5:00", None), ("", None), ("1000:00:00", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want int").select(clock.gtfs_seconds(F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("RLIKE") <= 1


def test_first_departures_move_with_the_calls(spark):
    runs = spark.range(40_000).selectExpr("id AS tid", "id % 2 AS rid", "1 AS seq", "7L AS sid", "id * 2 + 100 AS dep")
    calls = spark.createDataFrame([(1, 7, 100), (2, 7, 101), (3, 7, 79_000), (4, 7, 90_000), (5, 8, 0)], "query_id long, sid long, at long")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = network.earliest_trips(calls, runs, spark.createDataFrame([(7, 0, 1), (7, 1, 1)], "sid long, rid long, seq int")).collect()
    assert sorted((r.query_id, r.rid, r.dep, r.tid) for r in got) == [(1, 0, 100, 0), (1, 1, 102, 1), (2, 0, 104, 2), (2, 1, 102, 1), (3, 0, 79_000, 39_450), (3, 1, 79_002, 39_451)]
    assert max(shuffled_rows(spark, since)) < 1000


def shuffled_rows(spark, since: int) -> list[int]:
    store, out = spark._jsparkSession.sharedState().statusStore(), [0]
    listed = store.executionsList()
    for i in range(since, listed.size()):
        number = listed.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while node.name() == "Exchange" and metrics.hasNext():
                metric = metrics.next()
                shown = values.get(metric.accumulatorId())
                if metric.name() == "shuffle records written" and shown.isDefined():
                    out.append(int(shown.get().replace(",", "")))
    return out


def test_legs_of_a_shape_are_drawn_once(spark):
    trips = spark.range(2000).selectExpr("id AS query_id", "0 AS leg", "'transit' AS kind", "1L AS from_sid", "60L AS to_sid", "sequence(2L, 59L) AS mids", "id % 2 AS rid", "CAST(NULL AS INT) AS grp").repartition(4)
    stops = spark.range(1, 61).selectExpr("id AS sid", "35.0D + id AS lat", "139.0D AS lon")
    for made, n in ((legs.lines(trips, stops), 2000), (legs.ids(trips), 2000 * 61)):
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        made.write.format("noop").mode("overwrite").save()
        assert max(shuffled_rows(spark, since)) <= 4000 and made.count() == n


def test_patterns_of_trips_equal_those_of_stop_times(spark):
    patterns = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 6), (2, 2, 5), (3, 1, 9)], "rid long, seq int, sid long")
    trips = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 3), (14, 4)], "tid long, rid long")
    got = network.patterns_of_trips(trips, patterns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, network.split_patterns(trips.join(patterns, "rid")).collect())) and got.count() == 3
