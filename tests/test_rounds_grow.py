"""Rounds of routing keep to what can matter: boardings, walks and departures."""

import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from tidelane.operators import footpaths, network, routing
from tidelane.sources.derived import Network

TIMES = "tid long, rid long, seq int, sid long, arr long, dep long"


def line(spark, n_trips=40, n_stops=30):
    """One route without overtaking: trips every ten minutes, a minute from stop to stop; every stop has a footpath on."""
    rows = [(t, 1, k + 1, k, 28800 + 600 * t + 60 * k, 28800 + 600 * t + 60 * k) for t in range(n_trips) for k in range(n_stops)]
    times = spark.createDataFrame(rows, TIMES)
    stops = spark.createDataFrame([(s, 0, 35.0 + s * 0.01, 139.0) for s in range(n_stops)], "sid long, nk int, lat double, lon double")
    paths = spark.createDataFrame([(s, s + 1, 500.0, 490) for s in range(n_stops - 1)], "a long, b long, metres double, seconds long")
    none = spark.createDataFrame([], "ft int, grp int, ws long, we long, kind int, minutes int, last_day int, last_time int")
    return Network(stops, times.select("rid", "seq", "sid").distinct(), times.select("tid", "rid").distinct(), times, paths, stops.select(F.lit(0).alias("grp"), "sid").limit(0), none)


def test_nobody_stays_on_a_trip_beyond_an_earlier_one(spark):
    net = line(spark)
    ready = routing.prepared(net, spark.createDataFrame([], "query_id long"), flex=False)
    # Further down the line the label is later by less than the trip needs, so earlier trips can be boarded there.
    start = spark.createDataFrame([(1, s, 30600 - 40 * s, None) for s in range(30)], "query_id long, sid long, arr long, bound long")
    got = routing.ride(start, ready.departures, ready.calls).collect()
    assert len(got) == len({r.sid for r in got}) == 29  # a candidate for each stop, not one for each trip and stop
    assert ready.departures.select(F.max(F.size("deps"))).first()[0] == 1  # ten minutes apart, so one in a slot


def test_trips_that_call_elsewhere_are_not_ordered(spark):
    rows = [(1, 1, 1, 5, 0, 0), (1, 1, 2, 6, 60, 60), (2, 1, 1, 5, 100, 100), (2, 1, 2, 7, 160, 160)]  # another second stop
    rows += [(3, 2, 1, 5, 0, 0), (3, 2, 2, 6, 60, 60), (3, 2, 3, 8, 90, 90), (4, 2, 1, 5, 100, 100), (4, 2, 2, 6, 160, 160)]  # one stop less
    rows += [(8, 3, 1, 5, 0, 0), (8, 3, 2, 6, 60, 60), (7, 3, 1, 5, 10, 10), (7, 3, 2, 6, 60, 60)]  # as early, but the smaller trip is behind
    rows += [(5, 4, 1, 5, 0, 0), (5, 4, 2, 6, 60, 60), (6, 4, 1, 5, 100, 100), (6, 4, 2, 6, 160, 160)]
    got = {r.tid: r.ord for r in network.unovertaken(spark.createDataFrame(rows, TIMES)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 7: None, 8: None, 5: 1, 6: 2}


def test_what_is_walked_to_ends_at_the_bound(spark):
    net = line(spark)
    asked = spark.createDataFrame([(1, 0, 28800)], "query_id long, sid long, dep long")
    bound = spark.createDataFrame([(1, 28800 + 600)], "query_id long, bound long")
    full = {(r.sid, r.arr) for r in routing.arrivals(net, asked, rounds=2).collect()}
    cut = routing.arrivals(net, asked, rounds=2, bound=bound, ways=False).collect()
    # rides before the bound, walks up to it, as without a bound but no further
    assert {(r.sid, r.arr) for r in cut if r.arr < 29400} == {x for x in full if x[1] < 29400}
    assert all(r.arr <= 29400 for r in cut)


def test_each_target_counts_for_itself(spark):
    net = line(spark)
    asked = spark.createDataFrame([(1, 0, 28800), (2, 4, 28850)], "query_id long, sid long, dep long")
    goals = spark.createDataFrame([(q, s) for q in (1, 2) for s in (7, 20)], "query_id long, sid long")
    of = lambda df: {tuple(r) for r in df.join(goals, ["query_id", "sid"]).select("query_id", "round", "sid", "arr").collect()}
    kept = of(routing.arrivals(net, asked, rounds=3, targets=goals, ways=False, every=True))
    assert kept == of(routing.arrivals(net, asked, rounds=3)) and len(kept) == 4


def test_walks_of_arrays_equal_a_heap():
    rng = random.Random(5)
    for _ in range(60):
        n = 25
        edges = sorted({(a, b): (rng.randint(0, 9) * 20, rng.random()) for a, b in (rng.sample(range(n), 2) for _ in range(90))}.items())
        a, b = (np.array([e[0][i] for e in edges]) for i in (0, 1))
        paths = footpaths.Footpaths(np.arange(n), np.searchsorted(a, np.arange(n + 1)), b, np.array([e[1][0] for e in edges]), np.array([e[1][1] for e in edges]))
        known = {s: rng.randint(0, 900) for s in rng.sample(range(n), 8)}
        fresh = {s: rng.randint(0, 400) for s in rng.sample(range(n), 5)}
        fresh = {s: t for s, t in fresh.items() if t < known.get(s, t + 1)}
        best = {s: (t, 0, -1) for s, t in fresh.items()}
        heap = [(t, 0, -1, s) for s, t in fresh.items()]
        heapq.heapify(heap)
        while heap:
            t, hops, before, s = heapq.heappop(heap)
            if best[s] != (t, hops, before):
                continue
            for i in range(paths.start[s], paths.start[s + 1]):
                cand = (t + int(paths.seconds[i]), hops + 1, s)
                if cand[0] < known.get(int(b[i]), cand[0] + 1) and cand < best.get(int(b[i]), (10**9,)):
                    best[int(b[i])] = cand
                    heapq.heappush(heap, (*cand, int(b[i])))
        want = {s: x for s, x in best.items() if x[1]}
        rows = [(0, s, t) for s, t in fresh.items()] + [(1, s, t) for s, t in known.items()]
        got = footpaths._request(paths, *(np.array([r[i] for r in rows]) for i in range(3)), True, False)
        if got is None:
            assert not want
            continue
        sid, arr, source, hops, stops, times, metres = got
        ends = np.cumsum(hops + 1)
        assert dict(zip(sid.tolist(), zip(arr.tolist(), hops.tolist(), strict=True), strict=True)) == {s: x[:2] for s, x in want.items()}
        for s, end, k, m in zip(sid, ends, hops, np.cumsum(hops), strict=True):
            way = stops[end - k - 1:end].tolist()
            assert way[-1] == s and way[0] in fresh and [best[x][2] for x in way[1:]] == way[:-1] and [best[x][0] for x in way] == times[end - k - 1:end].tolist()
            assert metres[m - k:m].tolist() == [dict(edges)[x][1] for x in zip(way, way[1:], strict=False)]
