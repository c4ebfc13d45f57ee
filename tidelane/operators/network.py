"""Tables that routing reads: patterns, orders of trips, walking transfers, nearby stops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.geo import haversine_m, walk_seconds
from tidelane.storage import Tables


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def within_radius(left: DataFrame, right: DataFrame, metres: float, max_abs_lat: float = 60.0) -> DataFrame:
    """Pairs of rows at most ``metres`` apart, with ``metres``; both sides have lat, lon.

    A range join: the right side is put into grid cells, ``FINE`` to a radius, the left side
    into its own and those around, as many to the east and west as the radius spans at the
    row's own latitude, so only cells in reach meet by equality.
    """
    north = metres / 111_000.0
    east = north / max(0.05, math.cos(math.radians(max_abs_lat)))
    rows, cols = north / FINE, east / FINE
    near = F.array(*(F.lit(k) for k in range(-FINE, FINE + 1)))
    span = _span(F.lit(north))
    a = left.withColumn("__y", F.explode(near)).withColumn("__x", F.explode(F.sequence(_cell(F.col("lon") - span, cols), _cell(F.col("lon") + span, cols))))
    a = a.withColumn("__y", F.col("__y") + _cell(F.col("lat"), rows)).withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    b = right.withColumns({"__y": _cell(F.col("lat"), rows), "__x": _cell(F.col("lon"), cols)})
    d = haversine_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    return met(a, b, "__y", "__x").withColumn("metres", d).where(F.col("metres") <= metres).drop("__y", "__x", "lat", "lon").withColumnsRenamed({"__lat": "lat", "__lon": "lon"})


#: Cells of a grid to a radius.
FINE = 2


def _span(north: Column) -> Column:
    """Degrees of longitude that so many degrees of latitude span at the row's own latitude."""
    ratio = F.sin(F.radians(north)) / F.cos(F.radians("lat"))
    return F.when(F.abs("lat") + north < 90, F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(F.lit(180.0))


def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """``left`` and ``right`` joined by ``keys``, dealt to as many tasks as shuffles have.

    For joins that make many rows of few: by the size of what goes in, such rows would be broadcast to the few
    tasks that read the other side, or their partitions put together.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), list(keys))


#: Radii that :func:`nearest` looks within: the widest one, halved so many times.
HALVINGS = 9


def nearest(left: DataFrame, right: DataFrame, widest: float, by: tuple[str, ...] = (), max_abs_lat: float = 60.0) -> DataFrame:
    """Pairs of rows with ``metres``: of each row of ``left`` (lat, lon, radius, most) at least its ``most`` nearest of ``right`` (lat, lon) within its radius, with all that are as far by whole metres.

    Where stops are dense few of a radius are asked for, so each row looks no further than it has to: stops are
    counted in grids of halved radii, and a row takes the smallest radius that surely holds enough.  ``by``: columns
    of both sides that have to be equal.  No ``radius`` may be over ``widest``.
    """
    radii = [widest / 2**k for k in range(HALVINGS + 1)]
    level = F.explode(F.array(*(F.lit(k) for k in range(len(radii)))))
    at = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("__level") + 1)
    # Three by three cells a third of a radius wide around a row's own lie within the radius, some of it to spare.
    side = at([r / 3.0 / 111_200.0 for r in radii])
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    shifts = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1))))
    counts = right.select(*by, "lat", "lon", level.alias("__level")).groupBy(*by, "__level", cell("lat", side).alias("__y"), cell("lon", side).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counts.withColumn("__s", shifts).groupBy(*by, "__level", (F.col("__y") + F.col("__s.y")).alias("__y"), (F.col("__x") + F.col("__s.x")).alias("__x")).agg(F.sum("__n").alias("__n"))
    own = left.withColumn("__row", F.monotonically_increasing_id())
    seen = own.withColumn("__level", level).withColumns({"__y": cell("lat", side), "__x": cell("lon", side)}).join(blocks.hint("merge"), [*by, "__level", "__y", "__x"], "left")
    enough = F.min(F.when(F.col("__n") >= F.col("most"), at(radii))) + 1  # whole metres may be rounded up
    own = seen.groupBy("__row", *left.columns).agg(enough.alias("__enough")).drop("__row")
    own = own.withColumn("__within", F.least("radius", "__enough"))
    norths = [(r + 1) / 111_000.0 for r in radii]
    north, east = at(norths), at([n / max(0.05, math.cos(math.radians(max_abs_lat))) for n in norths])
    fit = F.greatest(F.lit(0), F.size(F.filter(F.array(*(F.lit(r + 1) for r in radii)), lambda r: r >= F.col("__within"))) - 1)
    a = own.withColumn("__level", fit)
    span = _span(north)
    a = a.withColumn("__y", F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))).withColumn("__x", F.explode(F.sequence(F.floor((F.col("lon") - span) / east).cast("long"), F.floor((F.col("lon") + span) / east).cast("long"))))
    a = a.withColumn("__y", F.col("__y") + cell("lat", north)).withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    b = right.withColumn("__level", level).withColumns({"__y": cell("lat", north), "__x": cell("lon", east)})
    d = haversine_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    found = met(a, b, *by, "__level", "__y", "__x").withColumn("metres", d).where(F.col("metres") <= F.col("__within"))
    return found.drop("__level", "__y", "__x", "__enough", "__within", "lat", "lon").withColumnsRenamed({"__lat": "lat", "__lon": "lon"})


def walk_transfers(stops: DataFrame, metres: float) -> DataFrame:
    """Directed footpaths (a, b, metres, seconds) between stops at most so far apart."""
    pairs = within_radius(stops.select(F.col("sid").alias("a"), "lat", "lon"), stops.select(F.col("sid").alias("b"), "lat", "lon"), metres).where("a <> b")
    d = F.round("metres", 3)
    return pairs.select("a", "b", d.alias("metres"), F.ceil(walk_seconds(d)).cast("long").alias("seconds"))


def _patterns_named(trips: DataFrame) -> DataFrame:
    return trips.where(F.size("ids") > 1).withColumn("stops", F.array_join(F.col("ids").cast("array<string>"), ","))


def split_patterns(stop_times: DataFrame) -> DataFrame:
    """(tid, rid, stops, pattern): trips of a route with the same stop list share a pattern; trips of one stop have none."""
    named = _patterns_named(stop_times.groupBy("tid", "rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sid"))), lambda s: s["sid"]).alias("ids")))
    lists = named.select("rid", "stops").distinct().withColumn("pattern", F.sha2(F.concat_ws("|", F.col("rid").cast("string"), "stops"), 256))
    return named.join(lists, ["rid", "stops"]).select("tid", "rid", "stops", "pattern")


def stop_lists(patterns: DataFrame) -> DataFrame:
    """(rid, ids): the stops of each route in order."""
    return patterns.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sid"))), lambda s: s["sid"]).alias("ids"))


def patterns_of_trips(trips: DataFrame, patterns: DataFrame) -> DataFrame:
    """:func:`split_patterns` where every trip (tid, rid) calls at all stops of its route (rid, seq, sid): lists are made once a route, and stop times are not gathered."""
    lists = _patterns_named(stop_lists(patterns)).withColumn("pattern", F.sha2(F.concat_ws("|", F.col("rid").cast("string"), "stops"), 256))
    return trips.select("tid", "rid").join(F.broadcast(lists.drop("ids")), "rid").select("tid", "rid", "stops", "pattern")


def trip_order(stop_times: DataFrame) -> DataFrame:
    """(rid, tid, first_dep, ord): trips of a route by departure at their first stop."""
    first = stop_times.groupBy("rid", "tid").agg(F.min_by("dep", "seq").alias("first_dep"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("rid").orderBy("first_dep", "tid")))


#: Positions with calls that are sent to every task, at most.
MOST_POSITIONS = 1_000_000


def earliest_trips(calls: DataFrame, stop_times: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """As-of join: for each call (query_id, sid, at) and route position the first departure from ``at`` on; ties go to the smaller trip.

    Departures fall between the times of the calls at their position, and of those between two times only the first
    counts: they are aggregated where they are, and what moves grows with the calls, not with the stop times.  With a
    column ``day`` on both sides only departures of the call's day count.  ``positions``: the distinct (sid, rid, seq) of
    ``stop_times``, if they are known.
    """
    days = ["day"] if "day" in calls.columns and "day" in stop_times.columns else []
    by = [*days, "sid", "rid", "seq"]
    tables = Tables(calls.sparkSession)
    positions = stop_times.select("sid", "rid", "seq").distinct() if positions is None else positions
    asked = tables.keep("asked", calls.select("query_id", "sid", *days, F.col("at").cast("long").alias("at")).join(positions, "sid").select("query_id", *by, "at"))
    times = tables.keep("times", asked.groupBy(*by).agg(F.array_sort(F.collect_set("at")).alias("ats")))
    few = times.count() <= MOST_POSITIONS
    runs = stop_times.select(*by, F.col("dep").cast("long").alias("dep"), F.col("tid").cast("long").alias("tid"))
    runs = runs.join(F.broadcast(times) if few else times.hint("merge"), by).where(F.col("dep") >= F.get("ats", F.lit(0)))
    at = F.when(F.size("ats") == 1, F.get("ats", F.lit(0))).otherwise(F.get("ats", F.size(F.filter("ats", lambda t: t <= F.col("dep"))) - 1))
    # Departure and trip as one number: the least of a struct would sort all rows, that of a number is kept by hash.
    above = F.expr("10000000000000000000BD")
    both = (F.col("dep").cast("decimal(18,0)") * above + F.col("tid").cast("decimal(19,0)")).cast("decimal(38,0)")
    firsts = runs.groupBy(*by, at.alias("at")).agg(F.min("dep").alias("dep"), F.min(both).alias("both"))
    tid = (F.col("both") - F.col("dep").cast("decimal(18,0)") * above).cast("long")
    firsts = firsts.select(*by, "at", F.struct("dep", tid.alias("tid")).alias("d"))
    own = times.select(*by, F.explode("ats").alias("at")).join(firsts, [*by, "at"], "left")
    own = own.withColumn("first", F.min("d").over(Window.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))).where("first IS NOT NULL")
    found = asked.join(own.select(*by, "at", "first").hint("merge"), [*by, "at"])
    return found.select("query_id", "sid", "rid", "seq", F.col("first.dep").alias("dep"), F.col("first.tid").alias("tid"))


def earliest_trips_on_lines(calls: DataFrame, lines: DataFrame, runs: DataFrame) -> DataFrame:
    """:func:`earliest_trips` where trips (tid, pid, start) start on lines (pid, seq, sid, dep), without their stop times.

    A position's first departure is that of the first trip that starts so much before; of trips that start together the
    smallest counts. What is asked of a line meets its starts by spans of ``SPAN`` seconds: those of a span in order, then the first of a later one.
    """
    tables = Tables(calls.sparkSession)
    starts = tables.keep("starts", runs.groupBy("pid", F.col("start").cast("long").alias("t")).agg(F.min(F.col("tid").cast("long")).alias("tid")))
    asked = calls.join(lines, "sid").select("query_id", "sid", F.col("pid"), "seq", F.col("dep").cast("long").alias("on"), (F.col("at") - F.col("dep")).cast("long").alias("t"))
    asked = tables.keep("asked", asked)
    span = F.floor(F.col("t") / SPAN).cast("long").alias("span")
    first = F.min(F.struct("t", "tid"))
    spans = starts.groupBy("pid", span).agg(first.alias("first")).unionByName(asked.select("pid", span, F.lit(None).cast("struct<t:bigint,tid:bigint>").alias("first")).distinct())
    # Of each span the first start of any later one; spans without starts ask for it, too.
    later = spans.groupBy("pid", "span").agg(F.min("first").alias("first"))
    later = later.select("pid", "span", F.first("first", ignorenulls=True).over(Window.partitionBy("pid").orderBy("span").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    each = asked.select("pid", span, "t").distinct().withColumn("x", F.lit(None).cast("struct<t:bigint,tid:bigint>")).unionByName(starts.select("pid", span, "t", F.struct("t", "tid").alias("x")))
    since = Window.partitionBy("pid", "span").orderBy(F.desc("t"), F.col("x").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = each.withColumn("own", F.last("x", ignorenulls=True).over(since)).where("x IS NULL").join(later, ["pid", "span"]).select("pid", "t", F.coalesce("own", "later").alias("x")).where("x IS NOT NULL")
    return asked.join(found, ["pid", "t"]).select("query_id", "sid", F.col("pid").alias("rid"), "seq", (F.col("x.t") + F.col("on")).alias("dep"), F.col("x.tid").alias("tid"))


#: Seconds of starts that meet what is asked of a line.
SPAN = 600


def unovertaken(stop_times: DataFrame) -> DataFrame:
    """(rid, tid, ord): the order of trips (:func:`trip_order`), null for routes where it is not the order of arrivals and departures, ties by trip, at every position, or where trips differ in their positions or stops."""
    ranks = trip_order(stop_times)
    ahead = Window.partitionBy("rid", "seq").orderBy("ord")
    before = lambda c: F.lag(c).over(ahead)
    behind = lambda c: (F.col(c) < before(c)) | ((F.col(c) == before(c)) & (F.col("tid") < before("tid")))
    each = stop_times.select("rid", "tid", "seq", "sid", "arr", "dep").join(ranks.drop("first_dep"), ["rid", "tid"])
    each = each.withColumn("late", F.coalesce(behind("arr") | behind("dep") | (F.col("sid") != before("sid")), F.lit(False)))
    positions = each.groupBy("rid", "seq").agg(F.max("late").alias("late"), F.count(F.lit(1)).alias("n"), F.max("ord").alias("most"))
    routes = positions.groupBy("rid").agg((F.max("late") | (F.min("n") < F.max("most"))).alias("late"))
    return ranks.join(routes, "rid").select("rid", "tid", F.when(~F.col("late"), F.col("ord")).alias("ord"))


#: Seconds of a slot of departures: few of a position fall into one.
SLOT = 300


def departures_by_slot(stop_times: DataFrame, ranks: DataFrame, first: int = 0) -> DataFrame:
    """(sid, slot, [day,] rid, seq, deps, next): for each route position and slot of ``SLOT`` seconds its departures (dep, tid, ord) in order, and the first one after the slot.

    ``ord`` is the trip's place in its route (:func:`trip_order`), or null where trips of the route overtake each other.

    There is a row for every slot from that of the time ``first`` up to the last departure, so whoever is at a stop at some time
    finds the next departure of all its positions by equality of stop and slot.
    """
    by = [*(["day"] if "day" in stop_times.columns else []), "sid", "rid", "seq"]
    placed = stop_times.join(ranks, ["rid", "tid"])
    each = placed.select(*by, F.struct(F.col("dep").cast("long").alias("dep"), F.col("tid").cast("long").alias("tid"), "ord").alias("d"), F.floor(F.col("dep") / SLOT).cast("int").alias("slot"))
    slots = each.groupBy(*by, "slot").agg(F.array_sort(F.collect_list("d")).alias("deps"))  # one position, one slot
    earlier = F.lag("slot", 1, first // SLOT - 1).over(Window.partitionBy(*by).orderBy("slot"))
    # Every slot since the departures before shows these as the next ones, but their own slot shows them as its own.
    slots = slots.withColumns({"since": earlier + 1, "after": F.lead(F.element_at("deps", 1)).over(Window.partitionBy(*by).orderBy("slot"))})
    filled = slots.withColumn("h", F.explode(F.sequence("since", "slot")))
    here = F.col("h") == F.col("slot")
    return filled.select(*by, F.col("h").alias("slot"), F.when(here, F.col("deps")).otherwise(F.slice("deps", 1, 0)).alias("deps"), F.when(here, F.col("after")).otherwise(F.element_at("deps", 1)).alias("next"))


def trip_calls(stop_times: DataFrame) -> DataFrame:
    """(tid, calls array<struct<seq, sid, arr>>), the calls of each trip in order."""
    return stop_times.groupBy(F.col("tid").cast("long").alias("tid")).agg(F.array_sort(F.collect_list(F.struct(F.col("seq"), F.col("sid").cast("long").alias("sid"), F.col("arr").cast("long").alias("arr")))).alias("calls"))


def times_of(network, trips: DataFrame) -> DataFrame:
    """(tid, rid, seq, sid, arr, dep): the stop times of ``trips`` (tid) alone; where trips start on lines those of others are not made."""
    asked = trips.select("tid").distinct()
    if network.lines is None:
        return network.stop_times.join(asked, "tid", "left_semi")
    at = lambda c: (F.col("start") + F.col(c)).alias(c)
    return network.runs.join(asked, "tid", "left_semi").join(network.lines, "pid").select("tid", F.col("pid").alias("rid"), "seq", "sid", at("arr"), at("dep"))
