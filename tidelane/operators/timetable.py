"""Riding from what a round before has reached, request by request, where the timetable is small as lines and their starts.

Trips of a line differ by their start alone, so none overtakes another, and boarding is a search among the
starts of the line: a request's labels meet in one place, pass each line once from its first stop on, and are
walked on from there (:mod:`tidelane.operators.footpaths`).  Lines, starts and the members of flexible services
go to every task, so there is a bound to them; above it :func:`tidelane.operators.routing.ride` and
:func:`tidelane.operators.routing.flex_ride` do the same as joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.functions.clock import DAY
from tidelane.functions.geo import EARTH_M, FLEX_BOARD_S, FLEX_DETOUR, FLEX_M_PER_S
from tidelane.operators import footpaths

#: Positions of lines, starts (of each asked day) and members that are sent to every task, at most.
MOST_ROWS = 2_000_000

#: Members of a group up to which the times between all of them are kept, and sources that are looked at together.
MOST_MEMBERS, BLOCK = 2048, 16

#: Members of larger groups whose rides to goals are looked at one by one, and degrees of the cells that the others are put together by.
NEAREST, CELL = 64, 0.01

#: Directions of furthest points, counter-clockwise, and twice the area in square degrees by which a point has to lie inside of an edge between them.
DIRECTIONS, INSIDE = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)), 1e-10

#: Sets of goals that a task knows the way to at once.
MOST_GOALS = 64

_NEVER = 1 << 40


@dataclass
class Starts:
    """Trips in the order of line, start and number; ``key`` is line and start as one number, ``end[i]`` the end of line i."""

    key: np.ndarray
    start: np.ndarray
    tid: np.ndarray
    end: np.ndarray


@dataclass
class Group:
    """Members of a group in the order of their stops (places in the timetable's stops)."""

    places: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    seconds: np.ndarray | None = None

    def times(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Seconds of a ride from each of ``some`` to each of ``others``; never to the member itself."""
        if len(self.places) <= MOST_MEMBERS:
            if self.seconds is None:
                every = np.arange(len(self.places))
                self.seconds = self._times(every, every)
            return self.seconds[np.ix_(some, others)]
        return self._times(some, others)

    def reached(self, some: np.ndarray, arr: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members that a ride from one of ``some`` (labels ``arr``) reaches before their ``limit``: which, when, and from where; of those as early from the smaller stop.

        Who arrives where somebody before them could have ridden to by then is left out: from there on it is sooner
        to ride directly, as the time to board is spent once.
        """
        n, limit = len(self.places), limit.copy()
        best, some = np.full(n, _NEVER * n), some[np.argsort(arr[some], kind="stable")]
        while len(some):
            part, some = some[:BLOCK], some[BLOCK:]
            to = np.flatnonzero(limit > int(arr[part[0]]) + int(FLEX_BOARD_S))
            if not len(to):
                break
            # Arrival and the member of boarding as one number.
            cand = ((arr[part][:, None] + self.times(part, to)) * n + part[:, None]).min(axis=0)
            soon, ahead = cand // n, np.full(n, _NEVER)
            good = (soon < limit[to]) & (cand < best[to])
            best[to[good]] = cand[good]
            limit[to[good]] = soon[good] + 1
            ahead[to] = soon
            some = some[arr[some] < ahead[some] - (int(FLEX_BOARD_S) - 2)]  # two seconds, as times are rounded up
        to = np.flatnonzero(best < _NEVER * n)
        return to, best[to] // n, best[to] % n

    def least(self, own: np.ndarray) -> np.ndarray:
        """Of each member no more than the least sum of a ride to another and that one's ``own``: to the ``NEAREST`` by these exactly, to the others by cells."""
        every = np.arange(len(self.places))
        if len(every) <= MOST_MEMBERS:
            return (self.times(every, every) + own).min(axis=1)
        order = np.argsort(own, kind="stable")
        near, far = order[:NEAREST], order[NEAREST:]
        best = np.full(len(every), 2 * _NEVER)
        for k in range(0, len(near), BLOCK):
            np.minimum(best, (self._times(every, near[k:k + BLOCK]) + own[near[k:k + BLOCK]]).min(axis=1), out=best)
        if len(far := far[own[far] < _NEVER]):
            _, cell = np.unique(np.stack([np.floor(self.lat[far] / CELL), np.floor(self.lon[far] / CELL)]), axis=1, return_inverse=True)
            cell = cell.ravel()
            n = int(cell.max()) + 1
            sizes, low = np.bincount(cell, minlength=n), np.full(n, 2 * _NEVER)
            np.minimum.at(low, cell, own[far])
            mid = Group(np.full(n, -1), np.bincount(cell, self.lat[far], n) / sizes, np.bincount(cell, self.lon[far], n) / sizes)
            # No member of a cell is further from its middle than this in either direction, by degrees of latitude, which are the longest.
            spread = np.zeros(n)
            np.maximum.at(spread, cell, np.hypot(self.lat[far] - mid.lat[cell], self.lon[far] - mid.lon[cell]))
            within = np.radians(spread) * EARTH_M * 1.01 * FLEX_DETOUR / FLEX_M_PER_S + 2
            both = Group(np.append(self.places, mid.places), np.append(self.lat, mid.lat), np.append(self.lon, mid.lon))
            for k in range(0, n, BLOCK):
                cells = np.arange(k, min(k + BLOCK, n))
                ride = np.maximum(both._times(every, len(every) + cells) - np.ceil(within[cells]).astype(np.int64), int(FLEX_BOARD_S))
                np.minimum(best, (ride + low[cells]).min(axis=1), out=best)
        return best

    def _times(self, some: np.ndarray, others: np.ndarray) -> np.ndarray:
        lat1, lat2, dlon = np.radians(self.lat[some])[:, None], np.radians(self.lat[others]), np.radians(self.lon[others] - self.lon[some][:, None])
        a = np.sin(np.radians(self.lat[others] - self.lat[some][:, None]) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(dlon / 2) ** 2
        metres = np.round(2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(a, 1.0))), 3)
        out = np.ceil(metres * FLEX_DETOUR / FLEX_M_PER_S + FLEX_BOARD_S).astype(np.int64)
        out[self.places[some][:, None] == self.places[others]] = _NEVER
        return out


@dataclass
class Timetable:
    """Positions in the order of lines: ``place`` in ``stops``, seconds from the start of a trip to its arrival and departure there."""

    stops: np.ndarray
    line: np.ndarray
    place: np.ndarray
    arr: np.ndarray
    dep: np.ndarray
    low: int
    span: int
    starts: dict[int, Starts]
    groups: dict[int, Group] = field(default_factory=dict)
    #: ft, grp, ws, we, kind, minutes, last_day, last_time in the order of ft, and the days of each (None: daily).
    services: list[tuple] = field(default_factory=list)
    days: dict[int, set[int]] | None = None
    dated: bool = False
    #: What is left to walk and ride to goals that several requests asked for (None: one did so far), and footpaths the other way.
    left: dict[tuple, list[np.ndarray] | None] = field(default_factory=dict)
    turned: footpaths.Footpaths | None = None
    #: Positions in the order of their stops, where those of each stop begin, and where each line does.
    calls: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    #: Latitudes and longitudes of ``stops``, where they are asked for (and not a number for those without).
    spots: tuple[np.ndarray, np.ndarray] | None = None

    def outer(self, sids: np.ndarray) -> np.ndarray:
        """``sids`` without those that surely lie inside the polygon of their furthest ones in eight directions."""
        at = np.minimum(np.searchsorted(self.stops, sids), max(len(self.stops) - 1, 0))
        if self.spots is None or not (own := self.stops[at] == sids).any():
            return sids
        y, x = (np.where(own, c[at], np.nan) for c in self.spots)
        if np.isnan(x).all():
            return sids
        far = [int(np.nanargmax(x * i + y * j)) for i, j in DIRECTIONS]
        inside, alone = np.ones(len(sids), bool), True
        for a, b in zip(far, [*far[1:], far[0]], strict=True):
            if x[a] != x[b] or y[a] != y[b]:
                alone = False
                inside &= (x[b] - x[a]) * (y - y[a]) - (y[b] - y[a]) * (x - x[a]) > INSIDE
        return sids if alone else sids[~inside]

    def rides(self, day: int, labels: np.ndarray) -> list[np.ndarray]:
        """Candidates (place, arr, mode, trip, from_sid, dep, due) on vehicles from ``labels``, the arrivals at ``stops``."""
        own = self.starts.get(day if self.dated else 0)
        if self.calls is None:
            order = np.argsort(self.place, kind="stable")
            self.calls = order, np.searchsorted(self.place[order], np.arange(len(self.stops) + 1)), np.append(np.flatnonzero(np.diff(self.line, prepend=-1)), len(self.line))
        order, since, begin = self.calls
        some = np.flatnonzero(labels < _NEVER)
        n = since[some + 1] - since[some]
        touched = np.unique(self.line[order[np.arange(n.sum()) + np.repeat(since[some] - (np.cumsum(n) - n), n)]])
        if own is None or not len(touched):
            return [np.zeros(0, np.int64)] * 7
        if len(touched) * 2 > len(begin) - 1:
            return self._rides(own, labels)
        # Few lines are boarded, so the others are not looked at.
        at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in touched])
        part = Timetable(self.stops, self.line[at], self.place[at], self.arr[at], self.dep[at], self.low, self.span, {})
        return part._rides(own, labels)

    def _rides(self, own: Starts, labels: np.ndarray) -> list[np.ndarray]:
        here = labels[self.place]
        on = np.flatnonzero(here < _NEVER)
        none = len(own.key)
        first = np.searchsorted(own.key, self.line[on] * self.span + np.clip(here[on] - self.dep[on] - self.low, 0, self.span - 1))
        rank = np.full(len(self.line), none)
        rank[on] = np.where(first < own.end[self.line[on]], first, none)
        # The earliest trip from the first stop on; each line lies below all lines before, so it begins anew.
        down = self.line * (none + 1)
        best = np.minimum.accumulate(rank - down)
        sooner = np.ones(len(best), bool)
        sooner[1:] = best[1:] < best[:-1]
        boarded = np.maximum.accumulate(np.where(sooner, np.arange(len(best)), 0))
        off = np.flatnonzero(self.line[1:] == self.line[:-1]) + 1
        trip = best[off - 1] + down[off]
        off, trip = off[trip < none], trip[trip < none]
        at = boarded[off - 1]
        start = own.start[trip]
        return [self.place[off], start + self.arr[off], np.zeros(len(off), np.int64), own.tid[trip], self.stops[self.place[at]], start + self.dep[at], np.full(len(off), _NEVER)]

    def booked(self, day: int, now: int, labels: np.ndarray, before: np.ndarray) -> list[list[np.ndarray]]:
        """Candidates, as :meth:`rides`, by flexible services: those that arrive earlier than ``before``."""
        out, done = [], {}
        for ft, grp, ws, we, kind, minutes, last_day, last_time in self.services:
            if grp not in self.groups or ws is None or we is None or (self.days is not None and day not in self.days.get(ft, ())):
                continue
            group = self.groups[grp]
            arr = labels[group.places]
            due = arr - minutes * 60 if kind == 1 and minutes is not None else np.full(len(arr), last_time - (last_day or 0) * DAY if kind == 2 and last_time is not None else _NEVER)
            some = np.flatnonzero((arr < _NEVER) & (arr >= ws) & (arr <= we) & (due >= now))
            if not len(some):
                continue
            if (key := (grp, some.tobytes())) not in done:  # several services of a group are open to the same members
                done[key] = group.reached(some, arr, before[group.places])
            to, soonest, by = done[key]
            to, soonest, by = (c[soonest <= we] for c in (to, soonest, by))
            out.append([group.places[to], soonest, np.ones(len(to), np.int64), np.full(len(to), ft), self.stops[group.places[by]], arr[by], due[by]])
        return out


    def reverse(self, paths: footpaths.Footpaths | footpaths.Nearby) -> footpaths.Footpaths | footpaths.Nearby:
        if self.turned is None:
            self.turned = paths.turned()
        return self.turned

    def open(self, day: int, now: int, since: int) -> frozenset[int]:
        """Groups with a service that can be booked at ``now`` for who is there from ``since`` on."""
        out = set()
        for ft, grp, ws, we, kind, minutes, last_day, last_time in self.services:
            due = we - minutes * 60 if kind == 1 and minutes is not None and we is not None else last_time - (last_day or 0) * DAY if kind == 2 and last_time is not None else now
            if ws is not None and we is not None and we >= since and due >= now and (self.days is None or day in self.days.get(ft, ())):
                out.add(grp)
        return frozenset(out)

    def ahead(self, paths: footpaths.Footpaths, goals: np.ndarray, on: np.ndarray, rides: int, flex: bool, groups: frozenset[int] | None = None) -> list[np.ndarray] | None:
        """Of each stop the least seconds to walk to one of ``goals`` and ``on`` from there, then those with 1, 2, ... ``rides`` at most, whatever runs when (of flexible services those of ``groups`` alone).

        It takes as long as a few rounds, so goals that only one request has asked for yet have None.
        """
        order = np.lexsort((on, goals))
        key = goals[order].tobytes(), on[order].tobytes(), (frozenset(s[1] for s in self.services) if groups is None else groups) if flex else frozenset()
        if key not in self.left:
            if len(self.left) >= MOST_GOALS:
                self.left.clear()
            self.left[key] = None
            return None
        own = self.left[key]
        if own is None or len(own) <= rides:
            own = self.left[key] = self._ahead(paths, goals, on, rides, key[2], own or [])
        return own

    def _ahead(self, paths: footpaths.Footpaths, goals: np.ndarray, on: np.ndarray, rides: int, served: frozenset[int], out: list[np.ndarray]) -> list[np.ndarray]:
        self.reverse(paths)
        at = np.searchsorted(self.stops, paths.stops)

        def walked(least: np.ndarray) -> np.ndarray:
            labels = least[at] << footpaths.HOPS
            footpaths.spread(self.turned, labels, np.flatnonzero(least[at] < _NEVER))
            least[at] = labels >> footpaths.HOPS
            return least

        if not out:
            least = np.full(len(self.stops), _NEVER)
            place = np.searchsorted(self.stops, goals)
            there = (place < len(self.stops)) & (self.stops[np.minimum(place, len(self.stops) - 1)] == goals) if len(self.stops) else np.zeros(len(goals), bool)
            np.minimum.at(least, place[there], on[there])
            out = [walked(least)]
        lift = self.line * (2 * _NEVER)  # in reverse each line lies below all lines before
        on_line = np.flatnonzero(self.line[1:] == self.line[:-1])
        while len(out) <= rides:
            had, least = out[-1], out[-1].copy()
            off = np.minimum.accumulate((np.minimum(had[self.place] + self.arr, _NEVER) + lift)[::-1])[::-1] - lift
            rest = off[on_line + 1]
            np.minimum.at(least, self.place[on_line], np.where(rest < _NEVER, rest - self.dep[on_line], _NEVER))
            for grp, group in self.groups.items():
                if grp in served:
                    least[group.places] = np.minimum(least[group.places], group.least(had[group.places]))
            out.append(walked(least))
        return out


def _arrow(df: DataFrame, most: int, *columns: Column) -> pa.Table | None:
    own = df.select(*columns).limit(most + 1).toArrow()
    return own if own.num_rows <= most else None


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def gathered(network, requests: DataFrame, flex: bool, paths: footpaths.Footpaths | footpaths.Nearby | None = None, spots: bool = False) -> Timetable | None:
    """``network`` as lines and starts (on the days of ``requests``), or None if it has none or more than ``MOST_ROWS`` rows; its stops are those of ``paths``, too, with ``spots`` their positions."""
    if network.lines is None:
        return None
    dated = network.running is not None and "day" in requests.columns
    days = requests.select("day").distinct() if "day" in requests.columns else None
    runs = network.runs.join(network.running.join(days, "day", "left_semi"), "tid") if dated else network.runs.withColumn("day", F.lit(0))
    lines = _arrow(network.lines, MOST_ROWS, *_long("pid", "seq", "sid", "arr", "dep"))
    # Of trips that start together on a line the smallest is the one that counts.
    runs = runs.groupBy("day", "pid", "start").agg(F.min("tid").alias("tid"))
    starts = None if lines is None else _arrow(runs, MOST_ROWS - lines.num_rows, *_long("day", "pid", "start", "tid"))
    if starts is None:
        return None
    members = _members(network, MOST_ROWS - lines.num_rows - starts.num_rows) if flex else None
    if flex and members is None:
        return None
    lines = lines.sort_by([("pid", "ascending"), ("seq", "ascending")])
    pid, sid, arr, dep = (lines[c].to_numpy() for c in ("pid", "sid", "arr", "dep"))
    stops = np.unique(np.concatenate([sid, *([members["sid"].to_numpy()] if flex else []), *([] if paths is None else [paths.stops])]))
    pids, line = np.unique(pid, return_inverse=True)
    day, of, start, tid = (starts[c].to_numpy() for c in ("day", "pid", "start", "tid"))
    i = np.minimum(np.searchsorted(pids, of), max(len(pids) - 1, 0))
    there = pids[i] == of if len(pids) else np.zeros(len(of), bool)
    day, i, start, tid = day[there], i[there], start[there], tid[there]
    low = int(start.min(initial=0))
    span = int(start.max(initial=0)) - low + 2
    order = np.lexsort((tid, start, i, day))
    day, i, start, tid = day[order], i[order], start[order], tid[order]
    made = {}
    for d in np.unique(day).tolist():
        a, b = np.searchsorted(day, [d, d + 1])
        made[d] = Starts(i[a:b] * span + start[a:b] - low, start[a:b], tid[a:b], np.searchsorted(i[a:b], np.arange(len(pids)), side="right"))
    out = Timetable(stops, line, np.searchsorted(stops, sid), arr, dep, low, span, made, dated=dated)
    if spots and (placed := _arrow(network.stops, MOST_ROWS, *_long("sid"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon")))) is not None:
        sid, lat, lon = (placed[c].to_numpy() for c in ("sid", "lat", "lon"))
        i = np.minimum(np.searchsorted(stops, sid), max(len(stops) - 1, 0))
        own = stops[i] == sid if len(stops) else np.zeros(len(sid), bool)
        out.spots = np.full(len(stops), np.nan), np.full(len(stops), np.nan)
        out.spots[0][i[own]], out.spots[1][i[own]] = lat[own], lon[own]
    return out if not flex or _served(out, network, members, days) else None


def _members(network, most: int) -> pa.Table | None:
    own = _arrow(network.members.join(network.stops, "sid").where("lat IS NOT NULL AND lon IS NOT NULL"), most, *_long("grp", "sid"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return None if own is None else own.sort_by([("grp", "ascending"), ("sid", "ascending")])


def _served(out: Timetable, network, members: pa.Table, days: DataFrame | None) -> bool:
    """Puts groups and flexible services into ``out``; False if these are too many."""
    grp, at, lat, lon = (members[c].to_numpy() for c in ("grp", "sid", "lat", "lon"))
    for g in np.unique(grp).tolist():
        a, b = np.searchsorted(grp, [g, g + 1])
        out.groups[g] = Group(np.searchsorted(out.stops, at[a:b]), lat[a:b], lon[a:b])
    names = ("ft", "grp", "ws", "we", "kind", "minutes", "last_day", "last_time")
    services = _arrow(network.flex_trips, MOST_ROWS, *_long(*names))
    running = None
    if network.flex_running is not None and days is not None:
        running = _arrow(network.flex_running.join(days, "day", "left_semi"), MOST_ROWS, *_long("ft", "day"))
    if services is None or (running is None and network.flex_running is not None and days is not None):
        return False
    out.services = sorted(zip(*(services[c].to_pylist() for c in names), strict=True), key=lambda s: s[0])
    if running is not None:
        out.days = {}
        for ft, d in zip(running["ft"].to_pylist(), running["day"].to_pylist(), strict=True):
            out.days.setdefault(ft, set()).add(d)
    return True


def booked(network, start: DataFrame, requests: DataFrame) -> DataFrame | None:
    """(query_id, sid, arr): the earliest arrivals by one flexible ride from ``start`` (query_id, sid, arr), or None where members are too many to be sent to every task.

    They are found where a request's labels meet, and are not moved.
    """
    members = _members(network, MOST_ROWS)
    if members is None:
        return None
    none = np.zeros(0, np.int64)
    table = Timetable(np.unique(members["sid"].to_numpy()), none, none, none, none, 0, 2, {})
    if not _served(table, network, members, requests.select("day").distinct() if "day" in requests.columns else None):
        return None
    shared = start.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for q, (kind, sid, arr) in footpaths.by_request(_unpacked(batches)):
            own, asked, n = np.isin(sid, table.stops) & (kind == _START), kind == _ASKED, len(table.stops)
            best = np.full(n, _NEVER)
            for place, time in zip(np.searchsorted(table.stops, sid[own]), arr[own], strict=True):
                labels = np.full(n, _NEVER)
                labels[place] = time
                for to, soonest, *_ in table.booked(int(sid[asked].min(initial=_NEVER)), int(arr[asked].max(initial=-_NEVER)), labels, np.full(n, _NEVER)):
                    best[to] = np.minimum(best[to], soonest)
            if len(at := np.flatnonzero(best < _NEVER)):
                yield _packed([q], [[table.stops[at], best[at]]])

    lists = _dealt(_asked(start, requests, None, None, True)).mapInArrow(run, _COLUMNS[BEST])
    return lists.select("query_id", F.inline(F.arrays_zip("sids", "arrs"))).withColumnsRenamed({"sids": "sid", "arrs": "arr"})


@dataclass
class _Last:
    """The last arrivals that count: ``bound`` is when a goal is reached so far, ``walk`` the seconds to one on foot, ``ride`` those with rides, ``more`` with one ride more.

    ``clear``: the seconds to walk from the nearest of the origins.  Nobody walks on from an origin, nor through one, as its label
    is the earliest there; ways from nearer places than that meet none.
    """

    bound: int
    walk: np.ndarray
    ride: np.ndarray
    more: np.ndarray
    clear: int = _NEVER
    found: int = _NEVER

    def nearer(self, part: list[np.ndarray]) -> None:
        """Candidates of this round: walking on from them is how a goal is reached in it."""
        on = self.walk[part[0]]
        self.found = min(self.found, int((part[1] + on)[on < self.clear].min(initial=_NEVER)))

    def arrivals(self) -> np.ndarray:
        own = min(self.bound, self.found) - 1 - self.ride
        return np.maximum(own, self.found - self.walk) if self.found < self.bound else own


#: Rows of a request: what it has reached, its goals, its last time, what it rides on from, its day and time of search, and what it began with where that is not what it rides on from.
#: For several rounds also how many rides it allows, and its cutoffs with the times that they end at.
_KNOWN, _GOAL, _LAST, _START, _ASKED, _ORIGIN, _RIDES, _CUT = 1, 2, 3, 4, 5, 6, 7, 8


def _aims(table: Timetable, paths, flex: bool, every: bool, kind: np.ndarray, sid: np.ndarray, arr: np.ndarray, rides: int) -> list:
    """Which goals (by their place among the goals) count together, and :meth:`Timetable.ahead` of them; nothing where labels can't be left out by it."""
    goals = np.flatnonzero(kind == _GOAL)
    if not len(goals) or (kind == _LAST).any():
        return []
    asked = kind == _ASKED
    groups = table.open(int(sid[asked].min(initial=_NEVER)), int(arr[asked].max(initial=-_NEVER)), int(arr[kind == _START].min(initial=0))) if flex and asked.any() else None
    out = []
    for some in [[i] for i in range(len(goals))] if every else [list(range(len(goals)))]:  # with ``every`` each goal counts for itself
        ahead = table.ahead(paths, sid[goals[some]], arr[goals[some]], rides, flex, groups)
        if ahead is None:
            return []
        out.append((some, ahead))
    return out


def _round(table: Timetable, paths: footpaths.Footpaths, flex: bool, ways: bool, every: bool, kind: np.ndarray, sid: np.ndarray, arr: np.ndarray, left: int | None = None, aims: list | None = None, lead: bool = False) -> list | None:
    """One round of one request: columns of the labels that it improves, or None.

    ``aims``: of :func:`_aims`, if they are known; with ``lead`` what is walked is a :class:`tidelane.operators.footpaths.Walk`, of which few ways are asked for.

    ``left``: the rounds that follow at most.  With them, and goals of which the nearest counts, labels are left out from which
    no goal can be reached earlier than it is; what leads to a goal, or is as early where one begins, stays.
    """
    n = len(table.stops)
    origin = kind == (_ORIGIN if (kind == _ORIGIN).any() else _START)
    kind = np.where(kind == _ORIGIN, _KNOWN, kind)
    at = np.minimum(np.searchsorted(table.stops, sid), max(n - 1, 0))
    inside = table.stops[at] == sid if n else np.zeros(len(sid), bool)
    known, start = np.full(n, _NEVER), np.full(n, _NEVER)
    bound = int(arr[kind == _LAST].min(initial=_NEVER))
    goals = kind == _GOAL
    if goals.any():
        had: dict[int, int] = {}
        of = np.isin(sid, sid[goals]) & ((kind == _KNOWN) | (kind == _START))
        for s, a in zip(sid[of].tolist(), arr[of].tolist(), strict=True):
            had[s] = min(a, had.get(s, a))
        best = [had.get(s, _NEVER) + on for s, on in zip(sid[goals].tolist(), arr[goals].tolist(), strict=True)]
        bound = min(bound, (max if every else min)(best))
    if left is not None and aims is None:
        aims = _aims(table, paths, flex, every, kind, sid, arr, left + 1)
    lasts = [_Last(min((best[i] for i in some), default=bound), x[0], x[left], x[left + 1], int(x[0][at[origin & inside]].min(initial=_NEVER))) for some, x in aims or []]
    for k, into in ((_KNOWN, known), (_START, start)):
        own = inside & ((kind == k) | (kind == _START))  # what a round starts from is known
        np.minimum.at(into, at[own], arr[own])
    start[start >= (np.max([x.bound - x.more for x in lasts], axis=0) if lasts else bound)] = _NEVER
    asked = kind == _ASKED
    day, now = int(sid[asked].min(initial=_NEVER)), int(arr[asked].max(initial=-_NEVER))
    if not (start < _NEVER).any():
        return None
    parts = [table.rides(day, start)]

    def limits() -> np.ndarray:
        return np.max([x.arrivals() for x in lasts], axis=0)

    def counting(some: list) -> np.ndarray:
        """The arrivals before which labels count, now that candidates are known."""
        for last in lasts:
            for part in some:
                last.nearer(part)
        return np.minimum(known, limits() + 1 if lasts else bound)

    best = counting(parts)
    if flex:
        parts += table.booked(day, now, start, best)
        best = counting(parts[1:])
    place, *cand = (np.concatenate(c) for c in zip(*parts, strict=True))
    good = cand[0] < best[place]
    place, cand = place[good], [c[good] for c in cand]
    np.minimum.at(best, place, cand[0])
    first = cand[0] == best[place]
    place, cand = place[first], [c[first] for c in cand]
    if not len(place):
        return None
    if ways:  # earliest first, then transit before flex, then the smaller trip and stop of boarding
        order = np.lexsort((cand[4], cand[3], cand[2], cand[1], place))
        order = order[np.append(True, place[order][1:] != place[order][:-1])]
        place, cand = place[order], [c[order] for c in cand]
    to, rest = table.stops[place], ((kind >= _KNOWN) & (kind <= (_GOAL if ways else _LAST))) | (kind == _START)
    later, known_as = arr + (kind == _LAST), np.where(kind == _START, _KNOWN, kind)
    latest = limits()[np.searchsorted(table.stops, paths.stops)] if lasts else None
    walked = footpaths._request(paths, *(np.concatenate([a, b[rest]]) for a, b in ((np.zeros(len(to), np.int64), known_as), (to, sid), (cand[0], later))), ways, every, latest, lead)
    if not ways:
        return walked
    if walked is not None:
        left = ~np.isin(to, walked[0])
        to, cand = to[left], [c[left] for c in cand]
    return [to, *cand, walked]


_RIDE = [("mode", "int"), ("trip", "long"), ("from_sid", "long"), ("dep", "long"), ("due", "long")]
_WAY = [("stops", "array<long>"), ("times", "array<long>"), ("metres", "array<double>")]


def _batch(query: list, made: list, rounds: list | None = None) -> pa.RecordBatch:
    """The labels of some requests (and ``rounds``) with ways: ridden to, then walked to."""
    if rounds is not None:
        each = _batch(query, made)
        n = [np.repeat(rounds, [len(x) for x in c]) for c in ([m[0] for m in made], [m[-1][0] if m[-1] is not None else () for m in made])]
        return pa.RecordBatch.from_arrays([each.columns[0], pa.array(np.concatenate(n).astype(np.int32)), *each.columns[1:]], ["query_id", "round", *each.schema.names[1:]])
    ridden = [np.concatenate(c) for c in zip(*([np.full(len(m[0]), q), *m[:-1]] for q, m in zip(query, made, strict=True)), strict=True)]
    on = [[np.full(len(m[-1][0]), q), *m[-1]] for q, m in zip(query, made, strict=True) if m[-1] is not None]
    n = len(ridden[0])
    columns = [pa.array(c) for c in ridden]
    columns[3] = pa.array(ridden[3].astype(np.int32))
    columns[7] = pa.array(ridden[7], mask=ridden[7] >= _NEVER // 2)
    columns += [pa.nulls(n, pa.list_(pa.float64() if c == "metres" else pa.int64())) for c, _ in _WAY]
    names = ["query_id", "sid", "arr", *(c for c, _ in _RIDE), *(c for c, _ in _WAY)]
    if on:
        q, sid, arr, _, hops, stops, times, metres = (np.concatenate(c) for c in zip(*on, strict=True))
        ends = lambda more: pa.array(np.concatenate([[0], np.cumsum(hops + more)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends(more), pa.array(c)) for more, c in ((1, stops), (1, times), (0, metres))]
        foot = [*(pa.array(c) for c in (q, sid, arr)), *(pa.nulls(len(q), c.type) for c in columns[3:8]), *lists]
        columns = [pa.concat_arrays([a, b]) for a, b in zip(columns, foot, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


#: Labels in a row of those without ways.
PACKED = 1024


def _packed(query: list, made: list) -> pa.RecordBatch:
    """The labels of some requests without ways, ``PACKED`` to a row."""
    sid, arr = (np.concatenate(c) for c in zip(*made, strict=True))
    sizes = [len(m[0]) for m in made]
    cuts = [np.arange(0, n, PACKED) + end - n for n, end in zip(sizes, np.cumsum(sizes).tolist(), strict=True)]
    ends = pa.array(np.append(np.concatenate(cuts), len(sid)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (sid, arr)]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(query, np.int64), [len(c) for c in cuts])), *lists], ["query_id", "sids", "arrs"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, kind, sids, arrs) as one for each label."""
    for batch in batches:
        query, kind, sid, arr = batch.columns
        n = sid.value_lengths().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c.to_numpy(zero_copy_only=False), n)) for c in (query, kind)), sid.flatten(), arr.flatten()], ["query_id", "kind", "sid", "arr"])


def _rows(df: DataFrame, kind: int, sid=None, arr=None) -> DataFrame:
    if sid is None and "sids" in df.columns:
        both = [F.col("sids"), F.col("arrs")]
    else:
        both = [F.array(c.cast("long")) for c in (F.col("sid") if sid is None else sid, F.col("arr") if arr is None else arr)]
    return df.select(F.col("query_id").cast("long").alias("query_id"), F.lit(kind).cast("int").alias("kind"), both[0].alias("sids"), both[1].alias("arrs"))


def _asked(start: DataFrame, requests: DataFrame, goals: DataFrame | None, bound: DataFrame | None, flex: bool) -> DataFrame:
    """(query_id, kind, sids, arrs): what requests ride on from, and what they ask for."""
    day = F.coalesce("day", F.lit(-1)) if "day" in requests.columns else F.lit(0)
    now = F.coalesce(F.when(F.col("same_day"), F.col("now")), F.lit(-_NEVER)) if flex else F.lit(-_NEVER)
    each = _rows(start, _START).unionByName(_rows(requests, _ASKED, day, now))
    if goals is not None:
        each = each.unionByName(_rows(goals, _GOAL, F.col("sid"), F.col("on")))
    if bound is not None:
        each = each.unionByName(_rows(bound, _LAST, F.lit(0), F.col("bound")))
    return each


def _dealt(each: DataFrame) -> DataFrame:
    # By number: few rows go in where many come out, so their partitions are not to be put together.
    n = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "query_id").sortWithinPartitions("query_id")


def ridden(table, paths, start: DataFrame, known: list[DataFrame], requests: DataFrame, goals: DataFrame | None, bound: DataFrame | None, flex: bool, ways: bool, every: bool, left: int) -> DataFrame:
    """Labels that a round from ``start`` improves on it and on ``known``, walking included: (query_id, sids, arrs), lists that belong together, or with ``ways`` query_id, sid, arr, mode (0 transit, 1 flex), trip, from_sid, dep and due of the ride, or stops, times and metres of what was walked.

    ``start`` and ``known`` (from the labels of the origin on): either of these; ``left``: the rounds that follow at most.  ``table`` and ``paths``: broadcast
    :class:`Timetable` and :class:`tidelane.operators.footpaths.Footpaths`.  ``goals`` (query_id, sid, on) and ``bound``
    (query_id, bound): as of :func:`tidelane.operators.routing.arrivals`.
    """
    each = _asked(start, requests, goals, bound, flex)
    for k, df in enumerate(known):
        each = each.unionByName(_rows(df, _KNOWN if k else _ORIGIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, made, n = [], [], 0
        flushed = _batch if ways else _packed
        for q, (kind, sid, arr) in footpaths.by_request(_unpacked(batches)):
            if not (kind == _START).any():
                continue
            one = _round(table.value, paths.value, flex, ways, every, kind, sid, arr, left)
            if one is None or not len(one[0]) and (not ways or one[-1] is None):
                continue
            query.append(q)
            made.append(one)
            n += len(one[0]) + (len(one[-1][4]) if ways and one[-1] is not None else 0)
            if n > 100_000:
                yield flushed(query, made)
                query, made, n = [], [], 0
        if made:
            yield flushed(query, made)

    names = [("sid", "long"), ("arr", "long"), *_RIDE, *_WAY] if ways else [("sids", "array<long>"), ("arrs", "array<long>")]
    return _dealt(each).mapInArrow(run, ", ".join(f"{c} {k}" for c, k in [("query_id", "long"), *names]))


def _rounds(table: Timetable, paths, flex: bool, ways: bool, every: bool, kind: np.ndarray, sid: np.ndarray, arr: np.ndarray, rounds: int, lead: bool = False) -> Iterator[list]:
    """What each of the ``rounds`` of one request improves, as of :func:`_round`."""
    rounds = min(rounds, int(arr[kind == _RIDES].min(initial=rounds)))
    aims = _aims(table, paths, flex, every, kind, sid, arr, rounds)
    asked = (kind == _GOAL) | (kind == _LAST) | (kind == _ASKED)
    asked = kind[asked], sid[asked], arr[asked]
    start, known = (sid[kind == _START], arr[kind == _START]), []
    for k in range(rounds):
        parts = [asked, (np.full(len(start[0]), _START), *start), *((np.full(len(x[0]), _KNOWN if i else _ORIGIN), *x) for i, x in enumerate(known))]
        made = _round(table, paths, flex, ways, every, *(np.concatenate(c) for c in zip(*parts, strict=True)), rounds - 1 - k, aims, lead)
        if made is None or not len(made[0]) and (not ways or made[-1] is None):
            return
        yield made
        known.append(start)
        start = tuple(made[:2]) if not ways or made[-1] is None else tuple(np.concatenate([made[i], made[-1][i]]) for i in (0, 1))


def _best(origin: tuple[np.ndarray, np.ndarray], made: list[list]) -> list[np.ndarray]:
    """Each stop once with its earliest arrival; later rounds only improve."""
    sid, arr = (np.concatenate([own[i] for own in [*made[::-1], origin]]) for i in (0, 1))
    stops, first = np.unique(sid, return_index=True)
    return [stops, arr[first]]


def _leading(paths: footpaths.Footpaths | footpaths.Nearby, made: list[list], goals: np.ndarray, on: np.ndarray) -> list[list]:
    """Of each round the labels (with ways) of the way to the goal that it reaches first, by the smaller stop of equal ones."""
    kept = [(set(), set()) for _ in made]
    order = np.lexsort((on, goals))
    goals, on = goals[order], on[order]
    for k, own in enumerate(made):
        sid, arr = (own[i] if own[-1] is None else np.concatenate([own[i], own[-1][i]]) for i in (0, 1))
        at = np.flatnonzero(np.isin(sid, goals))
        if not len(at):
            continue
        total = arr[at] + on[np.searchsorted(goals, sid[at])]
        here = int(sid[at[np.lexsort((sid[at], total))[0]]])
        for j in range(k, -1, -1):
            ridden, walked = made[j][0], made[j][-1]
            if walked is not None and len(i := np.flatnonzero(walked[0] == here)):
                kept[j][1].add(int(i[0]))
                here = walked.source(paths, int(i[0]))
            i = int(np.flatnonzero(ridden == here)[0])
            kept[j][0].add(i)
            here = int(made[j][4][i])
    out = []
    for (rides, walks), own in zip(kept, made, strict=True):
        *ride, walked = own
        at = np.array(sorted(rides), np.int64)
        if walked is not None:
            walked = walked.ways(paths, np.array(sorted(walks), np.int64)) if walks else None
        out.append([*(c[at] for c in ride), walked])
    return out


#: What several rounds give of a request's labels, and the columns of it (with ways those of :func:`_batch`).
ALL, BEST, GOALS, COUNTS, REACHED = "all", "best", "goals", "counts", "reached"
_COLUMNS = {
    ALL: "query_id long, round int, sids array<long>, arrs array<long>", BEST: "query_id long, sids array<long>, arrs array<long>", GOALS: "query_id long, round int, sids array<long>, arrs array<long>",
    COUNTS: "query_id long, cutoff int, n long", REACHED: "query_id long, cutoff int, n long, sids array<long>",
}


def passed(table, paths, origin: DataFrame, requests: DataFrame, goals: DataFrame | None, bound: DataFrame | None, flex: bool, ways: bool, every: bool, rounds: int, only: str, cutoffs: DataFrame | None = None) -> DataFrame:
    """All rounds of each request in the task that its rows meet in, so labels are neither moved nor stored; as of :func:`ridden`.

    ``only``: ``ALL`` labels from the first round on, the ``BEST`` of each stop (the origin included), those of ``GOALS`` (with ``ways``: and of the way
    to the first of them), or of ``cutoffs`` (query_id, cutoff, until) the ``COUNTS`` of stops that are reached by then, or with what may be corners around them as ``REACHED``.
    """
    each = _asked(origin, requests, goals, bound, flex)
    if "max_rides" in requests.columns:
        each = each.unionByName(_rows(requests.where("max_rides IS NOT NULL"), _RIDES, F.lit(0), F.col("max_rides")))
    if cutoffs is not None:
        each = each.unionByName(_rows(cutoffs, _CUT, F.col("cutoff"), F.col("until")))
    bounded = bound is not None

    def lists(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of numbers (the last of them lists of one length) as a batch, lists in shares of ``PACKED``."""
        if only == COUNTS:
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, kind)) for c, kind in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int64), strict=True)], ["query_id", "cutoff", "n"])
        heads = {ALL: 2, GOALS: 2, BEST: 1, REACHED: 3}[only]
        sizes = np.array([len(r[heads]) for r in rows])
        shares = np.full(len(rows), 1) if only == REACHED else -(-sizes // PACKED)
        ends = np.cumsum(sizes)
        cuts = [np.arange(0, n, PACKED) + end - n if only != REACHED else np.array([end - n]) for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)]
        ends = pa.array(np.append(np.concatenate(cuts), ends[-1]).astype(np.int32))
        names = {ALL: ["query_id", "round", "sids", "arrs"], GOALS: ["query_id", "round", "sids", "arrs"], BEST: ["query_id", "sids", "arrs"], REACHED: ["query_id", "cutoff", "n", "sids"]}[only]
        kinds = [np.int64, np.int32, np.int64]
        columns = [pa.array(np.repeat(np.array([r[i] for r in rows], kinds[i]), shares)) for i in range(heads)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64))) for i in range(heads, len(names))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, labels, nth, n = [], [], [], [], 0
        for q, (kind, sid, arr) in footpaths.by_request(_unpacked(batches)):
            own = (kind == _START).any() and ((kind == _LAST).any() or not bounded)
            made = list(_rounds(table.value, paths.value, flex, ways, every, kind, sid, arr, rounds, ways and only == GOALS)) if own else []
            first = sid[kind == _START], arr[kind == _START]
            if ways:
                for k, some in enumerate(_leading(table.value.reverse(paths.value), made, sid[kind == _GOAL], arr[kind == _GOAL]) if only == GOALS else made):
                    if len(some[0]) or some[-1] is not None:
                        queries.append(q), labels.append(some), nth.append(k + 1)
                        n += len(some[0]) + (0 if some[-1] is None else len(some[-1][4]))
            elif only in (ALL, GOALS):
                for k, some in enumerate(made):
                    at = np.isin(some[0], sid[kind == _GOAL]) if only == GOALS else slice(None)
                    if len(stops := some[0][at]):
                        rows.append((q, k + 1, stops, some[1][at]))
                        n += len(stops)
            else:
                stops, best = _best(first, made)
                if only == BEST and len(stops):
                    rows.append((q, stops, best))
                    n += len(stops)
                for cutoff, until in zip(sid[kind == _CUT].tolist(), arr[kind == _CUT].tolist(), strict=True):
                    within = best <= until
                    if (count := int(within.sum())) and only == COUNTS:
                        rows.append((q, cutoff, count))
                    elif count and only == REACHED:
                        rows.append((q, cutoff, count, table.value.outer(stops[within])))
                        n += len(rows[-1][3])
                    n += 1
            if n > 100_000 and (rows or labels):
                yield _batch(queries, labels, nth) if labels else lists(rows)
                rows, queries, labels, nth, n = [], [], [], [], 0
        if rows or labels:
            yield _batch(queries, labels, nth) if labels else lists(rows)

    columns = ", ".join(f"{c} {k}" for c, k in [("query_id", "long"), ("round", "int"), ("sid", "long"), ("arr", "long"), *_RIDE, *_WAY]) if ways else _COLUMNS[only]
    return _dealt(each).mapInArrow(run, columns)


def unpacked(labels: list[DataFrame]) -> DataFrame:
    """(query_id, round, sid, arr) of the labels of each round, those of a request in one partition."""
    each = None
    for k, df in enumerate(labels):
        own = df if "sids" in df.columns else df.select("query_id", F.array("sid").alias("sids"), F.array("arr").alias("arrs"))
        own = own.select(F.col("query_id").cast("long").alias("query_id"), F.lit(k).alias("round"), "sids", "arrs")
        each = own if each is None else each.unionByName(own)
    n = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, "query_id").select("query_id", "round", F.inline(F.arrays_zip("sids", "arrs"))).withColumnsRenamed({"sids": "sid", "arrs": "arr"})
