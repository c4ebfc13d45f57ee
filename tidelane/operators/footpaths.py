"""Walking on from what vehicles have reached, to the fixpoint, request by request.

Footpaths of one request don't depend on those of others, so its labels meet in one place
and are relaxed there from the earliest on, a few minutes' labels at a time as arrays, instead of
a job for each hop.  The footpaths
themselves go to every task, so there is a bound to them; above it stops with their positions go there, where
footpaths are all pairs of stops within some metres (:class:`Nearby`), else the hop loop of
:mod:`tidelane.operators.routing` does the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.functions.geo import EARTH_M, WALK_DETOUR, WALK_M_PER_S

#: Footpaths that are sent to every task, at most (24 bytes each).
MOST_FOOTPATHS = 2_000_000


@dataclass
class Footpaths:
    """The paths of stop ``stops[i]`` are ``start[i]:start[i + 1]``; ``to`` are places in ``stops``."""

    stops: np.ndarray
    start: np.ndarray
    to: np.ndarray
    seconds: np.ndarray
    metres: np.ndarray

    def places(self, sids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``sids`` in ``stops``, and which of them are there."""
        if not len(self.stops):
            return np.zeros(len(sids), np.int64), np.zeros(len(sids), bool)
        i = np.minimum(np.searchsorted(self.stops, sids), len(self.stops) - 1)
        return i, self.stops[i] == sids

    def turned(self) -> Footpaths:
        """The same paths the other way."""
        a = np.repeat(np.arange(len(self.stops)), np.diff(self.start))
        order = np.argsort(self.to, kind="stable")
        return Footpaths(self.stops, np.searchsorted(self.to[order], np.arange(len(self.stops) + 1)), a[order], self.seconds[order], self.metres[order])

    def on(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many paths each of the stops in the places ``at`` has, where they lead, and their seconds."""
        path, n = self.leaving(at)
        return n, self.to[path], self.seconds[path]

    def lengths(self, a: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The metres of the paths from places ``a`` (in their order) to places ``to``."""
        path, n = self.leaving(own := np.unique(a))
        had = np.repeat(own, n) * len(self.stops) + self.to[path]
        order = np.argsort(had, kind="stable")
        return self.metres[path[order[np.searchsorted(had[order], a * len(self.stops) + to)]]]

    def leaving(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths of the stops in the places ``at``, and how many each has."""
        n = self.start[at + 1] - self.start[at]
        return np.arange(n.sum()) + np.repeat(self.start[at] - (np.cumsum(n) - n), n), n


@dataclass
class Nearby:
    """Footpaths between all stops at most ``most`` metres apart, of which only the stops are sent; ``cell`` and ``order`` put stops into a grid.

    A task makes them once, where they are ``MOST_PAIRS`` at most by their number in the grid, else for the stops that are walked on from each time.
    """

    stops: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    most: float
    made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __post_init__(self):
        north = self.most / 111_000.0
        east = 1.01 * north / np.cos(np.radians(np.abs(self.lat).max(initial=0.0) + north))
        y, x = np.floor(self.lat / north).astype(np.int64), np.floor(self.lon / east).astype(np.int64)
        y, x = y - y.min(initial=0) + 1, x - x.min(initial=0) + 1
        self.width = int(x.max(initial=0)) + 2
        self.cell = y * self.width + x
        self.order = np.argsort(self.cell, kind="stable")
        self.sorted = self.cell[self.order]
        self.cos = np.cos(np.radians(self.lat))
        self.few = self.about() <= MOST_PAIRS

    places = Footpaths.places

    def turned(self) -> Nearby:
        return self

    def _ranges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``at`` three ranges of ``order``: the cells around it, row by row."""
        rows = self.cell[at][:, None] + np.array([-self.width, 0, self.width])
        return np.searchsorted(self.sorted, rows - 1), np.searchsorted(self.sorted, rows + 1, side="right")

    def about(self) -> int:
        """About how many footpaths there are: a circle's share of the stops in three by three cells."""
        cells, n = np.unique(self.cell, return_counts=True)
        rows = cells[:, None] + np.array([-self.width, 0, self.width])
        lo, hi = np.searchsorted(self.sorted, rows - 1), np.searchsorted(self.sorted, rows + 1, side="right")
        return int(((hi - lo).sum(axis=1) * n).sum() * 0.35)

    def lengths(self, a: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.round(self._metres(a, to), 3)

    def _metres(self, a: np.ndarray, to: np.ndarray) -> np.ndarray:
        return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(self._chord(a, to), 1.0)))

    def _chord(self, a: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sin(np.radians(self.lat[to] - self.lat[a]) / 2) ** 2 + self.cos[a] * self.cos[to] * np.sin(np.radians(self.lon[to] - self.lon[a]) / 2) ** 2

    def _near(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = self._ranges(at)
        n = (hi - lo).ravel()
        to = self.order[np.arange(n.sum()) + np.repeat(lo.ravel() - (np.cumsum(n) - n), n)]
        i = np.repeat(np.repeat(np.arange(len(at)), 3), n)
        a, chord = at[i], self._chord(at[i], to)
        near = (chord <= np.sin(self.most / 2 / EARTH_M) ** 2 * (1 + 1e-9)) & (a != to)
        i, to = i[near], to[near]
        metres = 2 * EARTH_M * np.arcsin(np.sqrt(chord[near]))
        near = metres <= self.most
        seconds = np.ceil(np.round(metres[near], 3) * WALK_DETOUR / WALK_M_PER_S).astype(np.int64)
        return np.bincount(i[near], minlength=len(at)), to[near], seconds

    def on(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.few:
            return self._near(at)
        if self.made is None:
            kind = np.uint16 if self.most * WALK_DETOUR / WALK_M_PER_S < 60_000 else np.int64
            ns, tos, seconds = zip(*((n, to.astype(np.int32), s.astype(kind)) for n, to, s in (self._near(np.arange(k, min(k + 1024, len(self.stops)))) for k in range(0, len(self.stops), 1024))), strict=True)
            self.made = np.concatenate([[0], np.cumsum(np.concatenate(ns))]), np.concatenate(tos), np.concatenate(seconds)
        start, to, seconds = self.made
        n = start[at + 1] - start[at]
        path = np.arange(n.sum()) + np.repeat(start[at] - (np.cumsum(n) - n), n)
        return n, to[path].astype(np.int64), seconds[path].astype(np.int64)


#: Stops that are sent to every task in place of their footpaths, at most, and footpaths between them that a task keeps.
MOST_STOPS, MOST_PAIRS = 1_000_000, 50_000_000


def of(network) -> Footpaths | Nearby | None:
    """The footpaths of ``network`` as tasks walk on them, or None where they and the stops are too many."""
    if network.walk_m is not None:
        own = network.stops.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("sid").cast("long").alias("sid"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon"))).limit(MOST_STOPS + 1).toArrow()
        sid, lat, lon = (own[c].to_numpy() for c in ("sid", "lat", "lon"))
        if 0 < len(sid) <= MOST_STOPS and np.abs(lat).max() < 85:
            order = np.argsort(sid)
            near = Nearby(sid[order], lat[order], lon[order], network.walk_m)
            if near.about() > MOST_FOOTPATHS:
                return near
    return gathered(network.transfers)


def gathered(transfers: DataFrame) -> Footpaths | None:
    """All footpaths (a, b, metres, seconds), or None if there are more than ``MOST_FOOTPATHS``."""
    own = transfers.select(*(F.col(c).cast("long").alias(c) for c in ("a", "b", "seconds")), F.col("metres").cast("double").alias("metres")).limit(MOST_FOOTPATHS + 1).toArrow()
    if own.num_rows > MOST_FOOTPATHS:
        return None
    own = own.sort_by([("a", "ascending"), ("b", "ascending")])
    a, b = own["a"].to_numpy(), own["b"].to_numpy()
    stops = np.unique(np.concatenate([a, b]))
    return Footpaths(stops, np.searchsorted(a, np.append(stops, np.iinfo(np.int64).max)), np.searchsorted(stops, b), own["seconds"].to_numpy(), own["metres"].to_numpy())


#: A label is one number: its arrival, and below that the hops since the ride in so many bits.
HOPS = 21
_NEVER = np.int64(1) << 62

#: Seconds of labels that are relaxed together.
STEP = 180


def spread(paths: Footpaths, labels: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """:func:`relaxed` without a limit that moves: what walking doesn't lower stays, so ``labels`` may start as what still counts."""
    ahead, walked = (np.zeros(len(labels), bool) for _ in range(2))
    ahead[fresh] = True
    while len(at := np.flatnonzero(ahead)):
        own = labels[at]
        at = at[own >> HOPS < (int(own.min()) >> HOPS) + STEP]
        ahead[at] = False
        n, to, seconds = paths.on(at)
        cand = np.repeat(labels[at] + 1, n) + (seconds << HOPS)
        better = cand < labels[to]
        to, cand = to[better], cand[better]
        np.minimum.at(labels, to, cand)
        ahead[to], walked[to] = True, True
    return np.flatnonzero(walked)


def relaxed(paths: Footpaths, labels: np.ndarray, fresh: np.ndarray, limit: Callable[[np.ndarray], int], goals: np.ndarray) -> np.ndarray:
    """Lowers ``labels`` (arrival and hops of each place of ``paths.stops``) by walking on from the places ``fresh``; the places that are reached on foot.

    The earliest label stays; of equal ones that of fewer hops.  Nobody walks on after the ``limit`` of the labels, or
    gets anywhere but to a goal from then on.
    """
    ahead, walked, goal = (np.zeros(len(labels), bool) for _ in range(3))
    ahead[fresh], goal[goals] = True, True
    while len(at := np.flatnonzero(ahead)):
        bound = limit(labels)
        own = labels[at]
        at = at[own >> HOPS < min((int(own.min()) >> HOPS) + STEP, bound + 1)]
        if not len(at):
            break
        ahead[at] = False
        n, to, seconds = paths.on(at)
        cand = np.repeat(labels[at] + 1, n) + (seconds << HOPS)
        better = (cand < labels[to]) & ((cand >> HOPS < bound) | goal[to])
        to, cand = to[better], cand[better]
        np.minimum.at(labels, to, cand)
        ahead[to], walked[to] = True, True
    arr, bound = labels >> HOPS, limit(labels)
    return np.flatnonzero(walked & ((arr < bound) | (goal & (arr <= bound))))


def _ways(paths: Footpaths, labels: np.ndarray, source: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The way to each of the places ``found`` from one where a ride ended: how many hops, and one after another the places, and the metres of their hops.

    Of ways that are as early with as few hops it is the one over the smaller stop before.
    """
    n, to, seconds = paths.on(source)
    a = np.repeat(source, n)
    tight = labels[a] + (seconds << HOPS) + 1 == labels[to]
    a, to = a[tight][::-1], to[tight][::-1]  # the smallest stop is written last
    before, metres = np.full(len(labels), -1), np.zeros(len(labels))
    before[to] = a
    metres[to] = paths.lengths(before[to], to)
    hops = labels[found] & ((1 << HOPS) - 1)
    places = np.empty(int((hops + 1).sum()), np.int64)
    at, here = np.cumsum(hops + 1) - 1, found
    rest = hops
    while len(here):
        places[at] = here
        going = rest > 0
        at, here, rest = at[going] - 1, before[here[going]], rest[going] - 1
    first = np.cumsum(hops + 1) - hops - 1
    later = np.ones(len(places), bool)
    later[first] = False
    return hops, places, first, metres[places[later]]


@dataclass
class Walk:
    """The places ``found`` on foot with what their ways follow from: the ``labels``, and which of them are of this round (``begun``)."""

    stops: np.ndarray
    labels: np.ndarray
    begun: np.ndarray
    found: np.ndarray

    def __getitem__(self, i: int) -> np.ndarray:
        return self.stops[self.found] if i == 0 else self.labels[self.found] >> HOPS

    def way(self, turned: Footpaths | Nearby, i: int) -> list[int]:
        """The places from where the ride ended to the ``i``-th that was found, each over the smallest one before; ``turned``: footpaths the other way."""
        out = [int(self.found[i])]
        for _ in range(int(self.labels[out[0]] & ((1 << HOPS) - 1))):
            _, before, seconds = turned.on(np.array(out[-1:]))
            own = before[self.begun[before] & (self.labels[before] + (seconds << HOPS) + 1 == self.labels[out[-1]])]
            out.append(int(own.min()))
        return out[::-1]

    def source(self, turned: Footpaths | Nearby, i: int) -> int:
        return int(self.stops[self.way(turned, i)[0]])

    def ways(self, turned: Footpaths | Nearby, some: np.ndarray) -> list:
        """As of :func:`_request` with ways, of ``some`` that were found."""
        each = [np.array(self.way(turned, i)) for i in some.tolist()]
        places = np.concatenate(each)
        metres = np.concatenate([turned.lengths(w[1:], w[:-1]) for w in each])
        return [self.stops[self.found[some]], self.labels[self.found[some]] >> HOPS, self.stops[[w[0] for w in each]], np.array([len(w) - 1 for w in each]), self.stops[places], self.labels[places] >> HOPS, metres]


def _least(sids: np.ndarray, arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stop once, with its earliest arrival."""
    stops, at = np.unique(sids, return_inverse=True)
    best = np.full(len(stops), np.iinfo(np.int64).max)
    np.minimum.at(best, at, arr)
    return stops, best


def _request(paths: Footpaths, kind: np.ndarray, sid: np.ndarray, arr: np.ndarray, ways: bool, every: bool, latest: np.ndarray | None = None, lead: bool = False) -> list | Walk | None:
    """Columns of the improved labels of one request (without the query), or None.

    ``latest``: instead of goals and a last time, the last arrival at each place that counts; with ``lead`` ways are left to the :class:`Walk`.
    """
    at, inside = paths.places(sid)
    known, labels = np.full(len(paths.stops), _NEVER), np.full(len(paths.stops), _NEVER)
    for k, into in ((1, known), (0, labels)):
        own = inside & (kind == k)
        np.minimum.at(into, at[own], arr[own] << HOPS)
    never = int(_NEVER >> HOPS)
    most = int(arr[kind == 3].min(initial=never))
    goals, on = at[inside & (kind == 2)], arr[inside & (kind == 2)]
    apart = ~inside
    others, ends = _least(sid[apart & (kind == 0)], arr[apart & (kind == 0)]), []
    if apart.any():  # stops without footpaths
        had = dict(zip(*(x.tolist() for x in _least(sid[apart & (kind == 1)], arr[apart & (kind == 1)])), strict=True))
        new = np.array([had.get(s, a + 1) > a for s, a in zip(*(x.tolist() for x in others), strict=True)], bool)
        others = others[0][new], others[1][new]
        reached = had | dict(zip(*(x.tolist() for x in others), strict=True))
        asked = apart & (kind == 2)
        ends = [reached.get(g, never) + seconds for g, seconds in zip(sid[asked].tolist(), arr[asked].tolist(), strict=True)]

    def limit(labels: np.ndarray) -> int:
        reached = [*ends, *((labels[goals] >> HOPS) + on).tolist()]
        return min(most, (max if every else min)(reached)) if reached else most

    fresh = np.flatnonzero(labels < known)
    labels = np.minimum(labels, known)
    if latest is None and not len(goals) and not ends:
        latest = np.full(len(labels), most - 1)
    if latest is None:
        found = relaxed(paths, labels, fresh, limit, goals)
    else:
        fresh = fresh[labels[fresh] >> HOPS <= latest[fresh]]
        labels = np.minimum(labels, (np.minimum(latest, never - 1) + 1) << HOPS)
        found = spread(paths, labels, fresh)
    if not ways:
        improved = np.union1d(fresh, found)
        return [np.concatenate([paths.stops[improved], others[0]]), np.concatenate([labels[improved] >> HOPS, others[1]])]
    if not len(found):
        return None
    if lead:
        begun = np.zeros(len(labels), bool)
        begun[fresh] = begun[found] = True
        return Walk(paths.stops, labels, begun, found)
    hops, places, first, metres = _ways(paths, labels, np.union1d(fresh, found), found)
    return [paths.stops[found], labels[found] >> HOPS, paths.stops[places[first]], hops, paths.stops[places], labels[places] >> HOPS, metres]


def by_request(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each request of rows that are sorted by it (their first column), with its other columns."""
    open_query, held = None, []
    for batch in batches:
        query, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero(np.diff(query)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(query)], strict=True):
            if hi > lo:
                if held and query[lo] != open_query:
                    yield open_query, [np.concatenate(c) for c in zip(*held, strict=True)]
                    held = []
                open_query = query[lo]
                held.append([c[lo:hi] for c in rest])
    if held:
        yield open_query, [np.concatenate(c) for c in zip(*held, strict=True)]


def walked(shared, fresh: DataFrame, known: DataFrame, goals: DataFrame | None = None, ways: bool = True, every: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """(query_id, sid, arr, source, stops, times, metres): stops that walking on from ``fresh`` (query_id, sid, arr) reaches earlier than ``known``.

    ``source`` is the fresh label's stop; ``stops`` and ``times`` from there to ``sid``, ``metres`` of each path.
    ``goals`` (query_id, sid, on): what arrives no earlier than a goal (with ``every``: than the last of them) is reached
    is left out, as is what arrives later than ``bounds`` (query_id, bound).  Without ``ways``: (query_id, sid, arr) alone,
    of what ``fresh`` itself improves, too.  ``shared``: a broadcast :class:`Footpaths`.
    """
    rows = fresh.select("query_id", F.lit(0).alias("kind"), "sid", "arr").unionByName(known.select("query_id", F.lit(1).alias("kind"), "sid", "arr"))
    if goals is not None:
        rows = rows.unionByName(goals.select("query_id", F.lit(2).alias("kind"), "sid", F.col("on").cast("long").alias("arr")))
    if bounds is not None:
        rows = rows.unionByName(bounds.select("query_id", F.lit(3).alias("kind"), F.lit(0).cast("long").alias("sid"), (F.col("bound").cast("long") + 1).alias("arr")))
    rows = rows.select(F.col("query_id").cast("long").alias("query_id"), "kind", F.col("sid").cast("long").alias("sid"), F.col("arr").cast("long").alias("arr"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, out, n = shared.value, [], 0

        def flushed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            if not ways:
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "sid", "arr"])
            query, sid, arr, source, hops, stops, times, metres = columns
            ends = lambda more: pa.array(np.concatenate([[0], np.cumsum(hops + more)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends(more), pa.array(c)) for more, c in ((1, stops), (1, times), (0, metres))]
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in (query, sid, arr, source)), *lists], ["query_id", "sid", "arr", "source", "stops", "times", "metres"])

        for query, rest in by_request(batches):
            made = _request(paths, *rest, ways, every)
            if made is not None and len(made[0]):
                out.append([np.full(len(made[0]), query), *made])
                n += len(made[0]) if not ways else len(made[4])
            if n > 100_000:
                yield flushed()
                n = 0
        if out:
            yield flushed()

    kinds = "query_id long, sid long, arr long" + (", source long, stops array<long>, times array<long>, metres array<double>" if ways else "")
    return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, kinds)
