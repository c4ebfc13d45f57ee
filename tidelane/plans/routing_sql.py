"""Rounds of routing unrolled as SQL, to hold the DataFrame rounds against; each label carries its legs as text."""

from __future__ import annotations

#: Walking hops that are unrolled in a round; at 500 m two improve anything on the derived network.
HOPS = 3

#: Fields of a leg, in the order of its text.
FIELDS = ("mode", "trip", "from_sid", "to_sid", "dep", "arr", "due", "metres")

_RANK = "arr, m, coalesce(trip, -1), coalesce(from_sid, -1), dep"


def _leg(mode: str, **parts: str) -> str:
    own = [f"coalesce(CAST({parts.get(c, 'NULL')} AS VARCHAR), '')" for c in FIELDS[1:]]
    return f"concat_ws('|', '{mode}', {', '.join(own)})||';'"


def _first(rows: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, sid ORDER BY {_RANK}) AS k FROM ({rows})) WHERE k = 1)"


def rounds(n: int, p: str = "", flex: bool = False, dated: bool = False, bound: str | None = None) -> str:
    """CTEs {p}s0.. (query_id, sid, arr, path, round) and {p}a{n}, all labels, from {p}req (query_id, dep; day, same_day, now) and {p}acc (query_id, sid, seconds, metres).

    ``bound``: an expression over a request's columns that vehicles have to stay under.
    """
    day = ", q.day" if dated else ""
    times, on = ("daytimes", "AND t.day = q.day") if dated else ("sttimes", "")
    first = f"SELECT query_id, c.sid, CAST(q.dep + c.seconds AS BIGINT) AS arr, 2 AS m, NULL::BIGINT AS trip, NULL::BIGINT AS from_sid, q.dep, CASE WHEN c.seconds > 0 THEN {_leg('walk', to_sid='c.sid', dep='q.dep', arr='q.dep + c.seconds', metres='c.metres')} ELSE '' END AS path FROM {p}acc c JOIN {p}req q USING (query_id)"
    out = [_first(first, f"{p}s0x"), f"{p}s0 AS MATERIALIZED (SELECT query_id, sid, arr, path, 0 AS round FROM {p}s0x)", f"{p}a0 AS (SELECT * FROM {p}s0)"]
    for k in range(1, n + 1):
        j = k - 1
        ride = (
            f"SELECT f.query_id, t.sid, CAST(t.arr AS BIGINT) AS arr, 0 AS m, CAST(f.tid AS BIGINT) AS trip, CAST(f.sid AS BIGINT) AS from_sid, CAST(f.dep AS BIGINT) AS dep, NULL::BIGINT AS due FROM "
            f"(SELECT query_id, tid, arg_min(sid, seq) AS sid, arg_min(dep, seq) AS dep, min(seq) AS seq FROM (SELECT s.query_id, s.sid, t.rid, t.seq, min(t.dep) AS dep, arg_min(t.tid, t.dep*1000000000::BIGINT + t.tid) AS tid "
            f"FROM {p}s{j} s JOIN {p}req q USING (query_id) JOIN {times} t ON t.sid = s.sid AND t.dep >= s.arr {on} GROUP BY ALL) GROUP BY query_id, tid) f JOIN sttimes t ON t.tid = f.tid AND t.seq > f.seq"
        )
        if flex:
            due = "CASE kind WHEN 1 THEN s.arr - minutes*60 WHEN 2 THEN last_time - last_day*86400 END"
            new = "CAST(s.arr + ceil(round(d, 3)*1.4::DOUBLE/(22000.0::DOUBLE/3600.0::DOUBLE) + 300) AS BIGINT)"
            runs = " JOIN flexdays fd ON fd.ft = x.ft AND fd.day = q.day" if dated else ""
            ride += (
                f" UNION ALL SELECT query_id, o, arr, 1, ft, f, dep, due FROM (SELECT s.query_id, o.sid AS o, {new} AS arr, CAST(x.ft AS BIGINT) AS ft, CAST(s.sid AS BIGINT) AS f, s.arr AS dep, CAST({due} AS BIGINT) AS due, ws, we, same_day, now FROM {p}s{j} s JOIN {p}req q USING (query_id) JOIN members m ON m.sid = s.sid "
                f"JOIN flex x ON x.grp = m.grp{runs} JOIN members o ON o.grp = m.grp AND o.sid <> s.sid JOIN dist ON a = s.sid AND b = o.sid WHERE s.arr BETWEEN ws AND we) WHERE arr BETWEEN ws AND we AND NOT coalesce(same_day AND now > due, false)"
            )
        if bound:
            ride = f"SELECT c.* FROM ({ride}) c JOIN {p}req q USING (query_id) WHERE c.arr < {bound}"
        leg = f"CASE WHEN m = 0 THEN {_leg('transit', trip='trip', from_sid='from_sid', to_sid='c.sid', dep='c.dep', arr='c.arr')} ELSE {_leg('flex', trip='trip', from_sid='from_sid', to_sid='c.sid', dep='c.dep', arr='c.arr', due='due')} END"
        out += [
            f"{p}b{j} AS MATERIALIZED (SELECT query_id, sid, min(arr) AS arr FROM {p}a{j} GROUP BY ALL)",
            _first(ride, f"{p}c{k}"),
            f"{p}i{k} AS MATERIALIZED (SELECT c.query_id, c.sid, c.arr, m, trip, from_sid, c.dep, s.path||{leg} AS path FROM {p}c{k} c LEFT JOIN {p}b{j} b USING (query_id, sid) JOIN {p}s{j} s ON s.query_id = c.query_id AND s.sid = c.from_sid WHERE b.arr IS NULL OR c.arr < b.arr)",
        ]
        known, last, parts = f"{p}b{j}", f"{p}i{k}", [f"{p}i{k}"]
        for h in range(1, HOPS + 1):
            moved = f"SELECT l.query_id, x.b AS sid, l.arr + x.seconds AS arr, 2 AS m, NULL::BIGINT AS trip, CAST(l.sid AS BIGINT) AS from_sid, l.arr AS dep, l.path||{_leg('walk', from_sid='l.sid', to_sid='x.b', dep='l.arr', arr='l.arr + x.seconds', metres='x.metres')} AS path FROM {last} l JOIN xfer x ON x.a = l.sid"
            out += [
                f"{p}n{k}{h} AS MATERIALIZED (SELECT query_id, sid, min(arr) AS arr FROM (SELECT query_id, sid, arr FROM {known} UNION ALL SELECT query_id, sid, arr FROM {last}) GROUP BY ALL)",
                _first(moved, f"{p}v{k}{h}"),
                f"{p}w{k}{h} AS MATERIALIZED (SELECT v.query_id, v.sid, v.arr, m, trip, from_sid, dep, path FROM {p}v{k}{h} v LEFT JOIN {p}n{k}{h} n USING (query_id, sid) WHERE n.arr IS NULL OR v.arr < n.arr)",
            ]
            known, last = f"{p}n{k}{h}", f"{p}w{k}{h}"
            parts.append(last)
        every = " UNION ALL ".join(f"SELECT query_id, sid, arr, m, trip, from_sid, dep, path FROM {x}" for x in parts)
        out += [_first(every, f"{p}s{k}x"), f"{p}s{k} AS MATERIALIZED (SELECT query_id, sid, arr, path, {k} AS round FROM {p}s{k}x)", f"{p}a{k} AS (SELECT * FROM {p}a{j} UNION ALL SELECT * FROM {p}s{k})"]
    return ",\n".join(out)


def front(n: int, p: str = "") -> str:
    """CTE {p}front (query_id, round, sid, arr, path) from {p}a{n} and {p}egr (query_id, sid, seconds, metres)."""
    last = _leg("walk", from_sid="sid", dep="reached", arr="arr", metres="metres")
    return (
        f"{p}g AS (SELECT query_id, round, sid, arr, CASE WHEN seconds > 0 THEN path||{last} ELSE path END AS path FROM (SELECT a.query_id, round, a.sid, a.arr AS reached, a.arr + seconds AS arr, seconds, metres, path, row_number() OVER (PARTITION BY a.query_id, round ORDER BY a.arr + seconds, a.sid) AS k FROM {p}a{n} a JOIN {p}egr e ON e.query_id = a.query_id AND e.sid = a.sid) WHERE k = 1),\n"
        f"{p}front AS MATERIALIZED (SELECT query_id, round, sid, arr, path FROM (SELECT *, min(arr) OVER (PARTITION BY query_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {p}g) WHERE (b IS NULL OR arr < b) AND path <> '')"
    )


def legs(source: str) -> str:
    """SELECT of (query_id, round, k, and the fields of a leg) from the paths of ``source``."""
    part = lambda i, kind: f"CAST(nullif(x[{i}], '') AS {kind})"
    named = ", ".join(f"{part(i + 1, 'VARCHAR' if c == 'mode' else 'DOUBLE' if c == 'metres' else 'BIGINT')} AS {c}" for i, c in enumerate(FIELDS))
    return f"SELECT query_id, round, k, {named} FROM (SELECT query_id, round, CAST(k - 1 AS INT) AS k, string_split(string_split(path, ';')[k], '|') AS x FROM (SELECT query_id, round, path, unnest(generate_series(1, len(string_split(path, ';')) - 1)) AS k FROM {source}))"


def summary(source: str, p: str = "") -> str:
    """SELECT of the columns of an itinerary's summary from ``source`` and {p}req."""
    own = f"(SELECT query_id, round, count(*) FILTER (WHERE mode <> 'walk') AS rides, coalesce(sum(arr - dep) FILTER (WHERE mode = 'walk'), 0) AS walked, coalesce(sum(metres) FILTER (WHERE mode = 'walk'), 0) AS metres, count(*) FILTER (WHERE mode = 'flex') > 0 AS flex FROM ({legs(source)}) GROUP BY ALL)"
    return (
        f"SELECT f.query_id, f.round, f.sid, q.dep AS departure, f.arr, f.arr - q.dep AS duration, CAST(greatest(rides - 1, 0) AS INT) AS transfers, CAST(walked AS BIGINT) AS walk_seconds, round(CAST(metres AS DOUBLE), 3) AS walk_metres, flex AS needs_booking "
        f"FROM {source} f JOIN {p}req q USING (query_id) JOIN {own} l ON l.query_id = f.query_id AND l.round = f.round"
    )
