"""Dyadic interval joins and rectangles of states against plain comparisons."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import bitemporal, intervals, timeline

T = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=h)


def test_each_point_meets_each_covering_interval_once(session):
    r = random.Random(2)
    spans = [(i, r.choice("ab"), T(a := r.randrange(-(10**5), 10**5)), None if i % 9 == 0 else T(a + r.choice([0, 1, 59, 60, 61, 1000, 10**5]))) for i in range(150)]
    spans += [(200, "a", datetime.datetime(1, 1, 1), datetime.datetime(9999, 1, 1)), (201, "a", datetime.datetime(9000, 1, 1), None), (202, "a", datetime.datetime(1, 1, 1), datetime.datetime(2, 1, 1))]
    points = [(i, r.choice("ab"), T(r.randrange(-(10**5), 2 * 10**5))) for i in range(150)] + [(200, "a", datetime.datetime(9500, 1, 1)), (201, "a", datetime.datetime(1, 6, 1)), (202, "a", None)]
    met = intervals.covering(session.createDataFrame(points, "p int, k string, at timestamp"), session.createDataFrame(spans, "s int, k string, start timestamp, end timestamp"), ["k"], "at", "start", "end")
    want = sorted((p, s) for p, k, at in points for s, l, a, b in spans if k == l and at is not None and a <= at and (b is None or at < b))
    assert sorted((x["p"], x["s"]) for x in met.select("p", "s").collect()) == want and len(want) > 500


def test_states_equal_a_resolve_at_every_cutoff(session):
    r = random.Random(3)
    rows, ident = [], 0
    for scope in range(12):
        last = None
        for k in range(r.randrange(1, 9)):
            ident += 1
            start = r.randrange(0, 400)
            rows.append((ident, scope, last if last and r.random() < 0.8 else None, T(1000 + 10 * ident), T(start), None if r.random() < 0.3 else T(start + r.randrange(0, 300))))
            last = ident
    records = session.createDataFrame(rows, "record_id long, scope_id int, supersedes_record_id long, recorded_at timestamp, valid_from timestamp, valid_until timestamp")
    moments = [(T(m), T(1000 + k)) for m in (0, 100, 250, 450) for k in (0, 200, 777)]
    cutoffs = [(100 * i + s, s, m, k) for i, (m, k) in enumerate(moments) for s in range(13)]
    asked = session.createDataFrame(cutoffs, "cutoff_id int, scope_id int, market_as_of timestamp, known_as_of timestamp")
    got, same = ({c["cutoff_id"]: (c["record_id"], c["state"]) for c in timeline.states(records, asked, large_scopes=large).collect()} for large in (False, True))
    assert got == same
    assert len(got) == len(cutoffs)
    for i, (market, known) in enumerate(moments):
        valid = (F.col("valid_from") <= F.lit(market)) & (F.col("valid_until").isNull() | (F.lit(market) < F.col("valid_until")))
        want = {x["scope_id"]: (x["record_id"], x["state"]) for x in bitemporal.resolve(records, known, valid).collect()} if i in (4, 8, 11) else None
        if want is not None:
            assert {s: got[100 * i + s] for s in range(13)} == {s: want.get(s, (None, "none")) for s in range(13)}
    # without a knowledge time all is known
    last = timeline.states(records, session.createDataFrame([(1, 0, T(100), None)], "cutoff_id int, scope_id int, market_as_of timestamp, known_as_of timestamp")).first()
    assert (last["record_id"], last["state"]) == got[100 * moments.index((T(100), T(1777)))]


def test_broken_chains_are_corrupt_from_then_on(session):
    rows = [(1, "a", None, T(0), T(0), None), (2, "a", 1, T(10), T(0), None), (3, "a", 1, T(20), T(0), None), (4, "b", 9, T(5), T(0), None), (5, "c", 5, T(5), T(0), None), (6, "d", None, T(5), T(7), T(7))]
    records = session.createDataFrame(rows, "record_id long, scope_id string, supersedes_record_id long, recorded_at timestamp, valid_from timestamp, valid_until timestamp")
    cutoffs = session.createDataFrame([(10 * i + j, s, T(50), T(k)) for i, s in enumerate("abcde") for j, k in enumerate((4, 15, 20))], "cutoff_id int, scope_id string, market_as_of timestamp, known_as_of timestamp")
    got = {x["cutoff_id"]: x["state"] for x in timeline.states(records, cutoffs).collect()}
    assert [got[k] for k in sorted(got)] == ["resolved", "resolved", "corrupt", "none", "corrupt", "corrupt", "none", "corrupt", "corrupt", *["none"] * 6]
    assert timeline.states(records.limit(0), cutoffs).filter("state <> 'none'").count() == 0


FIELDS = "record_id long, scope_id int, supersedes_record_id long, recorded_at timestamp, valid_from timestamp, valid_until timestamp"


def _chains(r, scopes, size, first=0):
    """Records of sound chains: each points at an earlier one of its scope that none points at, or at none."""
    rows = []
    for scope in range(scopes):
        free = []
        for k in range(size):
            ident = first + scope * size + k + 1
            target = free.pop(r.randrange(len(free))) if free and r.random() < 0.7 else None
            start = r.randrange(0, 400)
            rows.append((ident, scope, target, T(1000 + 10 * k), T(start), None if r.random() < 0.3 else T(start + r.randrange(0, 300))))
            free.append(ident)
    return rows


def test_breaks_within_scopes_equal_breaks_of_the_whole_table(session):
    r = random.Random(5)
    rows = _chains(r, 30, 6)
    # earlier than its target, of another scope, of no record, its own, at the same time; then two that point at one, an id of two contents, rows twice
    faults = [(4, {3: T(0)}), (9, {2: 160}), (15, {2: 9999}), (20, {2: 21}), (27, {2: 26, 3: rows[25][3]})]
    for ident, change in faults:
        rows[ident - 1] = tuple(change.get(i, x) for i, x in enumerate(rows[ident - 1]))
    forked = [(500, 20, rows[120][0], T(5000), T(0), None), (501, 21, rows[121][0], T(2), T(0), None)]
    for more in ([], forked, [(rows[140][0], 24, None, T(70), T(0), None)], [rows[150], rows[0]]):
        records = session.createDataFrame(rows + more, FIELDS)
        got, want = ({x["scope_id"]: x["broken_at"] for x in f(records).collect()} for f in (timeline.breaks, timeline._breaks_anywhere))
        assert got == want and len(got) >= 5


def test_mappings_hold_where_their_version_is_current(session):
    """Against one resolution after the other; what is exchanged is rows of cutoffs and records, not of their pairs."""
    r = random.Random(7)
    versions = _chains(r, 8, 24)
    versions[3], versions[30] = (*versions[3][:2], 999, *versions[3][3:]), (*versions[30][:2], versions[29][0], T(0), *versions[30][4:])
    mappings = []
    for row in _chains(r, 8, 24, 1000):
        of = r.choice([row[0] - 1000, r.randrange(1, 193), 5000 if r.random() < 0.2 else row[0] - 1000])
        mappings.append((*row[:4], T(0), None if r.random() < 0.6 else T(500), of))
    mappings[5] = (*mappings[5][:2], 7777, *mappings[5][3:])
    asked = [(100 * s + i, s, T(r.randrange(0, 600)), None if i == 0 else T(1000 + r.randrange(0, 260))) for s in range(9) for i in range(24)]
    tracker = session.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(tracker.stageList(None, False, False, session.sparkContext._gateway.new_array(session._jvm.double, 0), None))}
    before = stages()
    cutoffs = session.createDataFrame(asked, "cutoff_id int, scope_id int, market_as_of timestamp, known_as_of timestamp")
    out = timeline.mapping_states(session.createDataFrame(mappings, FIELDS + ", version_id long"), session.createDataFrame(versions, FIELDS), cutoffs)
    got = {x["cutoff_id"]: (x["record_id"], x["version_id"], x["instrument_id"], x["state"]) for x in out.collect()}
    moved = sum(n for k, n in stages().items() if k not in before)

    def resolved(rows, scope, known, good):
        by = {x[0]: x for x in rows}
        for x in rows:
            parent = by.get(x[2])
            if x[1] == scope and x[3] <= known and x[2] is not None and (parent is None or parent[1] != scope or x[3] <= parent[3]):
                return None, "corrupt"

        def root(x):
            while x[2] in by:
                x = by[x[2]]
            return x[0]

        last = {}
        for x in sorted((x for x in rows if x[1] == scope and x[3] <= known and good(x)), key=lambda x: x[3]):
            last[root(x)] = x
        return (next(iter(last.values())), "resolved") if len(last) == 1 else (None, "ambiguous" if last else "none")

    home = {x[0]: x[1] for x in versions}
    want = {}
    for ident, scope, market, known in asked:
        known = known or datetime.datetime(9999, 1, 1)
        valid = lambda x, m=market: x[4] <= m and (x[5] is None or m < x[5])
        behind = {home[x[6]] for x in mappings if x[1] == scope and x[3] <= known and x[6] in home}
        current = {i: resolved(versions, i, known, valid) for i in behind}
        found, state = resolved(mappings, scope, known, lambda x: valid(x) and x[6] in home and current[home[x[6]]][1] == "resolved" and current[home[x[6]]][0][0] == x[6])
        states = {s for _, s in current.values()}
        if state != "corrupt":
            state = next((f"{s}_version" for s in ("corrupt", "ambiguous") if s in states), state)
        want[ident] = (found[0], found[6], home[found[6]], state) if state == "resolved" else (None, None, None, state)
    assert got == want
    assert {x[3] for x in want.values()} >= {"corrupt", "corrupt_version", "ambiguous_version", "none"}
    assert 0 < moved < 6000  # 3,265; a row for each pair of a cutoff and a known mapping made 16,364
