"""Commits of stored records: conflicts, deaths before a commit, replays and guards; and digests of tables and results."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import digests
from tidemark.sources.store import CommitConflict, Store, successors, unique

KIND = "record_id long, scope_id string, recorded_at timestamp, supersedes_record_id long"
T = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)


@pytest.fixture
def store(session, tmp_path):
    return Store(session, str(tmp_path / "store"))


def records(session, *rows):
    return session.createDataFrame([(i, s, T(i), p) for i, s, p in rows], KIND)


def stored(store):
    return sorted(r["record_id"] for r in store.rows(KIND).collect())


def test_readers_see_whole_commits_only(session, store):
    assert stored(store) == [] and store.commits() == []
    assert store.append(records(session, (1, "a", None))) == 1
    part = store.stage(records(session, (2, "a", 1)))  # a writer that dies before its commit
    assert stored(store) == [1] and store.leftovers() == [part]
    assert store.append(records(session, (3, "b", None)), key="run-3") == 2
    assert store.append(records(session, (3, "b", None)), key="run-3") == 2  # a replay
    assert stored(store) == [1, 3] and [r["record_id"] for r in store.rows(KIND, upto=1).collect()] == [1]
    assert len(store.commits()) == 2 and store.leftovers() == [part]


def test_of_two_writers_of_one_version_one_fails(session, store):
    parts = [store.stage(records(session, (i, "a", None))) for i in (1, 2, 3, 4)]
    outcomes = []

    def write(part):
        try:
            store.commit(part, 1)
            outcomes.append(part)
        except CommitConflict:
            outcomes.append(None)

    threads = [threading.Thread(target=write, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(o is not None for o in outcomes) == 1 and [c["part"] for c in store.commits()] == [o for o in outcomes if o]


def test_guards_judge_again_after_a_conflict(session, store):
    store.append(records(session, (1, "a", None)), guard=successors)
    seen = []

    def guard(old, new):
        if not seen:  # another writer comes in between
            store.append(records(session, (2, "a", 1)), guard=successors)
        seen.append(old.count())
        successors(old, new)

    with pytest.raises(ValueError, match="branch"):
        store.append(records(session, (3, "a", 1)), guard=guard)
    assert seen == [1, 2] and stored(store) == [1, 2]
    assert store.append(records(session, (4, "a", 2)), guard=successors) == 3
    for row, why in (((5, "b", 4), "cross_scope"), ((5, "a", 9), "missing_target"), ((5, "a", 5), "self_edge"), ((3, "a", 4), "not_later")):
        with pytest.raises(ValueError, match=why):
            store.append(records(session, row), guard=successors)
    with pytest.raises(ValueError, match="stored already"):
        store.append(records(session, (4, "c", None)), guard=unique("record_id"))
    assert stored(store) == [1, 2, 4] and len(store.leftovers()) == 6


def test_table_digests_are_of_multisets(session):
    rows = [(i % 7, f"t{i % 5}", float(i % 3)) for i in range(60)] + [(None, None, None)] * 2
    kind = "a int, b string, c double"
    of = lambda r, n=3: digests.table_digest(session.createDataFrame(r, kind).repartition(n)).first()
    same = of(rows)
    assert of(rows[::-1], 5) == same and same["n_rows"] == 62
    assert digests.table_digest(session.createDataFrame(rows, kind).select("c", "b", "a")).first() == same
    for other in (rows + rows[:1], rows[1:], [(0, "T0", 0.0), *rows[1:]], [(None, "t0", 0.0), *rows[1:]]):
        assert of(other) != same
    assert tuple(of([])) == (0, 0, "0", "0")
    # halves add up, also for groups
    halves = [of(rows[:30]), of(rows[30:])]
    assert int(same["sum_high"]) == sum(int(h["sum_high"]) for h in halves)
    assert sum(r["n_rows"] for r in digests.table_digest(session.createDataFrame(rows, kind), "a").collect()) == 62


def test_membership(session):
    import hashlib

    proof = lambda ids: hashlib.sha256("\n".join(ids).encode()).hexdigest()
    good = {"ok": "xyz", "missing": "xyz", "extra": "xyz", "doubled": "xyz", "swapped": "xyz", "gap": "xyz", "other": "xyz", "none": ""}
    results = session.createDataFrame([(k, len(v), proof(list(v))) for k, v in good.items()], "id string, member_count long, member_digest string")
    held = {"ok": "xyz", "missing": "xy", "extra": "xyzw", "doubled": "xyy", "swapped": "yxz", "other": "xyw", "stray": "x"}
    rows = [(k, i + 1, m) for k, v in held.items() for i, m in enumerate(v)] + [("gap", i, m) for i, m in ((1, "x"), (2, "y"), (4, "z"))]
    out = digests.membership(results, session.createDataFrame(rows, "id string, ordinal int, member_id string"), "id")
    assert {r["id"]: r["fault"] for r in out.collect()} == {"ok": None, "none": None, "missing": "missing_members", "extra": "extra_members", "doubled": "doubled_member", "swapped": "other_members", "gap": "broken_order", "other": "other_members", "stray": "unknown_result"}
    assert out.filter(F.col("id") == "swapped").first()["members"] == ["y", "x", "z"]
