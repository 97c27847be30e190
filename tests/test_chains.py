"""Chains as of a cutoff: corrections that don't hold, cycles of any length, repetitions and the market's own view."""

import datetime

import pytest

from tidemark.operators import chains

T = lambda h: datetime.datetime(2024, 1, 1, h)
QUOTE = "event_id long, contract_id string, event_type string, version_id long, mapping_id long, exchange_timestamp timestamp, received_at timestamp, available_at timestamp, availability_basis string, provider_sequence long, event_order long, supersedes_event_id long, bid double"
N, STEP = 40, 1000


def late(base, number):
    return (base + 41, f"c{number}", "option", number, number, T(5), None, T(2), "historical_import", None, None, None, 1.0)


def again(base, number, bid):
    return (base + 40, f"c{number}", "option", number, number, T(1) + datetime.timedelta(minutes=40), None, T(2), "received", None, None, None, bid)


# Scenarios: corrections among the quotes 1 to 40 of a contract's minutes, more rows, and what is expected as of known hour 20.
SCENARIOS = [
    ({}, None, (None, 40)), ({39: 40}, None, (None, 39)), ({i: i - 1 for i in range(2, 41)}, None, (None, 40)), ({i: i + 1 for i in range(1, 40)}, None, (None, 1)),
    ({1: 40, **{i: i - 1 for i in range(2, 41)}}, None, ("cycle", None)), ({7: 8, 8: 9, 9: 7}, None, ("cycle", None)), ({5: 4, 6: 4}, None, ("branch", None)), ({5: 5}, None, ("self", None)), ({5: 99}, None, ("no_eligible_target", None)),
    ({}, late, (None, 40)), ({}, lambda b, n: again(b, n, 40.0), (None, 40)), ({}, lambda b, n: again(b, n, 41.0), (None, 39)), ({39: 40}, lambda b, n: again(b, n, 41.0), ("no_eligible_target", None)),
]


@pytest.fixture(scope="module")
def tables(session):
    rows = []
    for number, (corrections, more, _) in enumerate(SCENARIOS):
        base = STEP * number
        rows += [(base + i, f"c{number}", "option", number, number, T(1) + datetime.timedelta(minutes=i), None, T(2), "received", None, None, base + corrections[i] if i in corrections else None, float(i)) for i in range(1, N + 1)]
        rows += [more(base, number)] if more else []
    # one more contract whose last quote corrects that of another
    rows += [(90_001, "d", "option", 90, 90, T(3), None, T(3), "received", None, None, 1, 1.0)]
    interval, stored = [T(0), None, T(0), None], "valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp"
    ids = [*range(len(SCENARIOS)), 90]
    return (
        session.createDataFrame(rows, QUOTE), session.createDataFrame([(i, "d" if i == 90 else f"c{i}", *interval) for i in ids], f"version_id long, contract_id string, {stored}"), session.createDataFrame([(i, i, *interval) for i in ids], f"mapping_id long, version_id long, {stored}"),
        session.createDataFrame([(r[0], "q", 1, r[0], T(3), "accepted") for r in rows], "event_id long, policy_id string, policy_version int, assessment_id long, recorded_at timestamp, disposition string").distinct(),
    )


def chain(tables, known):
    judged = chains.eligibility(*tables, chains.Cutoff(T(12), known, "q", 1)).checkpoint()
    return {r["contract_id"]: (r["fault"], r["event_id"]) for r in chains.chain(judged, chains.correction_faults(judged), "bid").collect()}


def test_chains_known_at_a_moment(tables):
    want = {f"c{i}": (fault, None if event is None else STEP * i + event) for i, (_, _, (fault, event)) in enumerate(SCENARIOS)}
    assert chain(tables, T(20)) == want | {"d": ("other_contract", None)}


def test_the_markets_view_needs_no_knowledge_time(tables):
    got = chain(tables, None)
    assert got["c9"] == (None, 9 * STEP + 41) and got["c0"] == (None, 40)


def test_nothing_is_known_before_it_is_assessed(tables):
    assert chain(tables, T(2)) == {}
