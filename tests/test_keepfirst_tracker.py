"""Keep-first rounds against the sequential rule (property test) and tracker golden cases."""

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hirelake.operators import tracker as trk
from hirelake.operators.keepfirst import keep_first
from hirelake.sources.schema import conform


def _postings(spark, rows):
    return conform(spark.createDataFrame(rows, "seq bigint, url string, company string, title string, location string"))


def _run(spark, rows):
    out = keep_first(_postings(spark, rows)).select("seq", "status", "duplicate_reason").collect()
    return {r["seq"]: ("unique" if r["status"] == "unique" else r["duplicate_reason"]) for r in out}


def test_chain_golden(spark):
    rows = [(1, "u1", "A", "t", "x"), (2, "u2", "A", "t", "x"), (3, "u2", "B", "t", "x")]
    assert _run(spark, rows) == {1: "unique", 2: "fuzzy_match", 3: "unique"}


def test_normalizer_golden(spark):
    rows = [(1, None, "TechCorp GmbH", "Dev (m/w/d)", "Wien"), (2, None, "techcorp", "dev", " wien ")]
    assert _run(spark, rows) == {1: "unique", 2: "fuzzy_match"}


row = st.tuples(st.sampled_from([None, "", "u1", "u2", "u3"]), st.sampled_from(["A", "B", "a gmbh"]),
                st.sampled_from(["t1", "t2"]), st.sampled_from(["x", ""]))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=12))
def test_keep_first_invariants(spark, rows):
    """What defines the result: kept rows share no url and no key, and a row is a duplicate exactly if an earlier kept
    row has its url (reason exact_url) or else its key (fuzzy_match)."""
    data = [(i + 1, u, c, t, lo) for i, (u, c, t, lo) in enumerate(rows)]
    got = _run(spark, data)
    key = {s: (c.replace(" gmbh", "").lower(), t, lo) for s, u, c, t, lo in data}
    url = {s: u or None for s, u, *_ in data}
    kept = [s for s in got if got[s] == "unique"]
    for s, what in got.items():
        by_url = any(k < s and url[k] and url[k] == url[s] for k in kept)
        by_key = any(k < s and key[k] == key[s] for k in kept)
        assert what == ("exact_url" if by_url else "fuzzy_match" if by_key else "unique")


T0 = datetime(2025, 11, 22, 10, 0, 0)


def _events(spark, rows):
    schema = ("session string, seq bigint, ts timestamp, kind string, job_id string, company string, title string, "
              "status string, directory string, extra map<string,string>")
    full = [(r[0], r[1], T0 + timedelta(minutes=r[1]), *r[2:]) for r in rows]
    return spark.createDataFrame(full, schema)


def test_tracker_add_twice_keeps_second_and_update_unknown_is_noop(spark):
    ev = _events(spark, [
        ("s", 1, "add", "j1", "C1", "T1", "in_progress", "d1", {"note": "a"}),
        ("s", 2, "update", "j1", None, None, "failed", None, {"reason": "x"}),
        ("s", 3, "add", "j1", "C2", "T2", "in_progress", "d2", None),
        ("s", 4, "update", "j9", None, None, "completed", None, None),
        ("s", 5, "add", "j2", "C3", "T3", "in_progress", "d3", None),
        ("s", 6, "update", "j2", None, None, "completed", None, {"k": "v"}),
    ])
    state = {r["job_id"]: r for r in trk.tracker_state(ev).collect()}
    assert set(state) == {"j1", "j2"}
    assert (state["j1"]["company"], state["j1"]["status"], state["j1"]["updated_at"]) == ("C2", "in_progress", None)
    assert state["j1"]["extra"] is None
    assert state["j2"]["status"] == "completed" and state["j2"]["extra"] == {"k": "v"}


def test_completion_rate_zero_total(spark):
    ev = _events(spark, [("s", 1, "add", "j1", "C", "T", "completed", "d", None)])
    sessions = spark.createDataFrame([("s", 0), ("s2", 4)], "session string, total_jobs bigint")
    stats = {r["session"]: r for r in trk.session_statistics(trk.tracker_state(ev), sessions).collect()}
    assert stats["s"]["completion_rate"] == 0.0 and stats["s"]["successful"] == 1
    assert stats["s2"]["completion_rate"] == 0.0 and stats["s2"]["successful"] == 0


def test_open_resets_the_session(spark):
    ev = _events(spark, [("p", 1, "add", "j1", "A", "t", "in_progress", "d", None), ("p", 2, "session_open", None, None, None, None, None, None),
                         ("p", 3, "update", "j1", None, None, "completed", None, None), ("p", 4, "add", "j2", "B", "t", "failed", "d", None),
                         ("q", 5, "add", "j1", "A", "t", "failed", "d", None)])
    assert sorted((r["session"], r["job_id"]) for r in trk.tracker_state(ev).collect()) == [("p", "j2"), ("q", "j1")]
