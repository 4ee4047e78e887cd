"""Seed goldens (FIXTURES.md section 2) at as_of 2026-04-20 00:00:00."""

import datetime as dt

from support import SEED_AS_OF

from pyspark.sql import functions as F

from seatplan.operators import reports as R
from seatplan.operators import search as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_event_catalogue(seed):
    cat = R.with_event_state(R.event_catalogue(seed), SEED_AS_OF)
    got = rows(cat, "event_id", "booking_total", "staff_total", "supplier_total", "fill_pct")
    assert got == [(1, 1, 2, 2, 0), (2, 1, 2, 1, 1), (3, 1, 2, 2, 0)]
    assert all(not r["is_past"] and not r["is_full"] for r in cat.collect())


def test_organizer_and_customer_totals(seed):
    assert rows(R.organizer_summary(seed), "customer_id", "events_created", "bookings_received") \
        == [(1, 2, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0)]
    assert rows(R.customer_booking_totals(seed), "customer_id", "booking_total") \
        == [(1, 0), (2, 0), (3, 2), (4, 1)]


def test_usage_and_unassigned(seed):
    assert rows(R.staff_usage(seed), "staff_id", "usage_total") == [(1, 2), (2, 2), (3, 2)]
    assert rows(R.supplier_usage(seed), "supplier_id", "usage_total") == [(1, 1), (2, 2), (3, 2)]
    assert rows(R.venue_usage(seed), "venue_id", "usage_total") == [(1, 1), (2, 1), (3, 1)]
    for f in (R.unassigned_venues, R.unassigned_staff, R.unassigned_suppliers):
        assert f(seed).count() == 0


def test_roster_and_itinerary_order(seed):
    roster = [(r["event_id"], r["attendee_id"]) for r in
              R.attendee_roster(seed, organizer_ids=[1]).collect()]
    assert roster == [(1, 3), (3, 3)]
    itin = [r["booking_id"] for r in R.customer_itinerary(seed, customer_ids=[3]).collect()]
    assert itin == [1, 3]


def test_search(seed):
    assert [r["event_id"] for r in S.event_search(seed, "space ROOM").collect()] == [2]
    assert [r["event_id"] for r in S.event_search(seed, "  rina  ").collect()] == [1, 3]
    assert S.event_search(seed, "   ").count() == 0
    # the page does not escape wildcards: "_" matches one character
    assert [r["event_id"] for r in S.event_search(seed, "P_tch").collect()] == [2]


def test_upcoming_edges(seed):
    at = dt.datetime(2026, 5, 22, 14, 0)
    assert [r["event_id"] for r in R.upcoming_events(seed, at).collect()] == [2, 3]
    st = {r["event_id"]: r["is_past"] for r in R.event_state(seed, at).collect()}
    assert st[2] is True  # at exactly as_of: upcoming on the dashboard, past elsewhere


def test_dashboard_and_activity(seed):
    r = R.dashboard_totals(seed).collect()[0]
    assert (r["events"], r["venues"], r["staff"], r["suppliers"]) == (3, 3, 3, 3)
    top = R.booking_activity_report(seed, k=2).collect()
    assert [x["audit_id"] for x in top] == [3, 2]


def test_activity_report_archived_names(spark, seed):
    from support import T
    extra = spark.createDataFrame([(9, None, 99, 77, "CANCELLED", "gone", T(2026, 4, 13, 0, 0))],
                                  seed.booking_audit_log.schema)
    t = seed.with_(booking_audit_log=seed.booking_audit_log.unionByName(extra))
    top = R.booking_activity_report(t, k=1).collect()[0]
    assert (top["event_name"], top["customer_name"]) == ("Archived Event", "Archived User")


def test_assignment_flags_and_lists(seed):
    flags = {(r["kind"], r["id"]): r["checked"] for r in R.assignment_flags(seed, 2).collect()}
    assert flags[("venue", 2)] and not flags[("venue", 1)]
    assert flags[("staff", 1)] and flags[("staff", 3)] and not flags[("staff", 2)]
    assert flags[("supplier", 2)] and not flags[("supplier", 1)]
    assert [r["venue_name"] for r in R.list_venues(seed).collect()] == \
        ["Grand Hall", "Lawn Stage", "Maker Space Room"]
    a = {r["event_id"]: (list(r["staff_ids"]), list(r["supplier_ids"]))
         for r in R.event_assignments(seed).collect()}
    assert a[1] == ([1, 2], [2, 3]) and a[2] == ([1, 3], [2])


def test_viewer_action(spark, seed):
    views = spark.createDataFrame([(1, 3, 1), (2, 4, 1), (3, 1, 1), (4, 2, 1), (5, 3, 2)],
                                  "view_id long, viewer_id long, event_id long")
    got = {r["view_id"]: r["action"] for r in
           S.viewer_action(seed, views, SEED_AS_OF).collect()}
    assert got == {1: "Already Booked", 2: "Reserve Seat", 3: "Edit/Delete", 4: None,
                   5: "Reserve Seat"}
    late = {r["view_id"]: r["action"] for r in
            S.viewer_action(seed, views, dt.datetime(2026, 5, 11)).collect()}
    assert late[2] == "Event Closed" and late[1] == "Already Booked"


def test_owned_and_profile(spark, seed):
    claims = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "event_id long, customer_id long")
    assert sorted(r["event_id"] for r in R.owned_events(seed, claims).collect()) == [1, 3]
    assert "password" not in R.account_profile(seed).columns


def test_term_batch(spark, seed):
    terms = spark.createDataFrame([("rina",), ("hall",), ("  ",), ("pitch",), ("fair",),
                                   ("culture",), ("P_tch",), ("RÍNA",), ("R_ná",), ("pi\\tch",),
                                   ("nowhere",), ("x" * 3_000_000,)], "term string")
    got = {(r["term"], r["event_id"]) for r in S.search_terms_batch(seed, terms).collect()}
    assert got == {("rina", 1), ("rina", 3), ("pitch", 2), ("P_tch", 2), ("fair", 1), ("culture", 3),
                   ("hall", 1), ("RÍNA", 1), ("RÍNA", 3), ("R_ná", 1), ("R_ná", 3), ("pi\\tch", 2)}
    hits = {r["term"]: r["hits"] for r in S.search_hit_counts(seed, terms).collect()}
    assert hits["hall"] == 1 and hits["rina"] == 2 and hits["nowhere"] == 0 and "" not in hits
    everything = spark.createDataFrame([("%",), ("_",)], "term string")
    assert S.search_terms_batch(seed, everything).count() == 2 * seed.events.count()
    # One search, term by term, says the same.
    for term in ("rina", "P_tch", "pi\\tch", "R_ná"):
        one = {r["event_id"] for r in S.event_search(seed, term).collect()}
        assert one == {e for t, e in got if t == term}


def test_upcoming_leaves_orphans_out(spark, seed):
    at = dt.datetime(2020, 1, 1)
    whole = [r["event_id"] for r in R.upcoming_events(seed, at, k=2).collect()]
    first = seed.events.filter(F.col("event_id") == whole[0]).first()["venue_id"]
    cut = seed.with_(venues=seed.venues.filter(F.col("venue_id") != first))
    left = [r["event_id"] for r in R.upcoming_events(cut, at, k=2).collect()]
    kept = [e for e in [r["event_id"] for r in R.upcoming_events(seed, at, k=99).collect()]
            if seed.events.filter(F.col("event_id") == e).first()["venue_id"] != first]
    assert left == kept[:2]


def test_assignment_flags_of_many_events(spark, seed):
    events = seed.events.select("event_id")
    got = {(r["event_id"], r["kind"], r["id"]) for r in R.assignment_flags_of(seed, events).collect()}
    want = {(e["event_id"], r["kind"], r["id"]) for e in events.collect()
            for r in R.assignment_flags(seed, e["event_id"]).collect() if r["checked"]}
    assert got == want and got


def test_clock_is_zone_free(spark, seed):
    at = dt.datetime(2026, 5, 22, 14, 0)
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Dhaka")
        assert [r["event_id"] for r in R.upcoming_events(seed, at).collect()] == [2, 3]
        assert {r["event_id"]: r["is_past"] for r in R.event_state(seed, at).collect()}[2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_viewer_action_search_page_label(spark, seed):
    views = spark.createDataFrame([(1, 1, 3), (2, 2, 3)], "view_id long, viewer_id long, event_id long")
    got = {r["view_id"]: r["action"] for r in
           S.viewer_action(seed, views, SEED_AS_OF, page="search").collect()}
    assert got == {1: "Edit", 2: None}


def test_assignment_flags_unknown_event(seed):
    rows = R.assignment_flags(seed, 999).collect()
    assert len(rows) == 9 and not any(r["checked"] for r in rows)
