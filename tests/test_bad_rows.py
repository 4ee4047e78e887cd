"""One bad input row is rejected; it never ends the job."""

import datetime as dt

from support import T, SEED_AS_OF

from pyspark.sql import functions as F

from seatplan.functions import text as X
from seatplan.operators import changes as C
from seatplan.operators import validate as V
from seatplan.sources import schemas


def test_capacity_beyond_int(spark):
    rows = spark.createDataFrame([(1, "Hall", "Road", "99999999999"), (2, "Hall", "Road", "12"),
                                  (3, "Hall", "Road", "9" * 40), (4, "Hall", "Road", "abc")],
                                 "request_id long, venue_name string, address string, capacity string")
    got = {r["request_id"]: r["reason"] for r in V.validate_venues(rows).collect()}
    assert got == {1: "CAPACITY_OUT_OF_RANGE", 2: None, 3: "CAPACITY_OUT_OF_RANGE", 4: "VENUE_FIELDS"}


def test_integer_casts_saturate(spark):
    df = spark.createDataFrame([("9" * 30,), ("-" + "9" * 30,), (" 12abc",), ("1e3",), ("x",)], "v string")
    got = [r[0] for r in df.select(X.php_intval("v")).collect()]
    assert got == [2 ** 63 - 1, -2 ** 63, 12, 1000, 0]


def test_budget_text_that_is_no_number(spark):
    rows = spark.createDataFrame([(1, 1, 1, "x", "2026-05-01T10:00", "much", None, None)],
                                 "draft_id long, customer_id long, venue_id long, event_name string, "
                                 "event_time string, budget string, staff_ids array<string>, "
                                 "supplier_ids array<string>")
    assert V.validate_events(rows, SEED_AS_OF).first()["reason"] == "BAD_BUDGET"


def test_times_that_a_session_zone_skips(spark):
    df = spark.createDataFrame([("2026-03-08T02:30",), ("2026-03-08 02:30:15",), ("2026-03-08",),
                                ("2026-13-08",), ("soon",)], "v string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(X.parse_datetime_text("v")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2026, 3, 8, 2, 30), dt.datetime(2026, 3, 8, 2, 30, 15),
                   dt.datetime(2026, 3, 8), None, None]


def test_backslash_in_a_term(spark):
    df = spark.createDataFrame([("aXb",), ("ab",), ("a%b",)], "v string")
    found = lambda term: [r["v"] for r in df.filter(X.ci_contains("v", term)).collect()]
    assert found("a\\b") == ["ab"] and found("a\\%b") == ["a%b"] and found("a_b") == ["aXb", "a%b"]


def test_null_event_id_is_invalid(spark, seed):
    req = spark.createDataFrame([(1, None, 4, T(2026, 4, 21))], schemas.BOOKING_REQUESTS)
    assert C.admit_bookings(seed, req).first()["outcome"] == "INVALID_EVENT"


def test_over_long_accounts(spark, seed):
    rows = [(1, "n" * 150, "+880", "a@x.example.com", "abcdef", "customer"),
            (2, "Name", "+880", "a@x.example.com", "abcdef", "customer"),
            (3, "Name", "0" * 40, "b@x.example.com", "abcdef", "customer"),
            (4, "Name", "+880", "c" * 60 + "@" + "d" * 60 + ".example.com", "abcdef", "customer")]
    got = {r["request_id"]: r["reason"] for r in
           V.validate_signups(seed, spark.createDataFrame(rows, schemas.SIGNUPS)).collect()}
    assert got == {1: "REGISTRATION_FAILED", 2: None, 3: "REGISTRATION_FAILED", 4: "REGISTRATION_FAILED"}
    edits = [(1, 3, "n" * 150, "+880", "new@x.example.com", ""), (2, 4, "Name", "+880", "new@x.example.com", "")]
    got = {r["request_id"]: r["reason"] for r in V.validate_profile_updates(
        seed, spark.createDataFrame(edits, schemas.PROFILE_UPDATES)).collect()}
    assert got == {1: "PROFILE_FAILED", 2: None}


def test_null_foreign_keys_are_not_orphans(spark, seed):
    b = seed.bookings.limit(1).withColumn("event_id", F.lit(None).cast("long")).withColumn(
        "booking_id", F.lit(999).cast("long"))
    t = seed.with_(bookings=seed.bookings.unionByName(b))
    got = {(r["table_name"], r["rule"]): r["violations"] for r in V.integrity_report(t).collect()}
    assert got["bookings", "foreign_key:event_id"] == 0 and got["bookings", "not_null:event_id"] == 1


def test_integrity_counts_are_positive(spark, seed):
    e = seed.events
    bad = seed.with_(
        events=e.unionByName(e.limit(1)),
        bookings=seed.bookings.unionByName(seed.bookings.limit(1).withColumn("customer_id", F.lit(777).cast("long"))),
        customers=seed.customers.unionByName(
            seed.customers.limit(1).withColumn("customer_id", F.lit(888).cast("long"))
            .withColumn("role", F.lit("guest")).withColumn("name", F.lit("n" * 101))))
    got = {(r["table_name"], r["rule"]): r["violations"] for r in V.integrity_report(bad).collect()}
    for key in (("events", "primary_key"), ("bookings", "primary_key"), ("bookings", "foreign_key:customer_id"),
                ("customers", "unique:email"), ("customers", "enum:role"), ("customers", "max_length:name")):
        assert got[key] == 1, key
