import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from seatplan.functions import text as X
from seatplan.functions.dates import strtotime
from seatplan.operators import validate as V
from seatplan.operators.reports import fill_rate_expr
from seatplan.sources import schemas


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_normalize_text(spark):
    assert one(spark, X.normalize_text("v"), "  a \t\n b\x0bc\r\n  ") == "a b c"
    assert one(spark, X.normalize_text("v"), " x") == " x"  # not ASCII whitespace


def test_email(spark):
    ok = ["a@b.co", "first.last+tag@sub.example.org", "customer#000000003@example.com"]
    bad = ["user.example.com", "a@b", ".a@b.com", "a..b@c.com", "a@-b.com", "", "a b@c.com"]
    df = spark.createDataFrame([(e,) for e in ok + bad], "v string")
    got = {r["v"]: r["o"] for r in df.select("v", X.email_is_valid("v").alias("o")).collect()}
    assert all(got[e] for e in ok) and not any(got[e] for e in bad)


def test_collation_match(spark):
    df = spark.createDataFrame([("Ångström Hall",)], "v string")
    assert df.filter(X.ci_contains("v", "angstrom h")).count() == 1
    # wildcard path: "_" is any one character; case- and accent-blind like a plain term
    assert df.filter(X.ci_contains("v", "ng_tr")).count() == 1
    assert df.filter(X.ci_contains("v", "gstro_")).count() == 1
    assert df.filter(X.ci_contains("v", "gstr_x")).count() == 0
    assert df.filter(X.ci_contains("v", "GSTRÖ_")).count() == 1


def test_formatters(spark):
    ts = dt.datetime(2026, 5, 10, 14, 5)
    assert one(spark, X.format_datetime("v"), ts, "v timestamp_ntz") == "May 10, 2026 02:05 PM"
    assert one(spark, X.format_input_time("v"), ts, "v timestamp_ntz") == "2026-05-10T14:05"
    assert one(spark, X.format_currency("v"), Decimal("12000.50"), "v decimal(12,2)") == \
        "BDT 12,000.50"
    assert one(spark, X.format_currency("v"), 0.125, "v double") == "BDT 0.13"  # half up
    assert one(spark, X.ucfirst("v"), "customer") == "Customer"
    assert one(spark, X.initials("v"), " rina organizer smith") == "RO"
    assert one(spark, X.format_datetime_text("v"), "not a date") == "not a date"


def test_intval_and_id_lists(spark):
    df = spark.createDataFrame([(["12abc", "abc", "3", "12", " 7"],)], "v array<string>")
    assert df.select(X.parse_id_list("v").alias("o")).first()["o"] == [12, 0, 3, 7]
    vals = ["1e3", "12.7x", "-4.9", " \t+8", ".5", "0x1A", "", "-0", "99999999999999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["o"] for r in df.select(X.php_intval("v").alias("o")).collect()]
    assert got[:8] == [1000, 12, -4, 8, 0, 0, 0, 0]


def test_fill_rate_rounding(spark):
    df = spark.createDataFrame([(57, 200), (1, 3), (2, 3), (5, 0), (900, 10)],
                               "booking_total int, capacity int")
    got = [r["o"] for r in df.select(fill_rate_expr().alias("o")).collect()]
    assert got == [29, 33, 67, 0, 100]


def test_parse_datetime(spark):
    df = spark.createDataFrame([("2026-05-10T10:00",), ("2026-05-10 10:00:00",), ("next friday",),
                                ("",)], "v string")
    got = [r["o"] for r in df.select(X.parse_datetime_text("v").alias("o")).collect()]
    assert got[:2] == [dt.datetime(2026, 5, 10, 10, 0)] * 2 and got[2:] == [None, None]


NOW = dt.datetime(2026, 4, 22, 13, 30, 15)  # a Wednesday
MOMENTS = {
    "2026-05-10": (2026, 5, 10), "2026-05-10T10:00": (2026, 5, 10, 10), "2026-05-10 10:00:30": (2026, 5, 10, 10, 0, 30),
    "2026/5/9 2:05 pm": (2026, 5, 9, 14, 5), "20260510": (2026, 5, 10), "5/10/2026": (2026, 5, 10), "10-5-2026": (2026, 5, 10),
    "10.05.2026 23:59": (2026, 5, 10, 23, 59), "10 May 2026": (2026, 5, 10), "May 10, 2026": (2026, 5, 10),
    "May 10th, 2026 2pm": (2026, 5, 10, 14), "2pm May 10 2026": (2026, 5, 10, 14), "10-May-2026": (2026, 5, 10), "10 may": (2026, 5, 10),
    "may 2026": (2026, 5, 1), "sept 3 2026": (2026, 9, 3), "30 april 2026 10:00 pm": (2026, 4, 30, 22), "today": (2026, 4, 22),
    "tomorrow noon": (2026, 4, 23, 12), "yesterday 10:00": (2026, 4, 21, 10), "now": (2026, 4, 22, 13, 30, 15), "midnight": (2026, 4, 22),
    "+1 week 2 days": (2026, 5, 1, 13, 30, 15), "3 weeks ago": (2026, 4, 1, 13, 30, 15), "next month": (2026, 5, 22, 13, 30, 15),
    "last year": (2025, 4, 22, 13, 30, 15), "+90 minutes": (2026, 4, 22, 15, 0, 15), "tomorrow +2 hours": (2026, 4, 23, 2),
    "next friday": (2026, 4, 24), "wednesday": (2026, 4, 22), "next wednesday": (2026, 4, 29), "last wednesday": (2026, 4, 15),
    "next monday 9am": (2026, 4, 27, 9), "last mon": (2026, 4, 20), "2026-01-31 +1 month": (2026, 3, 3), "2026-02-30": (2026, 3, 2),
    "12am": (2026, 4, 22), "12pm": (2026, 4, 22, 12), "@86400": (1970, 1, 2), "10th of May": None, "maybe 3 2026": None,
    "2026-13-01": None, "2026-05-32": None, "25:00": None, "13pm": None, "not a date": None, "": None, "   ": None,
    "2026-05-10 banana": None, "next next": None}


def test_strtotime(spark):
    df = spark.createDataFrame([(k,) for k in [*MOMENTS, None]], "v string")
    got = {r.v: r.o for r in df.select("v", strtotime(F.col("v"), F.lit(NOW)).alias("o")).collect()}
    assert got == {k: v and dt.datetime(*v) for k, v in MOMENTS.items()} | {None: None}
    # Without a moment to count from, only full dates are known.
    bare = {r.v: r.o for r in df.select("v", strtotime(F.col("v")).alias("o")).collect()}
    assert bare["next friday"] is None and bare["10 may"] is None and bare["May 10, 2026"] == dt.datetime(2026, 5, 10)
    assert one(spark, X.format_datetime_text("v"), "10 May 2026 2pm") == "May 10, 2026 02:00 PM"


def test_free_form_times_pass_the_page_and_not_the_table(spark):
    rows = [(1, "next friday"), (2, "last friday"), (3, "2026-05-01 10:00"), (4, "when it suits")]
    drafts = spark.createDataFrame([(i, 1, 1, "Event", t, 5.0, None, None) for i, t in rows], schemas.EVENT_DRAFTS)
    got = {r.draft_id: r.reason for r in V.validate_events(drafts, NOW).collect()}
    assert got == {1: "TIME_REFUSED", 2: "NOT_FUTURE", 3: None, 4: "NOT_FUTURE"}


def test_email_forms(spark):
    ok = ['"a b"@example.com', '"q@x".y@example.com', 'a."b\\"c"@example.org', "a@[192.0.2.1]", "a@[IPv6:2001:db8::1]",
          "a@[IPv6:1:2:3:4:5:6:7:8]", "a@[IPv6:::ffff:192.0.2.1]", "u" * 64 + "@example.com", "a@" + "l" * 63 + ".com", "a@x--y.com",
          '"' + "u" * 64 + '"@example.com', "a@b.c"]
    bad = ['"a@example.com', 'a"b"@example.com', '"a\\"@example.com', "a@[192.0.2.256]", "a@[192.0.2]", "a@[IPv6:1:2:3:4:5:6:7]",
           "a@[IPv6:1::2::3]", "a@[IPv6:12345::1]", "u" * 65 + "@example.com", "a@" + "l" * 64 + ".com", "a@x-.com", "a@-x.com", "a@b.1",
           "a@b@c.com", "é@example.com", "a@[192.0.2.1", "@example.com", "a@", "a@" + ".".join(["l" * 60] * 5) + ".com", None]
    df = spark.createDataFrame([(e,) for e in ok + bad], "v string")
    got = {r["v"]: r["o"] for r in df.select("v", X.email_is_valid("v").alias("o")).collect()}
    assert [e for e in ok if not got[e]] == [] and [e for e in bad if got[e]] == []
