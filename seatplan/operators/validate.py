"""Batch validation: every input row gets ``reason`` (NULL when accepted).

Checks run in the reference's own order (page checks, then the database
trigger / constraint), and the first failure wins, written as one CASE WHEN.
Duplicate and already-taken checks are joins and per-key minimums, never a
window over a key that might be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatplan.functions.dates import strtotime
from seatplan.functions.text import (email_is_valid, normalize_text, parse_datetime_text,
                                     php_intval)
from seatplan.operators.releases import settle_claims
from seatplan.operators.reports import _ts, booking_counts
from seatplan.plans.lineage import materialize
from seatplan.plans.numbering import row_numbers
from seatplan.sources.tables import Tables

# Reason codes and the messages the app shows for them.
MESSAGES = {
    "REQUIRED": "Please fill in all required fields.",
    "NOT_FUTURE": "Please choose a future date and time for the event.",
    "BAD_BUDGET": "Please enter a valid event budget.",
    "TIME_REFUSED": "Unable to save: the event time is not written as a date.",
    "NAME_BLANK": "Event name is required.",
    "PAST_AT_SAVE": "Event date must be in the future.",
    "BUDGET_NOT_POSITIVE": "Event budget must be greater than zero.",
    "TOO_LONG": "Unable to save: a value is longer than its column allows.",
    "BUDGET_OUT_OF_RANGE": "Unable to save: the budget is out of range.",
    "VENUE_FIELDS": "Please provide a venue name, address, and valid capacity.",
    "CAPACITY_OUT_OF_RANGE": "Unable to save: the capacity is out of range.",
    "STAFF_FIELDS": "Please complete every staff field.",
    "SUPPLIER_FIELDS": "Please complete every supplier field.",
    "NAME_PHONE": "Please complete your name and phone number.",
    "BAD_EMAIL": "Please enter a valid email address.",
    "SHORT_PASSWORD": "Password must be at least 6 characters long.",
    "REGISTRATION_FAILED": "Registration failed. Please try again.",
    "PROFILE_FAILED": "Unable to update your profile.",
    "EMAIL_TAKEN": "That email address is already registered.",
    "PROFILE_NAME_PHONE": "Name and phone number are required.",
    "PROFILE_SHORT_PASSWORD": "New password must be at least 6 characters long.",
    "PROFILE_EMAIL_TAKEN": "That email is already used by another account.",
}


def first_failure(*checks: tuple[Column, str]) -> Column:
    """CASE WHEN c1 THEN code1 WHEN c2 THEN code2 ... END (NULL = passed)."""
    out = None
    for cond, code in checks:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, F.lit(code)) if out is None else out.when(c, F.lit(code))
    return out


def message_of(reason: Column) -> Column:
    m = F.create_map(*[x for k, v in MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, reason)


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("reason").isNull(), "accepted")
                         .otherwise("rejected"))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNull())


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reason").isNotNull())


# ---------------------------------------------------------------- V03 events
def validate_events(drafts: DataFrame, as_of) -> DataFrame:
    """Page checks, then trigger checks, for new or edited events.

    Adds ``event_name_n`` (normalized), ``event_ts`` (parsed time),
    ``budget_n`` (decimal(12,2), rounded as the column stores it),
    ``venue_n`` (int id), ``reason``, ``message`` and ``status``.
    A budget of 0.001 passes the page (> 0) but is 0.00 once stored, so the
    trigger rejects it.  The page reads free-form times ("next friday"), the
    table takes none of them.
    """
    now = _ts(as_of)
    name = F.coalesce(normalize_text("event_name"), F.lit(""))  # a missing field reads as ""
    ts = parse_datetime_text("event_time")
    budget = F.coalesce(F.col("budget").try_cast("double"), F.lit(0.0))
    stored = budget.try_cast("decimal(12,2)")
    venue = F.coalesce(F.col("venue_id").try_cast("bigint"), F.lit(0).cast("bigint"))
    moment = F.when(ts.isNotNull(), ts).otherwise(strtotime(F.col("event_time"), now))
    df = (drafts.withColumn("event_name_n", name).withColumn("event_ts", ts).withColumn("_moment", moment)
          .withColumn("budget_n", stored).withColumn("venue_n", venue))
    reason = first_failure(
        ((F.col("event_name_n") == "") | (F.coalesce(F.col("event_time"), F.lit("")) == "")
         | (F.col("venue_n") == 0), "REQUIRED"),
        (F.col("_moment").isNull() | ~(F.col("_moment") > now), "NOT_FUTURE"),
        (budget <= 0, "BAD_BUDGET"),
        (F.col("event_ts").isNull(), "TIME_REFUSED"),
        (F.trim(F.col("event_name_n")) == "", "NAME_BLANK"),
        (F.col("event_ts") <= now, "PAST_AT_SAVE"),
        (F.col("budget_n").isNull(), "BUDGET_OUT_OF_RANGE"),
        (F.col("budget_n") <= 0, "BUDGET_NOT_POSITIVE"),
        (F.char_length("event_name_n") > 150, "TOO_LONG"),
    )
    return with_status(df.withColumn("reason", reason).drop("_moment").withColumn("message", message_of(
        F.col("reason"))))


# ----------------------------------------------------------- V04-V06 resources
def validate_venues(rows: DataFrame) -> DataFrame:
    df = (rows.withColumn("venue_name", F.coalesce(normalize_text("venue_name"), F.lit("")))
          .withColumn("address", F.coalesce(normalize_text("address"), F.lit("")))
          .withColumn("_given", php_intval(F.col("capacity").cast("string")))
          .withColumn("capacity", F.col("_given").try_cast("int")))
    reason = first_failure(
        ((F.col("venue_name") == "") | (F.col("address") == "") | (F.col("_given") <= 0),
         "VENUE_FIELDS"),
        ((F.char_length("venue_name") > 120) | (F.char_length("address") > 255), "TOO_LONG"),
        (F.col("capacity").isNull(), "CAPACITY_OUT_OF_RANGE"))
    return with_status(df.withColumn("reason", reason).drop("_given"))


def validate_staff(rows: DataFrame) -> DataFrame:
    df = rows
    for c in ("name", "role", "phone"):
        df = df.withColumn(c, F.coalesce(normalize_text(c), F.lit("")))
    reason = first_failure(
        ((F.col("name") == "") | (F.col("role") == "") | (F.col("phone") == ""), "STAFF_FIELDS"),
        ((F.char_length("name") > 100) | (F.char_length("role") > 100)
         | (F.char_length("phone") > 20), "TOO_LONG"))
    return with_status(df.withColumn("reason", reason))


def validate_suppliers(rows: DataFrame) -> DataFrame:
    df = rows
    for c in ("name", "phone", "service_type"):
        df = df.withColumn(c, F.coalesce(normalize_text(c), F.lit("")))
    reason = first_failure(
        ((F.col("name") == "") | (F.col("phone") == "") | (F.col("service_type") == ""),
         "SUPPLIER_FIELDS"),
        ((F.char_length("name") > 100) | (F.char_length("phone") > 20)
         | (F.char_length("service_type") > 120), "TOO_LONG"))
    return with_status(df.withColumn("reason", reason))


# ------------------------------------------------------------ V07 signups
def _dealt_out(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` spread over the cores: a small file is read by one task, and the
    checks of a row cost far more than moving it."""
    return rows.repartition(*columns)


def _email_key(c: str) -> Column:
    return F.collate(F.col(c), "UNICODE_CI_AI_RTRIM")


def _too_long(**limits: int) -> Column:
    out = F.lit(False)
    for c, n in limits.items():
        out = out | (F.char_length(c) > n)
    return out


def validate_signups(t: Tables, signups: DataFrame) -> DataFrame:
    """Registration rules in page order; the first request for a free e-mail wins.

    Unknown roles become ``customer``.  An e-mail is taken when an account
    holds it (collation-blind) or an earlier request in the batch that passed
    every other check asked for it.
    """
    df = (_dealt_out(signups, "request_id", "email")
          .withColumn("role", F.when(F.col("role").isin("customer", "organizer"), F.col("role"))
                      .otherwise(F.lit("customer")))
          .withColumn("name", F.coalesce(normalize_text("name"), F.lit("")))
          .withColumn("phone", F.coalesce(normalize_text("phone"), F.lit("")))
          .withColumn("email", F.coalesce(normalize_text("email"), F.lit("")))
          .withColumn("password", F.coalesce(F.col("password"), F.lit(""))))
    pre = first_failure(
        ((F.col("name") == "") | (F.col("phone") == ""), "NAME_PHONE"),
        (~email_is_valid("email"), "BAD_EMAIL"),
        (F.octet_length("password") < 6, "SHORT_PASSWORD"))
    # A value too long for its column fails at the insert, after the e-mail check,
    # and so never takes the e-mail.  Kept, as three branches read the checked rows.
    df = (materialize(df.withColumn("pre_reason", pre).withColumn("too_long", _too_long(name=100, phone=20, email=120)))
          .withColumn("ek", _email_key("email")))
    live = df.filter(F.col("pre_reason").isNull())
    held = t.customers.select(_email_key("email").alias("ek")).distinct() \
        .withColumn("held", F.lit(True))
    # Per e-mail key, the earliest otherwise-valid request: a map-side combined
    # minimum, so one e-mail used by a third of the batch is still cheap.  Rows
    # that failed before keep out of the joins on the e-mail.
    first = (live.filter(~F.col("too_long")).groupBy("ek")
             .agg(F.min("request_id").alias("first_req")))
    judged = (live.join(held, "ek", "left").join(first, "ek", "left")
              .withColumn("reason", F.when(
                  F.col("held").isNotNull() | (F.col("request_id") > F.col("first_req")),
                  F.lit("EMAIL_TAKEN")).when(F.col("too_long"), F.lit("REGISTRATION_FAILED")))
              .drop("held", "first_req"))
    failed = df.filter(F.col("pre_reason").isNotNull()).withColumn("reason", F.col("pre_reason"))
    return with_status(judged.unionByName(failed).drop("pre_reason", "ek", "too_long"))


# ------------------------------------------------------ V08 profile updates
def validate_profile_updates(t: Tables, updates: DataFrame) -> DataFrame:
    """Profile edit rules in request order; the e-mail must not be held by *another* account.

    As on the page, one request after the other: a granted one gives up the
    e-mail its account held before, which a later request may then take
    (:func:`seatplan.operators.releases.settle_claims`).  A value too long for
    its column, or an account that does not exist, takes no e-mail.
    """
    df = (_dealt_out(updates, "request_id", "customer_id", "email")
          .withColumn("name", F.coalesce(normalize_text("name"), F.lit("")))
          .withColumn("phone", F.coalesce(normalize_text("phone"), F.lit("")))
          .withColumn("email", F.coalesce(normalize_text("email"), F.lit("")))
          .withColumn("password", F.coalesce(F.col("password"), F.lit(""))))
    pre = first_failure(
        ((F.col("name") == "") | (F.col("phone") == ""), "PROFILE_NAME_PHONE"),
        (~email_is_valid("email"), "BAD_EMAIL"),
        ((F.col("password") != "") & (F.octet_length("password") < 6), "PROFILE_SHORT_PASSWORD"))
    # Kept: numbering reads the checked rows twice, and the failed ones are read again.
    df = (materialize(df.withColumn("pre_reason", pre).withColumn("too_long", _too_long(name=100, phone=20, email=120)))
          .withColumn("ek", _email_key("email")))
    accounts = (_dealt_out(t.customers.select("customer_id", "email"), "customer_id")
                .select("customer_id", _email_key("email").alias("ek")))
    # Rows that failed before keep out; so does a null account, which no account differs from.
    live = df.filter(F.col("pre_reason").isNull())
    numbered = row_numbers(live, ["request_id"], "at")
    claims = (numbered.filter("customer_id IS NOT NULL")
              .join(accounts.select("customer_id", F.lit(True).alias("exists")).distinct(), "customer_id", "left")
              .select("at", "customer_id", "ek", (F.col("exists").isNotNull() & ~F.col("too_long")).alias("effect")))
    granted = settle_claims(claims, accounts.filter("ek IS NOT NULL"))
    judged = (numbered.join(granted, "at", "left")
              .withColumn("reason", F.when(~F.col("granted"), F.lit("PROFILE_EMAIL_TAKEN"))
                          .when(F.col("too_long"), F.lit("PROFILE_FAILED")))
              .drop("at", "granted"))
    failed = df.filter(F.col("pre_reason").isNotNull()).withColumn("reason", F.col("pre_reason"))
    return with_status(judged.unionByName(failed).drop("pre_reason", "ek", "too_long"))


# ------------------------------------------------------- V09 integrity report
def _nn(*cols: str) -> dict[str, Column]:
    return {f"not_null:{c}": F.col(c).isNull() for c in cols}


def _len(**limits: int) -> dict[str, Column]:
    return {f"max_length:{c}": F.char_length(c) > n for c, n in limits.items()}


def _integrity_spec() -> dict[str, tuple]:
    """Per table: (row rules, primary key, unique columns, foreign keys as column -> parent table)."""
    return {
        "customers": ({**_nn("customer_id", "name", "phone", "email", "password", "role"),
                       "enum:role": ~F.col("role").isin("customer", "organizer"),
                       "check:password_length": F.char_length("password") < 6,
                       **_len(name=100, phone=20, email=120, password=255)},
                      ["customer_id"], None, {}),
        "venues": ({**_nn("venue_id", "venue_name", "address", "capacity"),
                    **_len(venue_name=120, address=255)}, ["venue_id"], None, {}),
        "staff": ({**_nn("staff_id", "name", "role", "phone"),
                   **_len(name=100, role=100, phone=20)}, ["staff_id"], None, {}),
        "suppliers": ({**_nn("supplier_id", "name", "phone", "service_type"),
                       **_len(name=100, phone=20, service_type=120)}, ["supplier_id"], None, {}),
        "events": ({**_nn("event_id", "customer_id", "venue_id", "event_name", "event_time", "budget"),
                    **_len(event_name=150)}, ["event_id"], None,
                   {"customer_id": "customers", "venue_id": "venues"}),
        "bookings": (_nn("booking_id", "booking_date", "event_id", "customer_id"), ["booking_id"],
                     ["event_id", "customer_id"], {"event_id": "events", "customer_id": "customers"}),
        "booking_audit_log": ({**_nn("audit_id", "event_id", "customer_id", "action_type",
                                     "action_note", "action_time"),
                               "enum:action_type": ~F.col("action_type").isin("BOOKED", "CANCELLED"),
                               **_len(action_note=255)}, ["audit_id"], None, {}),
        "event_staff": (_nn("event_id", "staff_id"), ["event_id", "staff_id"], None,
                        {"event_id": "events", "staff_id": "staff"}),
        "event_suppliers": (_nn("event_id", "supplier_id"), ["event_id", "supplier_id"], None,
                            {"event_id": "events", "supplier_id": "suppliers"}),
    }


def integrity_report(t: Tables) -> DataFrame:
    """(table_name, rule, violations) for every declared rule of the schema.

    Primary keys and UNIQUE (e-mail under the collation, (event, customer)),
    NOT NULL, ENUM membership, VARCHAR lengths, the password CHECK and every
    foreign key (a NULL key references nothing and is left to NOT NULL).
    Zero rows means zero violations.

    Each table is scanned once: a row gives one entry per broken row rule and
    one per key it holds or refers to.  One aggregate over (place, key),
    combined map-side, then tells duplicates (a key held more than once) and
    orphans (referred to, held by no row) for all tables together; only the
    collated e-mail has an aggregate of its own.  Most keys are met once, so
    entries are small: places are numbers, and a place has one counter for the
    rows that hold a key and one (a slot) for each column that refers to it.
    """
    spec, tables_, entries, rules = _integrity_spec(), t.as_dict(), None, []
    places = {f"{name}.pk": i for i, name in enumerate(spec)}
    slots: dict[int, int] = {}  # place: columns that refer to it so far

    def entry(place: int, k1, k2, slot: int):
        return F.struct(F.lit(place).alias("place"), k1.cast("bigint").alias("k1"),
                        k2.cast("bigint").alias("k2"), F.lit(slot).alias("slot"))

    none = F.lit(None).cast("bigint")
    for name, (row_rules, pk, unique, foreign) in spec.items():
        cells = []
        for rule, broken in row_rules.items():
            place = places.setdefault(f"{name}|{rule}", len(places))
            rules.append((name, rule, "row", place, 0))
            cells.append(F.when(broken, entry(place, none, none, 0)))
        for label, key in (("primary_key", pk), ("unique:event_customer", unique)):
            if key:
                place = places[f"{name}.pk"] if label == "primary_key" else places.setdefault(f"{name}.unique", len(places))
                rules.append((name, label, "dup", place, 0))
                whole = F.col(key[0]).isNotNull()
                for k in key[1:]:
                    whole = whole & F.col(k).isNotNull()
                cells.append(F.when(whole, entry(place, F.col(key[0]),
                                                 F.col(key[1]) if len(key) > 1 else none, 0)))
        for column, parent in foreign.items():
            place = places[f"{parent}.pk"]
            slot = slots[place] = slots.get(place, 0) + 1
            rules.append((name, f"foreign_key:{column}", "orphan", place, slot))
            cells.append(F.when(F.col(column).isNotNull(), entry(place, F.col(column), none, slot)))
        part = tables_[name].select(F.explode(F.array(*cells)).alias("x")).filter("x IS NOT NULL").select("x.*")
        entries = part if entries is None else entries.unionAll(part)
    used = range(1, max(slots.values()) + 1)
    per_key = entries.groupBy("place", "k1", "k2").agg(
        F.count_if(F.col("slot") == 0).alias("held"), *[F.count_if(F.col("slot") == i).alias(f"r{i}") for i in used])
    orphan = F.col("held") == 0
    totals = per_key.groupBy("place").agg(
        F.sum("held").alias("rows"), F.sum(F.greatest(F.col("held") - 1, F.lit(0))).alias("dups"),
        *[F.sum(F.when(orphan, F.col(f"r{i}")).otherwise(0)).alias(f"o{i}") for i in used])
    measures = (totals.select("place", F.explode(F.array(
        F.struct(F.lit("row").alias("kind"), F.lit(0).alias("slot"), F.col("rows").alias("n")),
        F.struct(F.lit("dup").alias("kind"), F.lit(0).alias("slot"), F.col("dups").alias("n")),
        *[F.struct(F.lit("orphan").alias("kind"), F.lit(i).alias("slot"), F.col(f"o{i}").alias("n"))
          for i in used])).alias("m")).select("place", "m.*"))
    spark = t.customers.sparkSession
    listed = spark.createDataFrame(rules, "table_name string, rule string, kind string, place int, slot int")
    report = (listed.join(measures, ["place", "kind", "slot"], "left")
              .select("table_name", "rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations")))
    emails = (_dealt_out(t.customers.filter(F.col("email").isNotNull()).select("email"), "email")
              .groupBy(_email_key("email").alias("ek"))
              .agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
                                                     .cast("bigint").alias("violations"))
              .select(F.lit("customers").alias("table_name"), F.lit("unique:email").alias("rule"), "violations"))
    return report.unionByName(emails)


# ------------------------------------------------------- V11 overbooked events
def overbooked_events(t: Tables) -> DataFrame:
    """Events holding more bookings than their venue's capacity (a venue change
    on edit does not re-check the count)."""
    return (t.events.select("event_id", "venue_id")
            .join(booking_counts(t), "event_id")
            .join(t.venues.select("venue_id", "capacity"), "venue_id")
            .filter(F.col("booking_total") > F.col("capacity"))
            .select("event_id", "venue_id", "capacity",
                    F.col("booking_total").cast("bigint").alias("booking_total"),
                    (F.col("booking_total") - F.col("capacity")).cast("bigint").alias("excess")))
