"""Read-side reports.

Where a page binds one id (``WHERE customer_id = ?``) the function computes
the answer for every key at once and takes an optional key filter, which
Catalyst pushes down to the scan.

Counting over the one-to-many sides (bookings, staff links, supplier links)
is done by pre-aggregating each side on ``event_id`` and joining the small
per-event counts, instead of joining all three sides and repairing the
fan-out with COUNT(DISTINCT).  Both give the same numbers while the key
columns are unique (the tables' primary keys); the partial aggregation also
makes a hot event harmless, because each map task combines its rows first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatplan.functions.text import CI_AI, resource_label
from seatplan.sources.tables import Tables


def _ts(as_of) -> Column:
    """A timestamp_ntz clock value.  Built from ISO text, so no session or
    process time zone takes part in the conversion."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _filter_ids(df: DataFrame, col: str, ids) -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.filter(F.col(col).isin(list(ids)))


def count_per(df: DataFrame, key: str, name: str, counted: str | None = None) -> DataFrame:
    """Per-key row count (non-NULL ``counted`` values); map-side combined."""
    c = F.count(F.col(counted)) if counted else F.count(F.lit(1))
    return df.groupBy(key).agg(c.alias(name))


def booking_counts(t: Tables) -> DataFrame:
    return count_per(t.bookings, "event_id", "booking_total", "booking_id")


def event_catalogue(t: Tables) -> DataFrame:
    """Every event with organizer, venue, capacity and booking/staff/supplier totals."""
    per_event = (t.events
                 .join(booking_counts(t), "event_id", "left")
                 .join(count_per(t.event_staff, "event_id", "staff_total", "staff_id"),
                       "event_id", "left")
                 .join(count_per(t.event_suppliers, "event_id", "supplier_total", "supplier_id"),
                       "event_id", "left"))
    venues = t.venues.select("venue_id", "venue_name", "capacity")
    organizers = t.customers.select("customer_id", F.col("name").alias("organizer_name"))
    return (per_event.join(venues, "venue_id").join(organizers, "customer_id")
            .select("event_id", "customer_id", "event_name", "event_time", "budget",
                    "organizer_name", "venue_name", "capacity",
                    F.coalesce("booking_total", F.lit(0)).cast("bigint").alias("booking_total"),
                    F.coalesce("staff_total", F.lit(0)).cast("bigint").alias("staff_total"),
                    F.coalesce("supplier_total", F.lit(0)).cast("bigint").alias("supplier_total")))


def fill_rate_expr(booked: str = "booking_total", capacity: str = "capacity") -> Column:
    """min(100, round-half-up(100 * booked / capacity)), 0 when capacity <= 0.

    Exact integer arithmetic: round(100*b/c) = floor((200*b + c) / (2*c)).
    """
    return F.expr(
        f"CAST(CASE WHEN {capacity} > 0 THEN least(100, "
        f"(200 * CAST({booked} AS BIGINT) + {capacity}) DIV (2 * CAST({capacity} AS BIGINT))) "
        f"ELSE 0 END AS BIGINT)")


def with_event_state(catalogue: DataFrame, as_of) -> DataFrame:
    """Adds is_past (event_time not after as_of), is_full and fill_pct."""
    return (catalogue
            .withColumn("is_past", ~(F.col("event_time") > _ts(as_of)))
            .withColumn("is_full", F.col("booking_total") >= F.col("capacity"))
            .withColumn("fill_pct", fill_rate_expr()))


def event_state(t: Tables, as_of) -> DataFrame:
    return with_event_state(event_catalogue(t), as_of)


def fill_rate(t: Tables) -> DataFrame:
    """(event_id, booking_total, capacity, fill_pct) for every event with a venue."""
    return (t.events.select("event_id", "venue_id")
            .join(booking_counts(t), "event_id", "left")
            .join(t.venues.select("venue_id", "capacity"), "venue_id")
            .select("event_id", F.coalesce("booking_total", F.lit(0)).cast("bigint")
                    .alias("booking_total"), "capacity")
            .withColumn("fill_pct", fill_rate_expr()))


def upcoming_events(t: Tables, as_of, k: int = 4) -> DataFrame:
    """First k events at or after as_of, ties broken by event_id.

    Events without their venue or organizer are left out before the top-k
    (semi joins on the keys alone), so orphans never shorten the list; then
    TakeOrderedAndProject keeps k rows per task, and only those k rows meet
    the wide columns of venues and organizers.
    """
    top = (t.events.filter(F.col("event_time") >= _ts(as_of))
           .join(t.venues.select("venue_id"), "venue_id", "left_semi")
           .join(t.customers.select("customer_id"), "customer_id", "left_semi")
           .orderBy("event_time", "event_id").limit(k))
    return (top.join(t.venues.select("venue_id", "venue_name"), "venue_id")
            .join(t.customers.select("customer_id", F.col("name").alias("organizer_name")),
                  "customer_id")
            .select("event_id", "event_name", "event_time", "venue_name", "organizer_name", "budget")
            .orderBy("event_time", "event_id"))


def dashboard_totals(t: Tables) -> DataFrame:
    """One row: events, venues, staff, suppliers.  One scan each, one tiny final agg."""
    tagged = (t.events.select(F.lit(0).alias("k"))
              .unionAll(t.venues.select(F.lit(1).alias("k")))
              .unionAll(t.staff.select(F.lit(2).alias("k")))
              .unionAll(t.suppliers.select(F.lit(3).alias("k"))))
    return tagged.agg(*[F.count_if(F.col("k") == i).cast("bigint").alias(n) for i, n in
                        enumerate(["events", "venues", "staff", "suppliers"])])


def organizer_summary(t: Tables, customer_ids=None) -> DataFrame:
    """Per customer: events created and bookings received on them (zeros kept)."""
    per_org = (t.events.select("event_id", "customer_id")
               .join(booking_counts(t), "event_id", "left")
               .groupBy("customer_id")
               .agg(F.count(F.lit(1)).alias("events_created"),
                    F.sum(F.coalesce("booking_total", F.lit(0))).alias("bookings_received")))
    return (_filter_ids(t.customers, "customer_id", customer_ids).select("customer_id")
            .join(per_org, "customer_id", "left")
            .select("customer_id",
                    F.coalesce("events_created", F.lit(0)).cast("bigint").alias("events_created"),
                    F.coalesce("bookings_received", F.lit(0)).cast("bigint")
                    .alias("bookings_received")))


def customer_booking_totals(t: Tables, customer_ids=None) -> DataFrame:
    per = count_per(t.bookings, "customer_id", "booking_total", "booking_id")
    return (_filter_ids(t.customers, "customer_id", customer_ids).select("customer_id")
            .join(per, "customer_id", "left")
            .select("customer_id",
                    F.coalesce("booking_total", F.lit(0)).cast("bigint").alias("booking_total")))


def _by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.orderBy(F.collate(F.col(name), CI_AI), key)


def list_venues(t: Tables) -> DataFrame:
    return _by_name(t.venues.withColumn("label", resource_label("venue")), "venue_name", "venue_id")


def list_staff(t: Tables) -> DataFrame:
    return _by_name(t.staff.withColumn("label", resource_label("staff")), "name", "staff_id")


def list_suppliers(t: Tables) -> DataFrame:
    return _by_name(t.suppliers.withColumn("label", resource_label("supplier")), "name",
                    "supplier_id")


def customer_itinerary(t: Tables, customer_ids=None, ordered: bool | None = None) -> DataFrame:
    """Each booker's bookings with event, venue and organizer.

    A page sorts one person's rows by event time: ``ordered`` (by default where
    ``customer_ids`` are given) sorts each customer's rows inside a partition
    (no global sort over all customers).
    """
    ordered = customer_ids is not None if ordered is None else ordered
    b = _filter_ids(t.bookings, "customer_id", customer_ids)
    ev = t.events.select("event_id", F.col("customer_id").alias("organizer_id"), "venue_id",
                         "event_name", "event_time", "budget")
    rows = (b.join(ev, "event_id")
            .join(t.venues.select("venue_id", "venue_name"), "venue_id")
            .join(t.customers.select(F.col("customer_id").alias("organizer_id"),
                                     F.col("name").alias("organizer_name")), "organizer_id")
            .select("customer_id", "booking_id", "booking_date", "event_id", "event_name",
                    "event_time", "budget", "venue_name", "organizer_name"))
    return _within_key(rows, "customer_id", "event_time", "booking_id") if ordered else rows


def _within_key(rows: DataFrame, key: str, *order) -> DataFrame:
    """Rows of one key together and in order, keys in no order."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def attendee_roster(t: Tables, organizer_ids=None, ordered: bool | None = None) -> DataFrame:
    """Each organizer's bookings with the attendee's name, e-mail and phone.

    ``ordered`` (by default where ``organizer_ids`` are given) sorts each organizer's
    rows by event time and name inside a partition.
    """
    ordered = organizer_ids is not None if ordered is None else ordered
    ev = _filter_ids(t.events.select(F.col("customer_id").alias("organizer_id"), "event_id",
                                     "event_name", "event_time"), "organizer_id", organizer_ids)
    att = t.customers.select(F.col("customer_id").alias("attendee_id"),
                             F.col("name").alias("attendee_name"), "email", "phone")
    rows = (t.bookings.select("booking_id", "booking_date", "event_id",
                              F.col("customer_id").alias("attendee_id"))
            .join(ev, "event_id").join(att, "attendee_id")
            .select("organizer_id", "booking_id", "booking_date", "event_id", "event_name",
                    "event_time", "attendee_id", "attendee_name", "email", "phone"))
    if not ordered:
        return rows
    return _within_key(rows, "organizer_id", "event_time",
                       F.collate(F.col("attendee_name"), CI_AI), "booking_id")


def venue_usage(t: Tables) -> DataFrame:
    return (t.venues.select("venue_id", "venue_name")
            .join(count_per(t.events, "venue_id", "usage_total"), "venue_id", "left")
            .select("venue_id", "venue_name",
                    F.coalesce("usage_total", F.lit(0)).cast("bigint").alias("usage_total")))


def staff_usage(t: Tables) -> DataFrame:
    return (t.staff.select("staff_id", "name")
            .join(count_per(t.event_staff, "staff_id", "usage_total"), "staff_id", "left")
            .select("staff_id", "name",
                    F.coalesce("usage_total", F.lit(0)).cast("bigint").alias("usage_total")))


def supplier_usage(t: Tables) -> DataFrame:
    return (t.suppliers.select("supplier_id", "name")
            .join(count_per(t.event_suppliers, "supplier_id", "usage_total"), "supplier_id", "left")
            .select("supplier_id", "name",
                    F.coalesce("usage_total", F.lit(0)).cast("bigint").alias("usage_total")))


def _unused(dim: DataFrame, links: DataFrame, key: str) -> DataFrame:
    # De-duplicate the link side first (map-side), so the anti join moves one
    # row per used key instead of every link row.
    return dim.join(links.select(key).distinct(), key, "left_anti")


def unassigned_venues(t: Tables) -> DataFrame:
    return _unused(t.venues, t.events, "venue_id")


def unassigned_staff(t: Tables) -> DataFrame:
    return _unused(t.staff, t.event_staff, "staff_id")


def unassigned_suppliers(t: Tables) -> DataFrame:
    return _unused(t.suppliers, t.event_suppliers, "supplier_id")


def event_assignments(t: Tables) -> DataFrame:
    """Per event, its sorted staff ids and supplier ids (empty arrays when none).

    Each array is bounded by the size of the staff / supplier table, since a
    link is unique per (event, resource).
    """
    st = t.event_staff.groupBy("event_id").agg(
        F.array_sort(F.collect_set("staff_id")).alias("staff_ids"))
    sp = t.event_suppliers.groupBy("event_id").agg(
        F.array_sort(F.collect_set("supplier_id")).alias("supplier_ids"))
    empty = F.array().cast("array<bigint>")
    return (t.events.select("event_id").join(st, "event_id", "left").join(sp, "event_id", "left")
            .select("event_id", F.coalesce("staff_ids", empty).alias("staff_ids"),
                    F.coalesce("supplier_ids", empty).alias("supplier_ids")))


def assignment_flags_of(t: Tables, events: DataFrame) -> DataFrame:
    """The checked boxes of the edit forms of many events: (event_id, kind, id).

    ``events`` (event_id) names the forms.  Equi-joins with the links: one row
    per link of a chosen event, no product of events and resources; every
    resource without a row is unchecked.
    """
    e = events.select("event_id").distinct()
    v = t.events.select("event_id", F.lit("venue").alias("kind"), F.col("venue_id").alias("id"))
    s = t.event_staff.select("event_id", F.lit("staff").alias("kind"), F.col("staff_id").alias("id"))
    p = t.event_suppliers.select("event_id", F.lit("supplier").alias("kind"),
                                 F.col("supplier_id").alias("id"))
    known = (t.venues.select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"))
             .unionAll(t.staff.select(F.lit("staff").alias("kind"), F.col("staff_id").alias("id")))
             .unionAll(t.suppliers.select(F.lit("supplier").alias("kind"),
                                          F.col("supplier_id").alias("id"))))
    return (v.unionAll(s).unionAll(p).join(e, "event_id", "left_semi")
            .join(known, ["kind", "id"], "left_semi").select("event_id", "kind", "id").distinct())


def assignment_flags(t: Tables, event_id: int) -> DataFrame:
    """The edit form of one event: every resource with checked true/false.

    (kind, id, label, checked).  Equi-joins against the one event's links,
    so no resource x event product is formed.
    """
    ev = t.events.filter(F.col("event_id") == F.lit(event_id))
    v = (t.venues.join(ev.select("venue_id", F.lit(True).alias("hit")), "venue_id", "left")
         .select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"),
                 resource_label("venue").alias("label"), F.col("hit").isNotNull().alias("checked")))
    s = (t.staff.join(t.event_staff.filter(F.col("event_id") == F.lit(event_id))
                      .select("staff_id", F.lit(True).alias("hit")), "staff_id", "left")
         .select(F.lit("staff").alias("kind"), F.col("staff_id").alias("id"),
                 resource_label("staff").alias("label"), F.col("hit").isNotNull().alias("checked")))
    p = (t.suppliers.join(t.event_suppliers.filter(F.col("event_id") == F.lit(event_id))
                          .select("supplier_id", F.lit(True).alias("hit")), "supplier_id", "left")
         .select(F.lit("supplier").alias("kind"), F.col("supplier_id").alias("id"),
                 resource_label("supplier").alias("label"),
                 F.col("hit").isNotNull().alias("checked")))
    return v.unionByName(s).unionByName(p)


def booking_activity_report(t: Tables, k: int = 20) -> DataFrame:
    """Latest k audit rows with event and customer names (Archived ... when gone).

    The top-k is taken on the audit log alone and only k rows are joined:
    both joins are LEFT joins on primary keys, so they neither drop nor
    duplicate audit rows and the k rows are the same as join-then-limit.
    """
    top = t.booking_audit_log.orderBy(F.col("action_time").desc(), F.col("audit_id").desc()).limit(k)
    return (top.join(t.events.select("event_id", "event_name"), "event_id", "left")
            .join(t.customers.select("customer_id", F.col("name").alias("customer_name")),
                  "customer_id", "left")
            .select("audit_id", "action_type", "action_time",
                    F.coalesce("event_name", F.lit("Archived Event")).alias("event_name"),
                    F.coalesce("customer_name", F.lit("Archived User")).alias("customer_name"),
                    "action_note")
            .orderBy(F.col("action_time").desc(), F.col("audit_id").desc()))


def owned_events(t: Tables, claims: DataFrame) -> DataFrame:
    """Events whose (event_id, customer_id) appears in ``claims``: owner checks in bulk."""
    return t.events.join(claims.select("event_id", "customer_id"),
                         ["event_id", "customer_id"], "left_semi")


def account_profile(t: Tables, customer_ids=None) -> DataFrame:
    """Customer rows without the password column."""
    return _filter_ids(t.customers, "customer_id", customer_ids).drop("password")
