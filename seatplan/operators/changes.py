"""Write rules as set-based jobs.

Each job takes the current ``Tables`` and a table of command rows and gives
back an outcome per command row plus the new table states.  Rules are the
reference's, in its order; where it serialises requests with row locks, the
jobs reproduce the same sequential answer with per-key minimums, joins and a
range-cut top-n (``seatplan.plans.skew``), so a hot event never lands whole in
one window task.

New ids (AUTO_INCREMENT in the reference) are unique, gappy and
deterministic: ``max(existing id) + (request key - min request key + 1)``.
No global ``row_number`` (which would move every row to one task) is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatplan.functions.text import parse_id_list
from seatplan.operators import validate as V
from seatplan.operators.reports import booking_counts
from seatplan.plans.lineage import materialize
from seatplan.plans.numbering import row_numbers
from seatplan.plans.skew import first_n_per_key, joined_by_parts
from seatplan.sources.tables import Tables

# The messages raised by the booking procedures and shown by
# the pages, and the audit notes written by the triggers.
CREATE_SIGNALS = {
    "MISSING": "That event is no longer available.",
    "PAST": "You can only book upcoming events.",
    "DUPLICATE": "You have already booked this event.",
    "FULL": "This event has reached full capacity.",
}
CANCEL_SIGNALS = {
    "MISSING": "That booking could not be found.",
    "PAST": "Past events can no longer be cancelled.",
}
PAGE_MESSAGES = {
    "INVALID_EVENT": "Please choose a valid event.",
    "BOOKED": "Booking confirmed. See you at the event.",
    "CANCELLED": "Booking cancelled successfully.",
}
KNOWN_MESSAGES = [  # (needle, message): case-blind substring, first match wins
    ("That event is no longer available.", "That event is no longer available."),
    ("You can only book upcoming events.", "You can only book upcoming events."),
    ("You have already booked this event.", "You have already booked this event."),
    ("This event has reached full capacity.", "This event has reached full capacity."),
    ("That booking could not be found.", "That booking could not be found."),
    ("Past events can no longer be cancelled.", "Past events can no longer be cancelled."),
    ("Duplicate entry", "You have already booked this event."),
]
CREATE_FALLBACK = "Unable to complete your booking."
CANCEL_FALLBACK = "Unable to cancel that booking."
NOTE_BOOKED = "Booking recorded through transactional stored procedure"
NOTE_CANCELLED = "Booking cancellation recorded by database trigger"
EVENT_SAVE_FAILED = "Unable to create the event. Please try again."
EVENT_UPDATE_FAILED = "Unable to update the event."
NOT_OWNER_MESSAGE = "You can only edit events that you created."
DELETE_NOT_FOUND = "That event could not be found."
RESOURCE_INVALID = "Please choose a valid resource."
RESOURCE_IN_USE = {
    "venue": "This venue is assigned to existing events and cannot be deleted.",
    "staff": "This staff member is assigned to an event and cannot be deleted.",
    "supplier": "This supplier is linked to an event and cannot be deleted.",
}


@dataclass
class ChangeResult:
    outcomes: DataFrame
    tables: Tables
    audit: DataFrame | None = None


# ------------------------------------------------------------------ helpers
def _scalar(df: DataFrame, expr: Column, default=0):
    """One aggregate value (a single-row action; the job itself stays distributed)."""
    v = df.agg(expr.alias("v")).first()["v"]
    return default if v is None else v


def id_base(existing: DataFrame, id_col: str) -> int:
    return int(_scalar(existing, F.max(id_col), 0))


def with_new_ids(df: DataFrame, accepted: Column, key: str, existing: DataFrame, id_col: str,
                 out: str | None = None) -> DataFrame:
    """``df`` (checkpointed) plus ``out``: accepted rows get the ids after the
    largest one, in ``key`` order and without a gap, as AUTO_INCREMENT gives
    them; other rows get none.  Numbered by ranges, not in one task."""
    out = out or id_col
    kept = materialize(df.withColumn("_take", F.coalesce(accepted, F.lit(False))))
    base = id_base(existing, id_col)
    took = row_numbers(kept.filter("_take"), [key], "_n")
    return (took.withColumn(out, F.lit(base) + F.col("_n")).drop("_n")
            .unionByName(kept.filter("NOT _take").withColumn(out, F.lit(None).cast("bigint"))).drop("_take"))


def _role_gate(df: DataFrame, t: Tables, who: str, role: str) -> DataFrame:
    roles = t.customers.select(F.col("customer_id").alias(who), F.col("role").alias("_role"))
    return df.join(roles, who, "left").withColumn("_role_ok", F.col("_role") == F.lit(role))


def outcome_messages(df: DataFrame, message_col: str, fallback: str,
                     out: str = "user_message") -> DataFrame:
    """Map a database error text to the page's message.

    A fixed seven-entry table, so the lookup is one CASE WHEN chain in the
    projection (first match wins, case-blind substring); no join is needed.
    """
    low = F.lower(F.col(message_col))
    expr = None
    for needle, msg in KNOWN_MESSAGES:
        cond = F.coalesce(low.contains(needle.lower()), F.lit(False))
        expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
    return df.withColumn(out, expr.otherwise(F.lit(fallback)))


def _lookup(mapping: dict, c: Column) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, c)


# ------------------------------------------------------ W08 admit bookings
def admit_bookings(t: Tables, requests: DataFrame, check_role: bool = True) -> DataFrame:
    """Booking requests judged as if run one by one in ``request_id`` order.

    Outcome per row, first match wins: NOT_ALLOWED (requester is not a
    customer), INVALID_EVENT (id <= 0, page check), MISSING (no such event or
    venue), PAST (event_time <= requested_at), DUPLICATE (pair already booked,
    or an earlier request of the pair was admitted), FULL, BOOKED.

    Only the first valid request of each (event, customer) pair that is not
    already booked is a candidate; candidates take the free seats
    (capacity - existing bookings) in request order.  A repeat after a FULL
    is FULL again, since seats never come back within an all-create batch.
    """
    req = requests.select("request_id", "event_id", "customer_id", "requested_at")
    info = (t.events.select("event_id", "event_time", "venue_id")
            .join(t.venues.select("venue_id", "capacity"), "venue_id").drop("venue_id"))
    r = req.join(info, "event_id", "left")
    if check_role:
        r = _role_gate(r, t, "customer_id", "customer")
        # The page acts only for customers, then checks the id.
        gate = F.when(~F.coalesce(F.col("_role_ok"), F.lit(False)), F.lit("NOT_ALLOWED")).when(
            F.coalesce("event_id", F.lit(0)) <= 0, F.lit("INVALID_EVENT"))
    else:
        gate = F.when(F.coalesce("event_id", F.lit(0)) <= 0, F.lit("INVALID_EVENT"))
    # Checkpointed once: the pairs, and the final outcomes read it.
    r = materialize(r.withColumn("_gate", gate)
                    .withColumn("_valid", F.col("_gate").isNull()
                                & F.coalesce(F.col("event_time") > F.col("requested_at"), F.lit(False))))
    # Repeats are collapsed first: what is judged is one row per pair, however often it was submitted.
    pair = ["event_id", "customer_id"]
    held = t.bookings.select(*pair, F.lit(True).alias("held"))
    pairs = materialize(r.filter("_valid").groupBy(*pair)
                        .agg(F.min("request_id").alias("first_req"), F.first("capacity").alias("capacity"))
                        .join(held, pair, "left"))
    cands = (pairs.filter(F.col("held").isNull()).withColumnRenamed("first_req", "request_id")
             .select(*pair, "request_id", "capacity").join(booking_counts(t), "event_id", "left")
             .withColumn("slots", F.greatest(
                 F.col("capacity") - F.coalesce(F.col("booking_total"), F.lit(0)), F.lit(0))))
    winners = first_n_per_key(cands, "event_id", "request_id", "slots", out="won").select(*pair, "won")
    judged = materialize(pairs.drop("capacity").join(winners, pair, "left"))
    # The rows get their pair's outcome by parts, so that a pair with a share of all rows fills no task.
    r = (joined_by_parts(r.filter("_valid"), pair, "request_id", judged)
         .unionByName(r.filter("NOT _valid"), allowMissingColumns=True))
    later = F.col("request_id") > F.col("first_req")
    outcome = (F.when(F.col("_gate").isNotNull(), F.col("_gate"))
               .when(F.col("event_time").isNull(), "MISSING")
               .when(~(F.col("event_time") > F.col("requested_at")), "PAST")
               .when(F.col("held").isNotNull(), "DUPLICATE")
               .when(later & F.col("won").isNotNull(), "DUPLICATE")
               .when(later, "FULL")
               .when(F.col("won").isNotNull(), "BOOKED")
               .otherwise("FULL"))
    out = r.select("request_id", "event_id", "customer_id", "requested_at",
                   outcome.alias("outcome"))
    out = with_new_ids(out, F.col("outcome") == "BOOKED", "request_id", t.bookings, "booking_id")
    return (out.withColumn("booking_date", F.when(F.col("outcome") == "BOOKED",
                                               F.to_date("requested_at")))
            .withColumn("db_message", _lookup(CREATE_SIGNALS, F.col("outcome"))))


def admission_messages(outcomes: DataFrame) -> DataFrame:
    """Page message per create outcome (W11 over the procedure's error text)."""
    df = outcome_messages(outcomes, "db_message", CREATE_FALLBACK)
    return df.withColumn("user_message", F.when(F.col("outcome") == "NOT_ALLOWED", F.lit(None))
                         .when(F.col("db_message").isNull(),
                               _lookup(PAGE_MESSAGES, F.col("outcome")))
                         .otherwise(F.col("user_message")))


def apply_admissions(t: Tables, outcomes: DataFrame) -> ChangeResult:
    """New bookings and their audit rows.  The outcomes are checkpointed once
    (they feed the id scan, the bookings and the audit rows)."""
    outcomes = materialize(outcomes)
    booked = outcomes.filter(F.col("outcome") == "BOOKED")
    new_rows = booked.select("booking_id", "booking_date", "event_id", "customer_id")
    audit = audit_trail(t, admitted=booked)
    return ChangeResult(outcomes, t.with_(bookings=t.bookings.unionByName(new_rows),
                                          booking_audit_log=t.booking_audit_log.unionByName(audit)),
                        audit)


# ------------------------------------------------------ W09 cancel bookings
def cancel_bookings(t: Tables, cancels: DataFrame, check_role: bool = True) -> DataFrame:
    """Cancel requests in ``request_id`` order.

    NOT_ALLOWED (not a customer), MISSING (id <= 0, not the caller's
    booking, no event, or already cancelled earlier in the batch), PAST
    (event_time <= requested_at), CANCELLED.
    """
    c = cancels.select("request_id", "booking_id", "customer_id", "requested_at")
    found = (t.bookings.select("booking_id", "customer_id", "event_id")
             .join(t.events.select("event_id", "event_time"), "event_id"))
    r = c.join(found, ["booking_id", "customer_id"], "left")
    if check_role:
        r = _role_gate(r, t, "customer_id", "customer")
        gate = F.when(~F.coalesce(F.col("_role_ok"), F.lit(False)), F.lit("NOT_ALLOWED")) \
            .when(F.coalesce("booking_id", F.lit(0)) <= 0, F.lit("MISSING"))
    else:
        gate = F.when(F.coalesce("booking_id", F.lit(0)) <= 0, F.lit("MISSING"))
    r = materialize(r.withColumn("_gate", gate).withColumn(
        "_ok", F.col("_gate").isNull() & F.col("event_time").isNotNull()
        & (F.col("event_time") > F.col("requested_at"))))
    first = r.filter("_ok").groupBy("booking_id").agg(F.min("request_id").alias("first_ok"))
    r = r.join(first, "booking_id", "left")
    outcome = (F.when(F.col("_gate").isNotNull(), F.col("_gate"))
               .when(F.col("event_time").isNull(), "MISSING")
               .when(F.col("request_id") > F.col("first_ok"), "MISSING")
               .when(~(F.col("event_time") > F.col("requested_at")), "PAST")
               .otherwise("CANCELLED"))
    return (r.select("request_id", "booking_id", "customer_id", "event_id", "requested_at",
                     outcome.alias("outcome"))
            .withColumn("db_message", _lookup(CANCEL_SIGNALS, F.col("outcome"))))


def cancellation_messages(outcomes: DataFrame) -> DataFrame:
    df = outcome_messages(outcomes, "db_message", CANCEL_FALLBACK)
    return df.withColumn("user_message", F.when(F.col("outcome") == "NOT_ALLOWED", F.lit(None))
                         .when(F.col("db_message").isNull(),
                               _lookup(PAGE_MESSAGES, F.col("outcome")))
                         .otherwise(F.col("user_message")))


def apply_cancellations(t: Tables, outcomes: DataFrame) -> ChangeResult:
    outcomes = materialize(outcomes)
    gone = outcomes.filter(F.col("outcome") == "CANCELLED")
    audit = audit_trail(t, cancelled=gone)
    bookings = t.bookings.join(gone.select("booking_id"), "booking_id", "left_anti")
    return ChangeResult(outcomes, t.with_(bookings=bookings,
                                          booking_audit_log=t.booking_audit_log.unionByName(audit)),
                        audit)


# --------------------------------------------------------- W10 audit trail
def audit_trail(t: Tables, admitted: DataFrame | None = None,
                cancelled: DataFrame | None = None,
                removed: DataFrame | None = None) -> DataFrame:
    """Audit rows the triggers would write: BOOKED per admitted booking,
    CANCELLED per cancelled or cascade-removed booking; action_time is the
    request time.  Ids continue after the log's max id, admissions first, then
    cancellations, then removals, each block ordered by its request key.
    """
    parts = []
    if admitted is not None:
        parts.append((admitted, "request_id", "BOOKED", NOTE_BOOKED))
    if cancelled is not None:
        parts.append((cancelled, "request_id", "CANCELLED", NOTE_CANCELLED))
    if removed is not None:
        parts.append((removed, "booking_id", "CANCELLED", NOTE_CANCELLED))
    base = id_base(t.booking_audit_log, "audit_id")
    out = None
    for df, key, action, note in parts:
        # One id after the other, in request order within a block.
        numbered = row_numbers(df.select(key, "event_id", "customer_id", "requested_at",
                                         *([] if key == "booking_id" else ["booking_id"])), [key], "_n")
        rows = numbered.select(
            (F.lit(base) + F.col("_n")).cast("bigint").alias("audit_id"),
            F.col("booking_id").cast("bigint"), F.col("event_id").cast("bigint"),
            F.col("customer_id").cast("bigint"), F.lit(action).alias("action_type"),
            F.lit(note).alias("action_note"),
            F.col("requested_at").cast("timestamp_ntz").alias("action_time"))
        base += int(_scalar(numbered, F.max("_n"), 0))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return t.booking_audit_log.limit(0)
    return out


# ------------------------------------------------------- W03 delete events
def delete_events(t: Tables, deletes: DataFrame, check_role: bool = True) -> ChangeResult:
    """Owner-only event deletes with the explicit cascade of the page.

    Removes the event, its staff and supplier links and its bookings; each
    removed booking gets a CANCELLED audit row (the page deletes bookings
    one statement at a time, so the delete trigger fires for each).
    Outcomes: NOT_ALLOWED (not an organizer), NOT_FOUND (not the caller's
    event, or deleted earlier in the batch), DELETED.
    """
    d = deletes.select("request_id", "event_id", "customer_id", "requested_at")
    own = t.events.select("event_id", "customer_id", F.lit(True).alias("_own"))
    r = d.join(own, ["event_id", "customer_id"], "left")
    if check_role:
        r = _role_gate(r, t, "customer_id", "organizer")
        r = r.withColumn("_gate", F.when(~F.coalesce(F.col("_role_ok"), F.lit(False)),
                                         F.lit("NOT_ALLOWED")))
    else:
        r = r.withColumn("_gate", F.lit(None).cast("string"))
    ok = F.col("_gate").isNull() & F.col("_own").isNotNull()
    first = r.filter(ok).groupBy("event_id").agg(F.min("request_id").alias("_first"))
    r = r.join(first, "event_id", "left")
    outcome = (F.when(F.col("_gate").isNotNull(), F.col("_gate"))
               .when(F.col("_own").isNull(), "NOT_FOUND")
               .when(F.col("request_id") > F.col("_first"), "NOT_FOUND")
               .otherwise("DELETED"))
    outcomes = r.select("request_id", "event_id", "customer_id", "requested_at",
                        outcome.alias("outcome")) \
        .withColumn("user_message", F.when(F.col("outcome") == "NOT_FOUND",
                                           F.lit(DELETE_NOT_FOUND))
                    .when(F.col("outcome") == "DELETED", F.lit("Event deleted successfully.")))
    # Feeds four anti joins, the audit id scan and the audit rows: compute once.
    outcomes = materialize(outcomes)
    gone = outcomes.filter(F.col("outcome") == "DELETED").select("event_id", "requested_at")
    removed = t.bookings.join(gone, "event_id")
    audit = audit_trail(t, removed=removed)
    keys = gone.select("event_id")
    new = t.with_(
        events=t.events.join(keys, "event_id", "left_anti"),
        bookings=t.bookings.join(keys, "event_id", "left_anti"),
        event_staff=t.event_staff.join(keys, "event_id", "left_anti"),
        event_suppliers=t.event_suppliers.join(keys, "event_id", "left_anti"),
        booking_audit_log=t.booking_audit_log.unionByName(audit))
    return ChangeResult(outcomes, new, audit)


# ------------------------------------------------- W01 / W02 event writes
def _link_rows(v: DataFrame, key: str, arr: str, col: str) -> DataFrame:
    return v.select(key, F.explode(parse_id_list(arr)).alias(col))


def _fk_failures(t: Tables, v: DataFrame, key: str) -> DataFrame:
    """Keys of command rows whose venue, staff or supplier id does not exist."""
    bad_venue = v.select(key, F.col("venue_n").alias("venue_id")) \
        .join(t.venues.select("venue_id"), "venue_id", "left_anti").select(key)
    bad_staff = _link_rows(v, key, "staff_ids", "staff_id") \
        .join(t.staff.select("staff_id"), "staff_id", "left_anti").select(key)
    bad_sup = _link_rows(v, key, "supplier_ids", "supplier_id") \
        .join(t.suppliers.select("supplier_id"), "supplier_id", "left_anti").select(key)
    return bad_venue.unionAll(bad_staff).unionAll(bad_sup).distinct() \
        .withColumn("_fk_bad", F.lit(True))


PAGE_REASONS = ("REQUIRED", "NOT_FUTURE", "BAD_BUDGET")


def insert_events(t: Tables, drafts: DataFrame, as_of, check_role: bool = True) -> ChangeResult:
    """Page checks and trigger checks, then event + links as one unit.

    An unknown venue, staff or supplier id fails the whole event (the
    reference's transaction rolls back), outcome FK_ERROR.
    """
    v = V.validate_events(drafts, as_of)
    if check_role:
        v = _role_gate(v, t, "customer_id", "organizer")
        v = v.withColumn("reason", F.when(~F.coalesce(F.col("_role_ok"), F.lit(False)),
                                          F.lit("NOT_ALLOWED")).otherwise(F.col("reason")))
    v = materialize(v)  # read by the foreign-key checks and by the join-back
    v = v.join(_fk_failures(t, v.filter(F.col("reason").isNull()), "draft_id"), "draft_id", "left")
    v = v.withColumn("reason", F.coalesce(F.col("reason"),
                                          F.when(F.col("_fk_bad"), F.lit("FK_ERROR"))))
    v = with_new_ids(v, F.col("reason").isNull(), "draft_id", t.events, "event_id", out="new_event_id")
    outcomes = v.select(
        "draft_id", "customer_id", "new_event_id",
        F.coalesce(F.col("reason"), F.lit("CREATED")).alias("outcome"),
        F.when(F.col("reason").isNull(), F.lit("Event created successfully."))
         .when(F.col("reason").isin(*PAGE_REASONS), V.message_of(F.col("reason")))
         .when(F.col("reason") == "NOT_ALLOWED", F.lit(None))
         .otherwise(F.lit(EVENT_SAVE_FAILED)).alias("user_message"))
    ok = v.filter(F.col("reason").isNull())
    events = ok.select(F.col("new_event_id").alias("event_id"), "customer_id",
                       F.col("venue_n").alias("venue_id"), F.col("event_name_n").alias("event_name"),
                       F.col("event_ts").alias("event_time"), F.col("budget_n").alias("budget"))
    staff = _link_rows(ok, "new_event_id", "staff_ids", "staff_id").withColumnRenamed(
        "new_event_id", "event_id")
    sup = _link_rows(ok, "new_event_id", "supplier_ids", "supplier_id").withColumnRenamed(
        "new_event_id", "event_id")
    new = t.with_(events=t.events.unionByName(events),
                  event_staff=t.event_staff.unionByName(staff),
                  event_suppliers=t.event_suppliers.unionByName(sup))
    return ChangeResult(outcomes, new)


def update_events(t: Tables, edits: DataFrame, as_of, check_role: bool = True) -> ChangeResult:
    """Owner-only edits; links are replaced; the last accepted edit of an
    event (by ``draft_id``, the request order) is the one that stays."""
    own = t.events.select("event_id", "customer_id", F.lit(True).alias("_own"))
    v = V.validate_events(edits, as_of).join(own, ["event_id", "customer_id"], "left")
    if check_role:
        v = _role_gate(v, t, "customer_id", "organizer")
        role_bad = ~F.coalesce(F.col("_role_ok"), F.lit(False))
    else:
        role_bad = F.lit(False)
    v = materialize(v.withColumn("reason", F.when(role_bad, F.lit("NOT_ALLOWED"))
                                 .when(F.coalesce(F.col("event_id"), F.lit(0)) == 0,
                                       F.lit("NO_EVENT"))
                                 .when(F.col("_own").isNull(), F.lit("NOT_OWNER"))
                                 .otherwise(F.col("reason"))))
    v = v.join(_fk_failures(t, v.filter(F.col("reason").isNull()), "draft_id"), "draft_id", "left")
    v = v.withColumn("reason", F.coalesce(F.col("reason"), F.when(F.col("_fk_bad"), F.lit("FK_ERROR"))))
    outcomes = v.select(
        "draft_id", "event_id", "customer_id",
        F.coalesce(F.col("reason"), F.lit("UPDATED")).alias("outcome"),
        F.when(F.col("reason").isNull(), F.lit("Event updated successfully."))
         .when(F.col("reason").isin(*PAGE_REASONS), V.message_of(F.col("reason")))
         .when(F.col("reason") == "NOT_OWNER", F.lit(NOT_OWNER_MESSAGE))
         .when(F.col("reason") == "NO_EVENT", F.lit("No event was selected."))
         .when(F.col("reason") == "NOT_ALLOWED", F.lit(None))
         .otherwise(F.lit(EVENT_UPDATE_FAILED)).alias("user_message"))
    ok = v.filter(F.col("reason").isNull())
    last = ok.groupBy("event_id").agg(F.max("draft_id").alias("draft_id"))
    final = ok.join(last, ["event_id", "draft_id"], "left_semi")
    upd = final.select("event_id", F.col("venue_n").alias("_venue"),
                       F.col("event_name_n").alias("_name"), F.col("event_ts").alias("_time"),
                       F.col("budget_n").alias("_budget"), "staff_ids", "supplier_ids")
    events = (t.events.join(upd.drop("staff_ids", "supplier_ids"), "event_id", "left")
              .select("event_id", "customer_id",
                      F.coalesce("_venue", "venue_id").alias("venue_id"),
                      F.coalesce("_name", "event_name").alias("event_name"),
                      F.coalesce("_time", "event_time").alias("event_time"),
                      F.coalesce("_budget", "budget").alias("budget")))
    keys = upd.select("event_id")
    staff = t.event_staff.join(keys, "event_id", "left_anti").unionByName(
        _link_rows(upd, "event_id", "staff_ids", "staff_id"))
    sup = t.event_suppliers.join(keys, "event_id", "left_anti").unionByName(
        _link_rows(upd, "event_id", "supplier_ids", "supplier_id"))
    return ChangeResult(outcomes, t.with_(events=events, event_staff=staff,
                                          event_suppliers=sup))


# ------------------------------------------------------ W04 / W05 resources
_KINDS = {
    "venue": ("venues", "venue_id", V.validate_venues,
              ["venue_name", "address", "capacity"]),
    "staff": ("staff", "staff_id", V.validate_staff, ["name", "role", "phone"]),
    "supplier": ("suppliers", "supplier_id", V.validate_suppliers,
                 ["name", "phone", "service_type"]),
}


def insert_resources(t: Tables, kind: str, rows: DataFrame) -> ChangeResult:
    """Validate (V04-V06) and append with new ids."""
    table, key, check, cols = _KINDS[kind]
    v = check(rows)
    v = with_new_ids(v, F.col("reason").isNull(), "request_id", getattr(t, table), key)
    outcomes = v.select("request_id", key, F.coalesce("reason", F.lit("CREATED")).alias("outcome"))
    cur = getattr(t, table)
    new_rows = v.filter(F.col("reason").isNull()).select(key, *cols)
    for c in cur.columns:
        if c not in new_rows.columns:
            new_rows = new_rows.withColumn(c, F.lit(None).cast(cur.schema[c].dataType))
    new_rows = new_rows.select(*[F.col(c).cast(cur.schema[c].dataType) for c in cur.columns])
    return ChangeResult(outcomes, t.with_(**{table: cur.unionByName(new_rows)}))


def delete_resources(t: Tables, deletes: DataFrame) -> ChangeResult:
    """(request_id, kind, id) rows.

    INVALID (id <= 0 or unknown kind), IN_USE (still linked to an event),
    else DELETED (as on the page, also when no such row exists).
    """
    used = (t.events.select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"))
            .unionAll(t.event_staff.select(F.lit("staff").alias("kind"),
                                           F.col("staff_id").alias("id")))
            .unionAll(t.event_suppliers.select(F.lit("supplier").alias("kind"),
                                               F.col("supplier_id").alias("id")))
            .distinct().withColumn("_used", F.lit(True)))
    r = deletes.select("request_id", "kind", "id").join(used, ["kind", "id"], "left")
    outcome = (F.when((F.coalesce(F.col("id"), F.lit(0)) <= 0)
                      | ~F.coalesce(F.col("kind").isin(*_KINDS), F.lit(False)), "INVALID")
               .when(F.col("_used").isNotNull(), "IN_USE").otherwise("DELETED"))
    outcomes = r.select("request_id", "kind", "id", outcome.alias("outcome"))
    outcomes = outcomes.withColumn(
        "user_message", F.when(F.col("outcome") == "INVALID", F.lit(RESOURCE_INVALID))
        .when(F.col("outcome") == "IN_USE", _lookup(RESOURCE_IN_USE, F.col("kind")))
        .otherwise(F.lit("Resource deleted.")))
    gone = outcomes.filter(F.col("outcome") == "DELETED")
    changed = {}
    for kind, (table, key, _, _) in _KINDS.items():
        ids = gone.filter(F.col("kind") == kind).select(F.col("id").alias(key))
        changed[table] = getattr(t, table).join(ids, key, "left_anti")
    return ChangeResult(outcomes, t.with_(**changed))


# ------------------------------------------------------ W06 / W07 accounts
def register_accounts(t: Tables, signups: DataFrame) -> ChangeResult:
    """V07, then append accepted accounts (password arrives hashed)."""
    v = V.validate_signups(t, signups)
    v = with_new_ids(v, F.col("reason").isNull(), "request_id", t.customers, "customer_id")
    outcomes = v.select("request_id", "customer_id", "role",
                        F.coalesce("reason", F.lit("REGISTERED")).alias("outcome"),
                        F.when(F.col("reason").isNull(),
                               F.lit("Registration complete! You can sign in now."))
                         .otherwise(V.message_of(F.col("reason"))).alias("user_message"))
    new_rows = v.filter(F.col("reason").isNull()).select(
        "customer_id", "name", "phone", "email", "password", "role")
    return ChangeResult(outcomes, t.with_(customers=t.customers.unionByName(new_rows)))


def update_profiles(t: Tables, updates: DataFrame) -> ChangeResult:
    """V08, then overwrite name, phone, e-mail (password only if given);
    the last accepted update of a customer is the one that stays."""
    v = V.validate_profile_updates(t, updates)
    outcomes = v.select("request_id", "customer_id",
                        F.coalesce("reason", F.lit("UPDATED")).alias("outcome"),
                        F.when(F.col("reason").isNull(), F.lit("Profile updated successfully."))
                         .otherwise(V.message_of(F.col("reason"))).alias("user_message"))
    ok = v.filter(F.col("reason").isNull())
    last = ok.groupBy("customer_id").agg(F.max("request_id").alias("request_id"))
    final = ok.join(last, ["customer_id", "request_id"], "left_semi").select(
        "customer_id", F.col("name").alias("_name"), F.col("phone").alias("_phone"),
        F.col("email").alias("_email"),
        F.when(F.col("password") != "", F.col("password")).alias("_password"))
    customers = (t.customers.join(final, "customer_id", "left")
                 .select("customer_id", F.coalesce("_name", "name").alias("name"),
                         F.coalesce("_phone", "phone").alias("phone"),
                         F.coalesce("_email", "email").alias("email"),
                         F.coalesce("_password", "password").alias("password"), "role"))
    return ChangeResult(outcomes, t.with_(customers=customers))
