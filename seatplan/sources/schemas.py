"""Spark schemas of the nine booking tables and of the command rows.

Ids are ``long``; DATETIME is ``timestamp_ntz`` (no zone is stored);
DECIMAL(12,2) stays ``decimal(12,2)``.
"""

from pyspark.sql import types as T

L, S, I = T.LongType(), T.StringType(), T.IntegerType()
TS, D = T.TimestampNTZType(), T.DateType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CUSTOMERS = _schema(("customer_id", L), ("name", S), ("phone", S), ("email", S),
                    ("password", S), ("role", S))
VENUES = _schema(("venue_id", L), ("venue_name", S), ("address", S), ("capacity", I))
STAFF = _schema(("staff_id", L), ("name", S), ("role", S), ("phone", S))
SUPPLIERS = _schema(("supplier_id", L), ("name", S), ("phone", S), ("service_type", S))
EVENTS = _schema(("event_id", L), ("customer_id", L), ("venue_id", L), ("event_name", S),
                 ("event_time", TS), ("budget", T.DecimalType(12, 2)))
BOOKINGS = _schema(("booking_id", L), ("booking_date", D), ("event_id", L), ("customer_id", L))
AUDIT = _schema(("audit_id", L), ("booking_id", L), ("event_id", L), ("customer_id", L),
                ("action_type", S), ("action_note", S), ("action_time", TS))
EVENT_STAFF = _schema(("event_id", L), ("staff_id", L))
EVENT_SUPPLIERS = _schema(("event_id", L), ("supplier_id", L))

TABLE_SCHEMAS = {
    "customers": CUSTOMERS,
    "venues": VENUES,
    "staff": STAFF,
    "suppliers": SUPPLIERS,
    "events": EVENTS,
    "bookings": BOOKINGS,
    "booking_audit_log": AUDIT,
    "event_staff": EVENT_STAFF,
    "event_suppliers": EVENT_SUPPLIERS,
}

# Command rows (what the web forms would submit), one row per request.
BOOKING_REQUESTS = _schema(("request_id", L), ("event_id", L), ("customer_id", L),
                           ("requested_at", TS))
CANCEL_REQUESTS = _schema(("request_id", L), ("booking_id", L), ("customer_id", L),
                          ("requested_at", TS))
EVENT_DRAFTS = T.StructType(_schema(
    ("draft_id", L), ("customer_id", L), ("venue_id", L), ("event_name", S),
    ("event_time", S), ("budget", T.DoubleType())).fields + [
    T.StructField("staff_ids", T.ArrayType(S), True),
    T.StructField("supplier_ids", T.ArrayType(S), True)])
EVENT_EDITS = T.StructType([T.StructField("event_id", L, True)] + EVENT_DRAFTS.fields)
EVENT_DELETES = _schema(("request_id", L), ("event_id", L), ("customer_id", L),
                        ("requested_at", TS))
SIGNUPS = _schema(("request_id", L), ("name", S), ("phone", S), ("email", S),
                  ("password", S), ("role", S))
PROFILE_UPDATES = _schema(("request_id", L), ("customer_id", L), ("name", S), ("phone", S),
                          ("email", S), ("password", S))
RESOURCE_DELETES = _schema(("request_id", L), ("kind", S), ("id", L))
# Mixed create/cancel stream (T01/W12): a cancel carries the event it targets.
BOOKING_COMMANDS = _schema(("request_id", L), ("kind", S), ("event_id", L),
                           ("customer_id", L), ("booking_id", L), ("requested_at", TS))
