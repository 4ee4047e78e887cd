"""Shared helpers of the booking tests (kept out of conftest, of which there are two)."""

import datetime as dt

from seatplan.sources import schemas
from seatplan.sources.tables import Tables

T = dt.datetime
D = dt.date
SEED_AS_OF = T(2026, 4, 20, 0, 0, 0)


def make_tables(spark, customers=(), venues=(), staff=(), suppliers=(), events=(), bookings=(),
                audit=(), event_staff=(), event_suppliers=()) -> Tables:
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)
    return Tables(
        customers=df(customers, schemas.CUSTOMERS), venues=df(venues, schemas.VENUES),
        staff=df(staff, schemas.STAFF), suppliers=df(suppliers, schemas.SUPPLIERS),
        events=df(events, schemas.EVENTS), bookings=df(bookings, schemas.BOOKINGS),
        booking_audit_log=df(audit, schemas.AUDIT), event_staff=df(event_staff, schemas.EVENT_STAFF),
        event_suppliers=df(event_suppliers, schemas.EVENT_SUPPLIERS))
