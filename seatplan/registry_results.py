"""Registered table states after the change jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from seatplan.operators import changes as C
from seatplan.operators import reports as R
from seatplan.registry import register, tables, with_bindings
from seatplan.registry_changes import CANCEL_CTES, _event_check_sql
from seatplan.registry_validate import SIGNUP_CTES, TS_SQL, norm
from seatplan.sources import bindings as B
from seatplan.sources.tables import load_tables

INSERT_CTES = f"""
chk AS ({_event_check_sql('event_drafts', 'draft_id')}),
made AS (SELECT *, (SELECT max(event_id) FROM events_t) + row_number() OVER (ORDER BY draft_id) AS new_id
         FROM chk WHERE reason IS NULL)"""
UPDATE_CTES = "chk AS (" + _event_check_sql(
    "event_edits", "draft_id",
    "WHEN coalesce(event_id, 0) = 0 THEN 'NO_EVENT' "
    "WHEN (event_id, customer_id) NOT IN (SELECT (event_id, customer_id) FROM events_t) "
    "THEN 'NOT_OWNER'") + """),
last AS (SELECT * FROM chk WHERE reason IS NULL
         QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY draft_id DESC) = 1)"""


def _insert(spark, sf_dir):
    return C.insert_events(tables(spark, sf_dir), B.bind_event_drafts(spark, sf_dir), B.AS_OF).tables


def _update(spark, sf_dir):
    return C.update_events(tables(spark, sf_dir), B.bind_event_edits(spark, sf_dir), B.AS_OF).tables


def _links(t):
    return (t.event_staff.select(F.lit("staff").alias("kind"), "event_id", F.col("staff_id").alias("id"))
            .unionAll(t.event_suppliers.select(F.lit("supplier"), "event_id", "supplier_id")))


LINKS = """SELECT 'staff' AS kind, event_id, staff_id AS id FROM event_staff {0}
UNION ALL SELECT 'supplier', event_id, supplier_id FROM event_suppliers {0}"""


@register("insert_events_events", with_bindings(
    f"""SELECT * FROM events_t UNION ALL
SELECT new_id, customer_id, venue_id, {norm('event_name')}, {TS_SQL}, CAST(budget AS DECIMAL(12,2))
FROM made""", extra=INSERT_CTES))
def q_insert_events_events(spark, sf_dir):
    return _insert(spark, sf_dir).events


@register("insert_events_links", with_bindings(
    LINKS.format("") + """ UNION ALL SELECT 'staff', new_id, unnest(staff_n) FROM made
UNION ALL SELECT 'supplier', new_id, unnest(supplier_n) FROM made""", extra=INSERT_CTES))
def q_insert_events_links(spark, sf_dir):
    return _links(_insert(spark, sf_dir))


@register("update_events_events", with_bindings(
    f"""SELECT event_id, customer_id, venue_id, event_name, event_time, budget FROM events_t
WHERE event_id NOT IN (SELECT event_id FROM last) UNION ALL
SELECT event_id, customer_id, venue_id, {norm('event_name')}, {TS_SQL}, CAST(budget AS DECIMAL(12,2))
FROM last""", extra=UPDATE_CTES))
def q_update_events_events(spark, sf_dir):
    return _update(spark, sf_dir).events


@register("update_events_links", with_bindings(
    LINKS.format("WHERE event_id NOT IN (SELECT event_id FROM last)")
    + """ UNION ALL SELECT 'staff', event_id, unnest(staff_n) FROM last
UNION ALL SELECT 'supplier', event_id, unnest(supplier_n) FROM last""", extra=UPDATE_CTES))
def q_update_events_links(spark, sf_dir):
    return _links(_update(spark, sf_dir))


_RESOURCE_SQL = """
SELECT request_id, CASE WHEN reason IS NULL THEN (SELECT max({key}) FROM {table})
         + row_number() OVER (PARTITION BY reason IS NULL ORDER BY request_id) END AS {key},
       coalesce(reason, 'CREATED') AS outcome
FROM (SELECT request_id, CASE WHEN {blank} THEN '{code}' WHEN {long} THEN 'TOO_LONG' END AS reason
      FROM (SELECT request_id, {cols} FROM {src}))"""


def _resource_sql(kind, table, key, src, code, limits):
    cols = ", ".join(f"coalesce({norm(c)}, '') AS {c}" for c in limits)
    return with_bindings(_RESOURCE_SQL.format(
        key=key, table=table, src=src, code=code, cols=cols,
        blank=" OR ".join(f"{c} = ''" for c in limits),
        long=" OR ".join(f"length({c}) > {n}" for c, n in limits.items())))


@register("insert_resources_staff", _resource_sql(
    "staff", "staff", "staff_id", "staff_rows", "STAFF_FIELDS", {"name": 100, "role": 100, "phone": 20}))
def q_insert_resources_staff(spark, sf_dir):
    return C.insert_resources(tables(spark, sf_dir), "staff", B.bind_staff_rows(spark, sf_dir)).outcomes


@register("insert_resources_supplier", _resource_sql(
    "supplier", "suppliers", "supplier_id", "supplier_rows", "SUPPLIER_FIELDS",
    {"name": 100, "phone": 20, "service_type": 120}))
def q_insert_resources_supplier(spark, sf_dir):
    return C.insert_resources(tables(spark, sf_dir), "supplier",
                              B.bind_supplier_rows(spark, sf_dir)).outcomes


@register("insert_resources_table", with_bindings(f"""
SELECT * FROM staff UNION ALL
SELECT (SELECT max(staff_id) FROM staff) + row_number() OVER (ORDER BY request_id),
       {norm('name')}, {norm('role')}, {norm('phone')}
FROM staff_rows WHERE {norm('name')} <> '' AND {norm('role')} <> '' AND {norm('phone')} <> ''
  AND length({norm('phone')}) <= 20"""))
def q_insert_resources_table(spark, sf_dir):
    return C.insert_resources(tables(spark, sf_dir), "staff", B.bind_staff_rows(spark, sf_dir)).tables.staff


@register("delete_resources_remaining", with_bindings("""
SELECT 'venue' AS kind, venue_id AS id FROM venues
WHERE venue_id IN (SELECT venue_id FROM events_t) OR ('venue', venue_id) NOT IN (SELECT (kind, id) FROM gone)
UNION ALL SELECT 'staff', staff_id FROM staff
WHERE staff_id IN (SELECT staff_id FROM event_staff) OR ('staff', staff_id) NOT IN (SELECT (kind, id) FROM gone)
UNION ALL SELECT 'supplier', supplier_id FROM suppliers
WHERE supplier_id IN (SELECT supplier_id FROM event_suppliers)
   OR ('supplier', supplier_id) NOT IN (SELECT (kind, id) FROM gone)""",
    extra="gone AS (SELECT kind, id FROM resource_deletes WHERE id > 0)"))
def q_delete_resources_remaining(spark, sf_dir):
    t = C.delete_resources(tables(spark, sf_dir), B.bind_resource_deletes(spark, sf_dir)).tables
    kinds = [("venue", t.venues, "venue_id"), ("staff", t.staff, "staff_id"),
             ("supplier", t.suppliers, "supplier_id")]
    return reduce(lambda a, b: a.unionAll(b),
                  [d.select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, d, c in kinds])


@register("register_accounts_customers", with_bindings("""
SELECT customer_id, name, phone, email, role FROM customers UNION ALL
SELECT (SELECT max(customer_id) FROM customers) + row_number() OVER (ORDER BY request_id), p0.name, p0.phone, p0.email, sv.role
FROM sv JOIN p0 USING (request_id) WHERE sv.reason IS NULL""", extra=SIGNUP_CTES))
def q_register_accounts_customers(spark, sf_dir):
    res = C.register_accounts(tables(spark, sf_dir), B.bind_signups(spark, sf_dir))
    return res.tables.customers.drop("password")


@register("cancel_bookings_remaining", with_bindings("""
SELECT * FROM bookings WHERE booking_id NOT IN (SELECT booking_id FROM can WHERE outcome = 'CANCELLED')""",
    extra=CANCEL_CTES))
def q_cancel_bookings_remaining(spark, sf_dir):
    t = tables(spark, sf_dir)
    return C.apply_cancellations(t, C.cancel_bookings(t, B.bind_cancel_requests(spark, sf_dir))).tables.bookings


@register("assignment_flags", with_bindings("""
SELECT event_id, 'venue' AS kind, venue_id AS id FROM events_t
WHERE event_id IN (SELECT event_id FROM event_edits) AND venue_id IN (SELECT venue_id FROM venues)
UNION SELECT event_id, 'staff', staff_id FROM event_staff
WHERE event_id IN (SELECT event_id FROM event_edits) AND staff_id IN (SELECT staff_id FROM staff)
UNION SELECT event_id, 'supplier', supplier_id FROM event_suppliers
WHERE event_id IN (SELECT event_id FROM event_edits) AND supplier_id IN (SELECT supplier_id FROM suppliers)"""))
def q_assignment_flags(spark, sf_dir):
    """Checked boxes of the edit forms that the edits came from."""
    return R.assignment_flags_of(tables(spark, sf_dir), B.bind_event_edits(spark, sf_dir))


@register("load_tables", with_bindings("""
SELECT 'bookings' AS table_name, booking_id AS id FROM bookings
UNION ALL SELECT 'events', event_id FROM events_t
UNION ALL SELECT 'customers', customer_id FROM customers"""))
def q_load_tables(spark, sf_dir):
    """The tables written as CSV and loaded again by their declared schemas."""
    import uuid

    from seatplan.plans.lineage import scratch_path
    root = scratch_path(spark, f"load-{uuid.uuid4().hex}")
    for name, df in tables(spark, sf_dir).as_dict().items():
        df.write.option("header", "true").csv(f"{root}/{name}")
    t = load_tables(spark, root, fmt="csv")
    return (t.bookings.select(F.lit("bookings").alias("table_name"), F.col("booking_id").alias("id"))
            .unionAll(t.events.select(F.lit("events"), "event_id"))
            .unionAll(t.customers.select(F.lit("customers"), "customer_id")))
