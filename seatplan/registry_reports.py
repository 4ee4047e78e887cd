"""Registered report queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatplan.operators import reports as R
from seatplan.registry import AS_OF_SQL, register, tables, with_bindings
from seatplan.sources import bindings as B

# Counts per event are taken table by table; names come by lookup on the two keys.
CATALOGUE_SQL = """
SELECT event_id, customer_id, event_name, event_time, budget, organizer_name, venue_name, capacity,
       coalesce(booked, 0) AS booking_total, coalesce(staffed, 0) AS staff_total,
       coalesce(supplied, 0) AS supplier_total
FROM events_t
JOIN (SELECT customer_id, name AS organizer_name FROM customers) USING (customer_id)
JOIN (SELECT venue_id, venue_name, capacity FROM venues) USING (venue_id)
LEFT JOIN (SELECT event_id, count(*) AS booked FROM bookings GROUP BY ALL) USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS staffed FROM event_staff GROUP BY ALL) USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS supplied FROM event_suppliers GROUP BY ALL) USING (event_id)
"""
CAT = f"cat AS ({CATALOGUE_SQL})"


@register("event_catalogue", with_bindings(CATALOGUE_SQL))
def q_event_catalogue(spark, sf_dir):
    return R.event_catalogue(tables(spark, sf_dir))


@register("event_state", with_bindings(f"""
SELECT *, NOT (event_time > {AS_OF_SQL}) AS is_past, booking_total >= capacity AS is_full,
       CAST(CASE WHEN capacity > 0 THEN least(100, round(100.0 * booking_total / capacity))
            ELSE 0 END AS BIGINT) AS fill_pct
FROM cat""", extra=CAT))
def q_event_state(spark, sf_dir):
    return R.event_state(tables(spark, sf_dir), B.AS_OF)


@register("fill_rate", with_bindings("""
SELECT e.event_id, COUNT(b.booking_id) AS booking_total, v.capacity,
       CAST(CASE WHEN v.capacity > 0
            THEN least(100, round(100.0 * COUNT(b.booking_id) / v.capacity)) ELSE 0 END AS BIGINT)
         AS fill_pct
FROM events_t e JOIN venues v ON e.venue_id = v.venue_id
LEFT JOIN bookings b ON e.event_id = b.event_id
GROUP BY e.event_id, v.capacity"""))
def q_fill_rate(spark, sf_dir):
    return R.fill_rate(tables(spark, sf_dir))


# The four least (time, id) of the events whose venue and organizer exist, then what is shown of each.
@register("upcoming_events", with_bindings("""
SELECT event_id, event_name, event_time,
       (SELECT venue_name FROM venues v WHERE v.venue_id = e.venue_id) AS venue_name,
       (SELECT name FROM customers c WHERE c.customer_id = e.customer_id) AS organizer_name, budget
FROM events_t e WHERE event_id IN (SELECT unnest(ids) FROM first_four)""", extra=f"""
first_four AS (SELECT arg_min(event_id, {{'t': event_time, 'i': event_id}}, 4) AS ids FROM events_t
               WHERE event_time - {AS_OF_SQL} >= INTERVAL 0 SECOND
                 AND venue_id IN (SELECT venue_id FROM venues) AND customer_id IN (SELECT customer_id FROM customers))"""))
def q_upcoming_events(spark, sf_dir):
    return R.upcoming_events(tables(spark, sf_dir), B.AS_OF, k=4)


@register("dashboard_totals", with_bindings("""
SELECT (SELECT COUNT(*) FROM events_t) AS events, (SELECT COUNT(*) FROM venues) AS venues,
       (SELECT COUNT(*) FROM staff) AS staff, (SELECT COUNT(*) FROM suppliers) AS suppliers"""))
def q_dashboard_totals(spark, sf_dir):
    return R.dashboard_totals(tables(spark, sf_dir))


@register("organizer_summary", with_bindings("""
SELECT c.customer_id,
  (SELECT COUNT(*) FROM events_t e WHERE e.customer_id = c.customer_id) AS events_created,
  (SELECT COUNT(*) FROM bookings b JOIN events_t e ON b.event_id = e.event_id
    WHERE e.customer_id = c.customer_id) AS bookings_received
FROM customers c"""))
def q_organizer_summary(spark, sf_dir):
    return R.organizer_summary(tables(spark, sf_dir))


@register("customer_booking_totals", with_bindings("""
SELECT c.customer_id,
  (SELECT COUNT(*) FROM bookings b WHERE b.customer_id = c.customer_id) AS booking_total
FROM customers c"""))
def q_customer_booking_totals(spark, sf_dir):
    return R.customer_booking_totals(tables(spark, sf_dir))


@register("list_venues", with_bindings("""
SELECT venue_id, venue_name, address, capacity,
       venue_name || ' (Capacity: ' || CAST(capacity AS VARCHAR) || ')' AS label
FROM venues ORDER BY venue_name"""))
def q_list_venues(spark, sf_dir):
    return R.list_venues(tables(spark, sf_dir))


@register("list_staff", with_bindings("""
SELECT staff_id, name, role, phone, name || ' - ' || role AS label FROM staff ORDER BY name"""))
def q_list_staff(spark, sf_dir):
    return R.list_staff(tables(spark, sf_dir))


@register("list_suppliers", with_bindings("""
SELECT supplier_id, name, phone, service_type, name || ' - ' || service_type AS label
FROM suppliers ORDER BY name"""))
def q_list_suppliers(spark, sf_dir):
    return R.list_suppliers(tables(spark, sf_dir))


@register("customer_itinerary", with_bindings("""
SELECT who AS customer_id, booking_id, booking_date, event_id, event_name, event_time, budget, venue_name,
       organizer_name
FROM (SELECT booking_id, booking_date, event_id, customer_id AS who FROM bookings) JOIN cat USING (event_id)""",
    extra=CAT))
def q_customer_itinerary(spark, sf_dir):
    return R.customer_itinerary(tables(spark, sf_dir))


# A roster is the list of an event's bookings, shown to its organizer guest by guest.
@register("attendee_roster", with_bindings("""
SELECT organizer_id, guest.b AS booking_id, guest.d AS booking_date, event_id, event_name, event_time,
       guest.c AS attendee_id, by_id[guest.c].n AS attendee_name, by_id[guest.c].e AS email, by_id[guest.c].p AS phone
FROM (SELECT customer_id AS organizer_id, event_id, event_name, event_time, unnest(guests) AS guest FROM events_t, guest_lists
      WHERE list_event = event_id) r, people
WHERE list_contains(map_keys(by_id), guest.c)""", extra="""
guest_lists AS (SELECT event_id AS list_event, list({'b': booking_id, 'd': booking_date, 'c': customer_id}) AS guests
                FROM bookings GROUP BY event_id),
people AS (SELECT map_from_entries(list({'k': customer_id, 'v': {'n': name, 'e': email, 'p': phone}})) AS by_id FROM customers)"""))
def q_attendee_roster(spark, sf_dir):
    return R.attendee_roster(tables(spark, sf_dir))


def _usage_sql(dim, key, name_col, links):
    return with_bindings(f"""
SELECT d.{key}, d.{name_col},
  (SELECT COUNT(*) FROM {links} l WHERE l.{key} = d.{key}) AS usage_total
FROM {dim} d""")


@register("venue_usage", _usage_sql("venues", "venue_id", "venue_name", "events_t"))
def q_venue_usage(spark, sf_dir):
    return R.venue_usage(tables(spark, sf_dir))


@register("staff_usage", _usage_sql("staff", "staff_id", "name", "event_staff"))
def q_staff_usage(spark, sf_dir):
    return R.staff_usage(tables(spark, sf_dir))


@register("supplier_usage", _usage_sql("suppliers", "supplier_id", "name", "event_suppliers"))
def q_supplier_usage(spark, sf_dir):
    return R.supplier_usage(tables(spark, sf_dir))


def _unassigned_sql(dim, key, links):
    return with_bindings(f"""
SELECT d.* FROM {dim} d
WHERE (SELECT COUNT(*) FROM {links} l WHERE l.{key} = d.{key}) = 0""")


@register("unassigned_venues", _unassigned_sql("venues", "venue_id", "events_t"))
def q_unassigned_venues(spark, sf_dir):
    return R.unassigned_venues(tables(spark, sf_dir))


@register("unassigned_staff", _unassigned_sql("staff", "staff_id", "event_staff"))
def q_unassigned_staff(spark, sf_dir):
    return R.unassigned_staff(tables(spark, sf_dir))


@register("unassigned_suppliers", _unassigned_sql("suppliers", "supplier_id", "event_suppliers"))
def q_unassigned_suppliers(spark, sf_dir):
    return R.unassigned_suppliers(tables(spark, sf_dir))


@register("event_assignments", with_bindings("""
SELECT e.event_id,
  COALESCE((SELECT string_agg(CAST(s.staff_id AS VARCHAR), ',' ORDER BY s.staff_id)
            FROM event_staff s WHERE s.event_id = e.event_id), '') AS staff_ids,
  COALESCE((SELECT string_agg(CAST(p.supplier_id AS VARCHAR), ',' ORDER BY p.supplier_id)
            FROM event_suppliers p WHERE p.event_id = e.event_id), '') AS supplier_ids
FROM events_t e"""))
def q_event_assignments(spark, sf_dir):
    # The arrays are shown as comma-joined text so both engines print them alike.
    df = R.event_assignments(tables(spark, sf_dir))
    return df.select("event_id",
                     *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
                       for c in ("staff_ids", "supplier_ids")])


@register("booking_activity_report", with_bindings("""
SELECT audit_id, action_type, action_time,
       coalesce((SELECT any_value(event_name) FROM events_t e WHERE e.event_id = a.event_id),
                'Archived Event') AS event_name,
       coalesce((SELECT any_value(name) FROM customers c WHERE c.customer_id = a.customer_id),
                'Archived User') AS customer_name, action_note
FROM booking_audit_log a
QUALIFY row_number() OVER (ORDER BY action_time DESC, audit_id DESC) <= 20"""))
def q_booking_activity_report(spark, sf_dir):
    return R.booking_activity_report(tables(spark, sf_dir), k=20)


@register("owned_events", with_bindings("""
SELECT e.* FROM events_t e
WHERE EXISTS (SELECT 1 FROM event_deletes r
              WHERE r.event_id = e.event_id AND r.customer_id = e.customer_id)"""))
def q_owned_events(spark, sf_dir):
    claims = B.bind_event_deletes(spark, sf_dir)
    return R.owned_events(tables(spark, sf_dir), claims)


@register("account_profile", with_bindings("""
SELECT customer_id, name, phone, email, role FROM customers"""))
def q_account_profile(spark, sf_dir):
    return R.account_profile(tables(spark, sf_dir))
