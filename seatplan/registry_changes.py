"""Registered change jobs with window-function oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatplan.operators import changes as C
from seatplan.registry import AS_OF_SQL, recursive, register, tables, with_bindings
from seatplan.registry_validate import PROFILE_CTES, SIGNUP_CTES, TS_SQL, norm, profile_ctes
from seatplan.sources import bindings as B


def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} END"


ADMIT_CTES = f"""
r0 AS (SELECT q.request_id, q.event_id, q.customer_id, q.requested_at, i.event_time, i.capacity,
         cu.role,
         EXISTS (SELECT 1 FROM bookings b WHERE b.event_id = q.event_id
                 AND b.customer_id = q.customer_id) AS held,
         (SELECT COUNT(*) FROM bookings b WHERE b.event_id = q.event_id) AS existing
       FROM booking_requests q
       LEFT JOIN (SELECT e.event_id, e.event_time, v.capacity FROM events_t e
                  JOIN venues v ON e.venue_id = v.venue_id) i ON i.event_id = q.event_id
       LEFT JOIN customers cu ON cu.customer_id = q.customer_id),
r1 AS (SELECT *, CASE WHEN role IS DISTINCT FROM 'customer' THEN 'NOT_ALLOWED'
                      WHEN coalesce(event_id, 0) <= 0 THEN 'INVALID_EVENT' END AS gate FROM r0),
r2 AS (SELECT *, gate IS NULL AND event_time IS NOT NULL AND event_time > requested_at AS valid
       FROM r1),
r3 AS (SELECT *, valid AND row_number() OVER (PARTITION BY event_id, customer_id, valid
                                              ORDER BY request_id) = 1 AS first_valid FROM r2),
r4 AS (SELECT *, SUM(CASE WHEN first_valid AND NOT held THEN 1 ELSE 0 END)
                   OVER (PARTITION BY event_id ORDER BY request_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pos FROM r3),
r5 AS (SELECT *, first_valid AND NOT held AND existing + pos <= capacity AS win FROM r4),
r6 AS (SELECT *, coalesce(MAX(CASE WHEN win THEN 1 ELSE 0 END)
                   OVER (PARTITION BY event_id, customer_id ORDER BY request_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS won_before
       FROM r5),
adm0 AS (SELECT request_id, event_id, customer_id, requested_at,
         CASE WHEN gate IS NOT NULL THEN gate WHEN event_time IS NULL THEN 'MISSING'
              WHEN NOT (event_time > requested_at) THEN 'PAST' WHEN held THEN 'DUPLICATE'
              WHEN won_before THEN 'DUPLICATE' WHEN win THEN 'BOOKED' ELSE 'FULL' END AS outcome
         FROM r6),
adm AS (SELECT *,
        CASE WHEN outcome = 'BOOKED' THEN (SELECT coalesce(MAX(booking_id), 0) FROM bookings)
             + row_number() OVER (PARTITION BY outcome = 'BOOKED' ORDER BY request_id) END
          AS booking_id,
        CASE WHEN outcome = 'BOOKED' THEN CAST(requested_at AS DATE) END AS booking_date,
        {_case_map('outcome', C.CREATE_SIGNALS)} AS db_message
        FROM adm0)"""

CANCEL_CTES = f"""
c0 AS (SELECT q.request_id, q.booking_id, q.customer_id, q.requested_at, f.event_id, f.event_time,
         cu.role
       FROM cancel_requests q
       LEFT JOIN (SELECT b.booking_id, b.customer_id, b.event_id, e.event_time FROM bookings b
                  JOIN events_t e ON b.event_id = e.event_id) f
         ON f.booking_id = q.booking_id AND f.customer_id = q.customer_id
       LEFT JOIN customers cu ON cu.customer_id = q.customer_id),
c1 AS (SELECT *, CASE WHEN role IS DISTINCT FROM 'customer' THEN 'NOT_ALLOWED'
                      WHEN booking_id <= 0 THEN 'MISSING' END AS gate FROM c0),
c2 AS (SELECT *, gate IS NULL AND event_time IS NOT NULL AND event_time > requested_at AS ok
       FROM c1),
c3 AS (SELECT *, MIN(CASE WHEN ok THEN request_id END) OVER (PARTITION BY booking_id) AS first_ok
       FROM c2),
can AS (SELECT request_id, booking_id, customer_id, event_id, requested_at, outcome,
        {_case_map('outcome', C.CANCEL_SIGNALS)} AS db_message FROM (
          SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN event_time IS NULL THEN 'MISSING'
                         WHEN request_id > first_ok THEN 'MISSING'
                         WHEN NOT (event_time > requested_at) THEN 'PAST'
                         ELSE 'CANCELLED' END AS outcome FROM c3) x)"""


@register("admit_bookings", with_bindings("SELECT * FROM adm", extra=ADMIT_CTES))
def q_admit_bookings(spark, sf_dir):
    return C.admit_bookings(tables(spark, sf_dir), B.bind_booking_requests(spark, sf_dir))


@register("cancel_bookings", with_bindings("SELECT * FROM can", extra=CANCEL_CTES))
def q_cancel_bookings(spark, sf_dir):
    return C.cancel_bookings(tables(spark, sf_dir), B.bind_cancel_requests(spark, sf_dir))


def _messages_sql(src: str, fallback: str, page: dict) -> str:
    whens = " ".join(f"WHEN db_message ILIKE '%{n}%' THEN '{m}'" for n, m in C.KNOWN_MESSAGES)
    return f"""SELECT request_id, outcome, db_message,
  CASE WHEN outcome = 'NOT_ALLOWED' THEN NULL
       WHEN db_message IS NULL THEN {_case_map('outcome', page)}
       ELSE CASE {whens} ELSE '{fallback}' END END AS user_message
FROM {src}"""


@register("outcome_messages", with_bindings(
    _messages_sql("adm", C.CREATE_FALLBACK, C.PAGE_MESSAGES), extra=ADMIT_CTES))
def q_outcome_messages(spark, sf_dir):
    out = C.admit_bookings(tables(spark, sf_dir), B.bind_booking_requests(spark, sf_dir))
    return C.admission_messages(out).select("request_id", "outcome", "db_message", "user_message")


@register("cancel_messages", with_bindings(
    _messages_sql("can", C.CANCEL_FALLBACK, C.PAGE_MESSAGES), extra=CANCEL_CTES))
def q_cancel_messages(spark, sf_dir):
    out = C.cancel_bookings(tables(spark, sf_dir), B.bind_cancel_requests(spark, sf_dir))
    return C.cancellation_messages(out).select("request_id", "outcome", "db_message",
                                               "user_message")


AUDIT_SQL = f"""
SELECT (SELECT coalesce(MAX(audit_id), 0) FROM booking_audit_log)
         + row_number() OVER (ORDER BY cancelled, request_id) AS audit_id, booking_id, event_id, customer_id,
       CASE WHEN cancelled THEN 'CANCELLED' ELSE 'BOOKED' END AS action_type,
       CASE WHEN cancelled THEN '{C.NOTE_CANCELLED}' ELSE '{C.NOTE_BOOKED}' END AS action_note,
       requested_at AS action_time
FROM (SELECT request_id, booking_id, event_id, customer_id, requested_at, false AS cancelled FROM adm WHERE outcome = 'BOOKED'
      UNION ALL
      SELECT request_id, booking_id, event_id, customer_id, requested_at, true FROM can WHERE outcome = 'CANCELLED') x"""
AUDIT_CTES = ADMIT_CTES + "," + CANCEL_CTES


@register("audit_trail", with_bindings(AUDIT_SQL, extra=AUDIT_CTES))
def q_audit_trail(spark, sf_dir):
    t = tables(spark, sf_dir)
    adm = C.admit_bookings(t, B.bind_booking_requests(spark, sf_dir))
    can = C.cancel_bookings(t, B.bind_cancel_requests(spark, sf_dir))
    return C.audit_trail(t, admitted=adm.filter(F.col("outcome") == "BOOKED"),
                         cancelled=can.filter(F.col("outcome") == "CANCELLED"))


DELETE_CTES = f"""
d0 AS (SELECT d.request_id, d.event_id, d.customer_id, d.requested_at, cu.role,
         EXISTS (SELECT 1 FROM events_t e WHERE e.event_id = d.event_id
                 AND e.customer_id = d.customer_id) AS own
       FROM event_deletes d LEFT JOIN customers cu ON cu.customer_id = d.customer_id),
d1 AS (SELECT *, CASE WHEN role IS DISTINCT FROM 'organizer' THEN 'NOT_ALLOWED' END AS gate
       FROM d0),
d2 AS (SELECT *, MIN(CASE WHEN gate IS NULL AND own THEN request_id END)
                   OVER (PARTITION BY event_id) AS first_ok FROM d1),
del AS (SELECT request_id, event_id, customer_id, requested_at, outcome,
        CASE WHEN outcome = 'NOT_FOUND' THEN '{C.DELETE_NOT_FOUND}'
             WHEN outcome = 'DELETED' THEN 'Event deleted successfully.' END AS user_message
        FROM (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN NOT own THEN 'NOT_FOUND'
                             WHEN request_id > first_ok THEN 'NOT_FOUND' ELSE 'DELETED' END
                          AS outcome FROM d2) x)"""


@register("delete_events", with_bindings("SELECT * FROM del", extra=DELETE_CTES))
def q_delete_events(spark, sf_dir):
    return C.delete_events(tables(spark, sf_dir), B.bind_event_deletes(spark, sf_dir)).outcomes


@register("delete_events_audit", with_bindings(f"""
SELECT (SELECT coalesce(MAX(audit_id), 0) FROM booking_audit_log) + row_number() OVER (ORDER BY b.booking_id) AS audit_id,
       b.booking_id, b.event_id, b.customer_id, 'CANCELLED' AS action_type,
       '{C.NOTE_CANCELLED}' AS action_note, d.requested_at AS action_time
FROM bookings b JOIN (SELECT * FROM del WHERE outcome = 'DELETED') d ON b.event_id = d.event_id""",
    extra=DELETE_CTES))
def q_delete_events_audit(spark, sf_dir):
    return C.delete_events(tables(spark, sf_dir), B.bind_event_deletes(spark, sf_dir)).audit


@register("delete_events_remaining", with_bindings("""
SELECT (SELECT COUNT(*) FROM events_t WHERE event_id NOT IN
          (SELECT event_id FROM del WHERE outcome = 'DELETED')) AS events,
       (SELECT COUNT(*) FROM bookings WHERE event_id NOT IN
          (SELECT event_id FROM del WHERE outcome = 'DELETED')) AS bookings,
       (SELECT COUNT(*) FROM event_staff WHERE event_id NOT IN
          (SELECT event_id FROM del WHERE outcome = 'DELETED')) AS event_staff,
       (SELECT COUNT(*) FROM event_suppliers WHERE event_id NOT IN
          (SELECT event_id FROM del WHERE outcome = 'DELETED')) AS event_suppliers""",
    extra=DELETE_CTES))
def q_delete_events_remaining(spark, sf_dir):
    """Row counts of the four tables the cascade rewrites, after the deletes."""
    t2 = C.delete_events(tables(spark, sf_dir), B.bind_event_deletes(spark, sf_dir)).tables
    k = F.col("k")
    u = (t2.events.select(F.lit(0).alias("k")).unionAll(t2.bookings.select(F.lit(1).alias("k")))
         .unionAll(t2.event_staff.select(F.lit(2).alias("k")))
         .unionAll(t2.event_suppliers.select(F.lit(3).alias("k"))))
    return u.agg(*[F.count_if(k == i).cast("bigint").alias(n) for i, n in
                   enumerate(["events", "bookings", "event_staff", "event_suppliers"])])


def _id_list(c: str) -> str:
    return (f"list_distinct([coalesce(TRY_CAST(regexp_extract(i, '^[+-]?[0-9]+') AS BIGINT), 0) "
            f"FOR i IN coalesce({c}, [])])")


def _event_check_sql(src: str, key: str, extra_gate: str = "") -> str:
    return f"""
SELECT *, CASE
    WHEN role IS DISTINCT FROM 'organizer' THEN 'NOT_ALLOWED' {extra_gate}
    WHEN name_n = '' OR coalesce(event_time, '') = '' OR coalesce(venue_id, 0) = 0 THEN 'REQUIRED'
    WHEN ts IS NULL OR NOT (ts > {AS_OF_SQL}) THEN 'NOT_FUTURE'
    WHEN coalesce(budget, 0) <= 0 THEN 'BAD_BUDGET'
    WHEN CAST(budget AS DECIMAL(12,2)) <= 0 THEN 'BUDGET_NOT_POSITIVE'
    WHEN length(name_n) > 150 THEN 'TOO_LONG'
    WHEN NOT EXISTS (SELECT 1 FROM venues v WHERE v.venue_id = d.venue_id) THEN 'FK_ERROR'
    WHEN (SELECT count(*) FROM (SELECT unnest(staff_n) AS i) WHERE i NOT IN (SELECT staff_id FROM staff)) > 0
      OR (SELECT count(*) FROM (SELECT unnest(supplier_n) AS i)
          WHERE i NOT IN (SELECT supplier_id FROM suppliers)) > 0 THEN 'FK_ERROR'
  END AS reason
FROM (SELECT x.*, {_id_list('x.staff_ids')} AS staff_n, {_id_list('x.supplier_ids')} AS supplier_n, coalesce({norm('x.event_name')}, '') AS name_n, {TS_SQL.replace('event_time', 'x.event_time')}
             AS ts, cu.role
      FROM {src} x LEFT JOIN customers cu ON cu.customer_id = x.customer_id) d"""


def _user_msg(ok_text: str, failed: str, extra: str = "") -> str:
    return f"""CASE WHEN reason IS NULL THEN '{ok_text}'
       WHEN reason = 'REQUIRED' THEN 'Please fill in all required fields.'
       WHEN reason = 'NOT_FUTURE' THEN 'Please choose a future date and time for the event.'
       WHEN reason = 'BAD_BUDGET' THEN 'Please enter a valid event budget.' {extra}
       WHEN reason = 'NOT_ALLOWED' THEN NULL ELSE '{failed}' END"""


@register("insert_events", with_bindings(f"""
SELECT draft_id, customer_id,
  CASE WHEN reason IS NULL THEN (SELECT coalesce(MAX(event_id), 0) FROM events_t)
       + row_number() OVER (PARTITION BY reason IS NULL ORDER BY draft_id) END AS new_event_id,
  coalesce(reason, 'CREATED') AS outcome,
  {_user_msg('Event created successfully.', C.EVENT_SAVE_FAILED)} AS user_message
FROM chk""", extra=f"chk AS ({_event_check_sql('event_drafts', 'draft_id')})"))
def q_insert_events(spark, sf_dir):
    return C.insert_events(tables(spark, sf_dir), B.bind_event_drafts(spark, sf_dir),
                           B.AS_OF).outcomes


@register("update_events", with_bindings(f"""
SELECT draft_id, event_id, customer_id, coalesce(reason, 'UPDATED') AS outcome,
  {_user_msg('Event updated successfully.', C.EVENT_UPDATE_FAILED,
             "WHEN reason = 'NOT_OWNER' THEN '" + C.NOT_OWNER_MESSAGE + "' "
             "WHEN reason = 'NO_EVENT' THEN 'No event was selected.'")} AS user_message
FROM chk""", extra="chk AS (" + _event_check_sql(
    "event_edits", "draft_id",
    "WHEN coalesce(event_id, 0) = 0 THEN 'NO_EVENT' "
    "WHEN NOT EXISTS (SELECT 1 FROM events_t e WHERE e.event_id = d.event_id "
    "AND e.customer_id = d.customer_id) THEN 'NOT_OWNER'") + ")"))
def q_update_events(spark, sf_dir):
    return C.update_events(tables(spark, sf_dir), B.bind_event_edits(spark, sf_dir),
                           B.AS_OF).outcomes


@register("delete_resources", with_bindings("""
SELECT request_id, kind, id, outcome,
  CASE WHEN outcome = 'INVALID' THEN 'Please choose a valid resource.'
       WHEN outcome = 'IN_USE' THEN CASE kind
         WHEN 'venue' THEN 'This venue is assigned to existing events and cannot be deleted.'
         WHEN 'staff' THEN 'This staff member is assigned to an event and cannot be deleted.'
         ELSE 'This supplier is linked to an event and cannot be deleted.' END
       ELSE 'Resource deleted.' END AS user_message
FROM (SELECT r.*, CASE
  WHEN coalesce(id, 0) <= 0 OR kind NOT IN ('venue', 'staff', 'supplier') THEN 'INVALID'
  WHEN kind = 'venue' AND (SELECT COUNT(*) FROM events_t e WHERE e.venue_id = r.id) > 0 THEN 'IN_USE'
  WHEN kind = 'staff' AND (SELECT COUNT(*) FROM event_staff s WHERE s.staff_id = r.id) > 0
    THEN 'IN_USE'
  WHEN kind = 'supplier' AND (SELECT COUNT(*) FROM event_suppliers s WHERE s.supplier_id = r.id) > 0
    THEN 'IN_USE'
  ELSE 'DELETED' END AS outcome FROM resource_deletes r) x"""))
def q_delete_resources(spark, sf_dir):
    return C.delete_resources(tables(spark, sf_dir), B.bind_resource_deletes(spark, sf_dir)).outcomes


@register("insert_resources", with_bindings(f"""
SELECT request_id,
  CASE WHEN reason IS NULL THEN (SELECT coalesce(MAX(venue_id), 0) FROM venues)
       + row_number() OVER (PARTITION BY reason IS NULL ORDER BY request_id) END AS venue_id,
  coalesce(reason, 'CREATED') AS outcome
FROM (SELECT *, CASE WHEN venue_name = '' OR address = '' OR capacity <= 0 THEN 'VENUE_FIELDS'
                 WHEN length(venue_name) > 120 OR length(address) > 255 THEN 'TOO_LONG'
                 WHEN capacity IS NULL THEN 'CAPACITY_OUT_OF_RANGE' END AS reason
  FROM (SELECT request_id, coalesce({norm('venue_name')}, '') AS venue_name,
               coalesce({norm('address')}, '') AS address,
               TRY_CAST(coalesce(nullif(regexp_extract(trim(capacity), '^[+-]?[0-9]+', 0), ''), '0')
                        AS INT) AS capacity FROM venue_rows) d) r"""))
def q_insert_resources(spark, sf_dir):
    return C.insert_resources(tables(spark, sf_dir), "venue",
                              B.bind_venue_rows(spark, sf_dir)).outcomes


def _reason_msg(mapping_keys):
    from seatplan.operators.validate import MESSAGES
    return "CASE " + " ".join(f"WHEN reason = '{k}' THEN '{MESSAGES[k]}'" for k in mapping_keys) + " END"


@register("register_accounts", with_bindings(f"""
SELECT request_id,
  CASE WHEN reason IS NULL THEN (SELECT coalesce(MAX(customer_id), 0) FROM customers)
       + row_number() OVER (PARTITION BY reason IS NULL ORDER BY request_id) END AS customer_id,
  role, coalesce(reason, 'REGISTERED') AS outcome,
  CASE WHEN reason IS NULL THEN 'Registration complete! You can sign in now.'
       ELSE {_reason_msg(['NAME_PHONE', 'BAD_EMAIL', 'SHORT_PASSWORD', 'EMAIL_TAKEN', 'REGISTRATION_FAILED'])} END
    AS user_message
FROM sv""", extra=SIGNUP_CTES))
def q_register_accounts(spark, sf_dir):
    return C.register_accounts(tables(spark, sf_dir), B.bind_signups(spark, sf_dir)).outcomes


def _profile_outcomes_sql(ctes: str) -> str:
    return recursive(with_bindings(f"""
SELECT request_id, customer_id, coalesce(reason, 'UPDATED') AS outcome,
  CASE WHEN reason IS NULL THEN 'Profile updated successfully.'
       ELSE {_reason_msg(['PROFILE_NAME_PHONE', 'BAD_EMAIL', 'PROFILE_SHORT_PASSWORD',
                          'PROFILE_EMAIL_TAKEN', 'PROFILE_FAILED'])} END AS user_message
FROM pv""", extra=ctes))


def _profile_result_sql(ctes: str) -> str:
    return recursive(with_bindings("""
SELECT c.customer_id, coalesce(u.name, c.name) AS name, coalesce(u.phone, c.phone) AS phone,
       coalesce(u.email, c.email) AS email, c.role
FROM customers c LEFT JOIN (
  SELECT p0.customer_id, p0.name, p0.phone, p0.email FROM p0 JOIN pv USING (request_id)
  WHERE pv.reason IS NULL
  QUALIFY row_number() OVER (PARTITION BY p0.customer_id ORDER BY p0.request_id DESC) = 1) u
ON u.customer_id = c.customer_id""", extra=ctes))


@register("update_profiles", _profile_outcomes_sql(PROFILE_CTES))
def q_update_profiles(spark, sf_dir):
    return C.update_profiles(tables(spark, sf_dir), B.bind_profile_updates(spark, sf_dir)).outcomes


@register("update_profiles_result", _profile_result_sql(PROFILE_CTES))
def q_update_profiles_result(spark, sf_dir):
    """The customers table after the profile edits (password column left out)."""
    res = C.update_profiles(tables(spark, sf_dir), B.bind_profile_updates(spark, sf_dir))
    return res.tables.customers.drop("password")


@register("update_profiles_released", _profile_outcomes_sql(profile_ctes("profile_moves")))
def q_update_profiles_released(spark, sf_dir):
    """Edits of which many wait for the e-mail that another one gives up."""
    return C.update_profiles(tables(spark, sf_dir), B.bind_profile_moves(spark, sf_dir)).outcomes


@register("update_profiles_released_result", _profile_result_sql(profile_ctes("profile_moves")))
def q_update_profiles_released_result(spark, sf_dir):
    res = C.update_profiles(tables(spark, sf_dir), B.bind_profile_moves(spark, sf_dir))
    return res.tables.customers.drop("password")


# The ordered fold as a recursive step over each event's commands: the state is
# the customers (and ids) of bookings made so far and the customers of earlier
# bookings cancelled so far.
REPLAY_CTES = """
k0 AS (SELECT c.request_id, c.kind, c.customer_id, c.booking_id, c.requested_at,
         CASE WHEN c.kind = 'cancel' THEN coalesce(b.event_id, c.event_id) ELSE c.event_id END AS event_id
       FROM booking_commands c LEFT JOIN bookings b ON b.booking_id = c.booking_id),
k1 AS (SELECT k0.*, i.event_time, i.capacity, coalesce(n.n, 0) AS existing, h.booking_id AS old_id,
         (SELECT max(booking_id) FROM bookings) + k0.request_id + 1 AS new_id,
         CASE WHEN cu.role IS DISTINCT FROM 'customer' THEN 'NOT_ALLOWED'
              WHEN kind = 'create' AND coalesce(k0.event_id, 0) <= 0 THEN 'INVALID_EVENT'
              WHEN kind = 'cancel' AND coalesce(k0.booking_id, 0) <= 0 THEN 'MISSING'
              WHEN i.event_time IS NULL THEN 'MISSING'
              WHEN kind = 'create' AND i.event_time <= k0.requested_at THEN 'PAST' END AS settled
       FROM k0 LEFT JOIN (SELECT event_id, event_time, capacity FROM events_t JOIN venues USING (venue_id)) i
              USING (event_id)
            LEFT JOIN (SELECT event_id, count(*) AS n FROM bookings GROUP BY event_id) n USING (event_id)
            LEFT JOIN bookings h ON h.event_id = k0.event_id AND h.customer_id = k0.customer_id
            LEFT JOIN customers cu ON cu.customer_id = k0.customer_id),
live AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY request_id) AS step
         FROM k1 WHERE settled IS NULL),
fold(event_id, step, added, ids, gone, request_id, outcome, made) AS (
  SELECT DISTINCT event_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], NULL::BIGINT, ''::VARCHAR,
         NULL::BIGINT FROM live
  UNION ALL
  SELECT event_id, step,
         CASE WHEN outcome = 'BOOKED' THEN list_append(added, customer_id)
              WHEN mine AND outcome = 'CANCELLED' THEN [x FOR x IN added IF x <> customer_id] ELSE added END,
         CASE WHEN outcome = 'BOOKED' THEN list_append(ids, new_id)
              WHEN mine AND outcome = 'CANCELLED' THEN [x FOR x IN ids IF x <> booking_id] ELSE ids END,
         CASE WHEN NOT mine AND outcome = 'CANCELLED' THEN list_append(gone, customer_id) ELSE gone END,
         request_id, outcome,
         CASE outcome WHEN 'BOOKED' THEN new_id WHEN 'CANCELLED' THEN booking_id END
  FROM (SELECT *, CASE
          WHEN kind = 'create' AND ((old_id IS NOT NULL AND NOT list_contains(gone, customer_id))
                                    OR list_contains(added, customer_id)) THEN 'DUPLICATE'
          WHEN kind = 'create' AND (capacity IS NULL OR existing + len(added) - len(gone) >= capacity)
            THEN 'FULL'
          WHEN kind = 'create' THEN 'BOOKED'
          WHEN NOT mine AND NOT coalesce(old_id = booking_id AND NOT list_contains(gone, customer_id), false)
            THEN 'MISSING'
          WHEN event_time <= requested_at THEN 'PAST' ELSE 'CANCELLED' END AS outcome
        FROM (SELECT l.*, f.added, f.ids, f.gone,
                coalesce(list_position(f.ids, l.booking_id) = list_position(f.added, l.customer_id), false) AS mine
              FROM fold f JOIN live l ON l.event_id = f.event_id AND l.step = f.step + 1) a) b),
replayed AS (
  SELECT request_id, event_id, customer_id, kind, requested_at, settled AS outcome,
         NULL::BIGINT AS booking_id FROM k1 WHERE settled IS NOT NULL
  UNION ALL
  SELECT l.request_id, l.event_id, l.customer_id, l.kind, l.requested_at, f.outcome, f.made
  FROM live l JOIN fold f ON f.event_id = l.event_id AND f.request_id = l.request_id)"""


def replay_sql(body: str) -> str:
    return recursive(with_bindings(body, extra=REPLAY_CTES))


@register("replay_commands", replay_sql("SELECT * FROM replayed"))
def q_replay_commands(spark, sf_dir):
    """Mixed creates and cancels folded per event in request order."""
    from seatplan.operators.replay import replay_commands
    return replay_commands(tables(spark, sf_dir), B.bind_booking_commands(spark, sf_dir))


@register("catalogue_after_admissions", with_bindings("""
SELECT e.event_id, COUNT(DISTINCT b.booking_id) AS booking_total
FROM events_t e
JOIN customers c ON e.customer_id = c.customer_id
JOIN venues v ON e.venue_id = v.venue_id
LEFT JOIN (SELECT booking_id, event_id FROM bookings
           UNION ALL SELECT booking_id, event_id FROM adm WHERE outcome = 'BOOKED') b
  ON e.event_id = b.event_id
GROUP BY e.event_id""", extra=ADMIT_CTES))
def q_catalogue_after_admissions(spark, sf_dir):
    """W08 applied, published as a new snapshot version, read back, catalogued."""
    import uuid

    from seatplan.plans.lineage import scratch_path
    from seatplan.sources.snapshot import publish, read_snapshot, write_snapshot
    t = tables(spark, sf_dir)
    res = C.apply_admissions(t, C.admit_bookings(t, B.bind_booking_requests(spark, sf_dir)))
    root = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    write_snapshot(spark, t.as_dict(), root, 1)
    publish(spark, res.tables, root, 2, changed=["bookings", "booking_audit_log"])
    from seatplan.operators import reports as R
    return R.event_catalogue(read_snapshot(spark, root)).select("event_id", "booking_total")
