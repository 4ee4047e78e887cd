"""Registered validation queries with their oracle SQL."""

from __future__ import annotations

from seatplan.functions import text as X
from seatplan.operators import validate as V
from seatplan.registry import AS_OF_SQL, recursive, register, tables, with_bindings
from seatplan.sources import bindings as B

WS = "'[ \\t\\n\\x0B\\f\\r]+'"


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, {WS}, ' ', 'g'))"


def email_ok(c: str) -> str:
    """Addresses are cut at the last @, domains into labels, address literals into groups."""
    def q(pattern):
        return pattern.replace("'", "''")
    domain = f"split_part({c}, '@', -1)"
    local = f"left({c}, greatest(length({c}) - length({domain}) - 1, 0))"
    inner = f"substr({domain}, 2, length({domain}) - 2)"
    six = f"string_split(substr({inner}, 6), ':')"
    hexes = f"list_filter({six}, lambda g: regexp_full_match(g, '{X.HEX4}'))"
    gaps = f"(length(substr({inner}, 6)) - length(replace(substr({inner}, 6), '::', ''))) // 2"
    v4_tail = f"CASE WHEN regexp_full_match({six}[-1], '{X.IPV4}') THEN 1 ELSE 0 END"
    # groups that are neither empty, nor hexadecimal, nor a last IPv4 address; a lone colon at either end
    odd = (f"len(list_filter({six}, lambda g: g <> '')) - len({hexes}) - {v4_tail} > 0 OR "
           f"contains(substr({inner}, 6), ':::') OR (regexp_matches(substr({inner}, 6), '^:[^:]') OR regexp_matches({inner}, '[^:]:$'))")
    literal = f"""(regexp_full_match({inner}, '{X.IPV4}') OR lower(left({inner}, 5)) = 'ipv6:' AND NOT ({odd}) AND
      CASE {gaps} WHEN 0 THEN len({hexes}) + 2 * {v4_tail} = 8 WHEN 1 THEN len({hexes}) + 2 * {v4_tail} <= 6 ELSE false END)"""
    labels = f"string_split({domain}, '.')"
    named = f"""(len({labels}) >= 2 AND regexp_matches({labels}[-1], '^[A-Za-z]')
      AND len(list_filter({labels}, lambda l: length(l) <= 63 AND regexp_full_match(l, '{X.EMAIL_LABEL}'))) = len({labels}))"""

    def units(x):
        return f"length(replace(regexp_replace({x}, '\\\\.', 'x', 'g'), '\"', ''))"
    return f"""coalesce(regexp_matches({local}, '{q(X.EMAIL_LOCAL)}')
    AND CASE WHEN left({domain}, 1) = '[' THEN right({domain}, 1) = ']' AND {literal} ELSE {named} END
    AND {units(local)} <= 64 AND {units(c)} <= 254 AND strlen({c}) <= 320, false)"""


def status(reason: str = "reason") -> str:
    return f"CASE WHEN {reason} IS NULL THEN 'accepted' ELSE 'rejected' END AS status"


FORMS = ["%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d"]
TS_SQL = "coalesce(" + ", ".join(f"try_strptime(trim(event_time), '{f}')" for f in FORMS) + ")"


_VALIDATE_EVENTS_SQL = with_bindings(f"""
SELECT draft_id, reason, {status()} FROM (
  SELECT draft_id, CASE
    WHEN name_n = '' OR coalesce(event_time, '') = '' OR coalesce(venue_id, 0) = 0 THEN 'REQUIRED'
    WHEN ts IS NULL OR NOT (ts > {AS_OF_SQL}) THEN 'NOT_FUTURE'
    WHEN coalesce(budget, 0) <= 0 THEN 'BAD_BUDGET'
    WHEN CAST(budget AS DECIMAL(12,2)) <= 0 THEN 'BUDGET_NOT_POSITIVE'
    WHEN length(name_n) > 150 THEN 'TOO_LONG' END AS reason
  FROM (SELECT *, coalesce({norm('event_name')}, '') AS name_n, {TS_SQL} AS ts FROM event_drafts) d) r""")


@register("validate_events", _VALIDATE_EVENTS_SQL)
def q_validate_events(spark, sf_dir):
    v = V.validate_events(B.bind_event_drafts(spark, sf_dir), B.AS_OF)
    return v.select("draft_id", "reason", "status")


@register("validate_venues", with_bindings(f"""
SELECT request_id, venue_name, address, capacity, reason, {status()} FROM (
  SELECT *, CASE WHEN venue_name = '' OR address = '' OR capacity <= 0 THEN 'VENUE_FIELDS'
                 WHEN length(venue_name) > 120 OR length(address) > 255 THEN 'TOO_LONG'
                 WHEN capacity IS NULL THEN 'CAPACITY_OUT_OF_RANGE' END AS reason
  FROM (SELECT request_id, coalesce({norm('venue_name')}, '') AS venue_name,
               coalesce({norm('address')}, '') AS address,
               TRY_CAST(coalesce(nullif(regexp_extract(trim(capacity), '^[+-]?[0-9]+', 0), ''), '0')
                        AS INT) AS capacity
        FROM venue_rows) d) r"""))
def q_validate_venues(spark, sf_dir):
    return V.validate_venues(B.bind_venue_rows(spark, sf_dir))


@register("validate_staff", with_bindings(f"""
SELECT request_id, name, role, phone, reason, {status()} FROM (
  SELECT *, CASE WHEN name = '' OR role = '' OR phone = '' THEN 'STAFF_FIELDS'
                 WHEN length(name) > 100 OR length(role) > 100 OR length(phone) > 20 THEN 'TOO_LONG'
            END AS reason
  FROM (SELECT request_id, coalesce({norm('name')}, '') AS name, coalesce({norm('role')}, '') AS role,
               coalesce({norm('phone')}, '') AS phone FROM staff_rows) d) r"""))
def q_validate_staff(spark, sf_dir):
    return V.validate_staff(B.bind_staff_rows(spark, sf_dir))


@register("validate_suppliers", with_bindings(f"""
SELECT request_id, name, phone, service_type, reason, {status()} FROM (
  SELECT *, CASE WHEN name = '' OR phone = '' OR service_type = '' THEN 'SUPPLIER_FIELDS'
                 WHEN length(name) > 100 OR length(phone) > 20 OR length(service_type) > 120
                   THEN 'TOO_LONG' END AS reason
  FROM (SELECT request_id, coalesce({norm('name')}, '') AS name,
               coalesce({norm('phone')}, '') AS phone,
               coalesce({norm('service_type')}, '') AS service_type FROM supplier_rows) d) r"""))
def q_validate_suppliers(spark, sf_dir):
    return V.validate_suppliers(B.bind_supplier_rows(spark, sf_dir))


def _person_cte(src: str, extra_cols: str = "") -> str:
    return f"""p0 AS (SELECT request_id{extra_cols},
    coalesce({norm('name')}, '') AS name, coalesce({norm('phone')}, '') AS phone,
    coalesce({norm('email')}, '') AS email, coalesce(password, '') AS password FROM {src})"""


SIGNUP_CTES = _person_cte(
    "signups", ", CASE WHEN role IN ('customer', 'organizer') THEN role ELSE 'customer' END AS role"
) + f""",
p AS (SELECT *, CASE WHEN name = '' OR phone = '' THEN 'NAME_PHONE'
                     WHEN NOT {email_ok('email')} THEN 'BAD_EMAIL'
                     WHEN strlen(password) < 6 THEN 'SHORT_PASSWORD' END AS pre,
             length(name) > 100 OR length(phone) > 20 OR length(email) > 120 AS long,
             lower(strip_accents(rtrim(email))) AS ek FROM p0),
sv AS (SELECT request_id, role, CASE
    WHEN pre IS NOT NULL THEN pre
    WHEN EXISTS (SELECT 1 FROM customers c WHERE lower(strip_accents(rtrim(c.email))) = p.ek)
      THEN 'EMAIL_TAKEN'
    WHEN EXISTS (SELECT 1 FROM p p2 WHERE p2.pre IS NULL AND p2.ek = p.ek AND NOT p2.long
                 AND p2.request_id < p.request_id) THEN 'EMAIL_TAKEN'
    WHEN long THEN 'REGISTRATION_FAILED' END AS reason
  FROM p)"""

def profile_ctes(src: str) -> str:
    """Profile edits one after the other: a recursive step per request, whose
    state is the e-mail key of every account that has changed its own."""
    return _person_cte(src, ", customer_id") + f""",
p AS (SELECT *, CASE WHEN name = '' OR phone = '' THEN 'PROFILE_NAME_PHONE'
                     WHEN NOT {email_ok('email')} THEN 'BAD_EMAIL'
                     WHEN password <> '' AND strlen(password) < 6 THEN 'PROFILE_SHORT_PASSWORD'
                END AS pre,
             length(name) > 100 OR length(phone) > 20 OR length(email) > 120 AS long,
             lower(strip_accents(rtrim(email))) AS ek FROM p0),
h AS (SELECT customer_id, lower(strip_accents(rtrim(email))) AS ek FROM customers),
q AS MATERIALIZED (SELECT p.*, row_number() OVER (ORDER BY request_id) AS n, coalesce(f.ids, []) AS at_first,
             p.customer_id IN (SELECT customer_id FROM h) AS known
      FROM p LEFT JOIN (SELECT ek, list(customer_id) AS ids FROM h GROUP BY ek) f USING (ek) WHERE pre IS NULL),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, MAP(CAST([] AS BIGINT[]), CAST([] AS VARCHAR[])) AS moved,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS granted
  UNION ALL
  SELECT n, CASE WHEN ok AND known AND NOT long THEN map_concat(moved, MAP([customer_id], [ek])) ELSE moved END, request_id, ok
  FROM (SELECT q.*, s.moved,
               len(list_filter(at_first, lambda c: c <> q.customer_id AND coalesce(s.moved[c], q.ek) = q.ek)) = 0
               AND len(list_filter(map_entries(s.moved), lambda x: x.value = q.ek AND x.key <> q.customer_id)) = 0 AS ok
        FROM step s JOIN q ON q.n = s.n + 1) x),
pv AS (SELECT p.request_id, p.customer_id, CASE
    WHEN pre IS NOT NULL THEN pre
    WHEN NOT granted THEN 'PROFILE_EMAIL_TAKEN'
    WHEN long THEN 'PROFILE_FAILED' END AS reason
  FROM p LEFT JOIN step ON step.request_id = p.request_id)"""


PROFILE_CTES = profile_ctes("profile_updates")


@register("validate_signups", with_bindings(
    f"SELECT request_id, role, reason, {status()} FROM sv", extra=SIGNUP_CTES))
def q_validate_signups(spark, sf_dir):
    v = V.validate_signups(tables(spark, sf_dir), B.bind_signups(spark, sf_dir))
    return v.select("request_id", "role", "reason", "status")


@register("validate_profile_updates", recursive(with_bindings(
    f"SELECT request_id, customer_id, reason, {status()} FROM pv", extra=PROFILE_CTES)))
def q_validate_profile_updates(spark, sf_dir):
    v = V.validate_profile_updates(tables(spark, sf_dir), B.bind_profile_updates(spark, sf_dir))
    return v.select("request_id", "customer_id", "reason", "status")


# Oracle for V09, written rule by rule as plain SQL counts.
def _dup(t, keys, rule):
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return (f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) "
            f"AS violations FROM (SELECT count(*) AS n FROM {{src}} WHERE {nn} GROUP BY {k} "
            f"HAVING count(*) > 1)")


def _cnt(t, rule, where):
    return (f"SELECT '{t}' AS table_name, '{rule}' AS rule, "
            f"CAST(count(*) FILTER (WHERE {where}) AS BIGINT) AS violations FROM {{src}}")


def _orph(t, key, parent, pkey, rule):
    return (f"SELECT '{t}' AS table_name, '{rule}' AS rule, CAST(count(*) AS BIGINT) AS violations "
            f"FROM {{src}} x WHERE x.{key} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{pkey} = x.{key})")


def _integrity_sql() -> str:
    spec = {
        ("customers", "customers"): [
            _dup("customers", ["customer_id"], "primary_key"),
            "SELECT 'customers' AS table_name, 'unique:email' AS rule, "
            "CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n "
            "FROM customers WHERE email IS NOT NULL GROUP BY lower(strip_accents(rtrim(email))) "
            "HAVING count(*) > 1)",
            *[_cnt("customers", f"not_null:{c}", f"{c} IS NULL")
              for c in ("customer_id", "name", "phone", "email", "password", "role")],
            _cnt("customers", "enum:role", "role NOT IN ('customer', 'organizer')"),
            _cnt("customers", "check:password_length", "length(password) < 6"),
            *[_cnt("customers", f"max_length:{c}", f"length({c}) > {n}")
              for c, n in (("name", 100), ("phone", 20), ("email", 120), ("password", 255))]],
        ("venues", "venues"): [
            _dup("venues", ["venue_id"], "primary_key"),
            *[_cnt("venues", f"not_null:{c}", f"{c} IS NULL")
              for c in ("venue_id", "venue_name", "address", "capacity")],
            _cnt("venues", "max_length:venue_name", "length(venue_name) > 120"),
            _cnt("venues", "max_length:address", "length(address) > 255")],
        ("staff", "staff"): [
            _dup("staff", ["staff_id"], "primary_key"),
            *[_cnt("staff", f"not_null:{c}", f"{c} IS NULL")
              for c in ("staff_id", "name", "role", "phone")],
            *[_cnt("staff", f"max_length:{c}", f"length({c}) > {n}")
              for c, n in (("name", 100), ("role", 100), ("phone", 20))]],
        ("suppliers", "suppliers"): [
            _dup("suppliers", ["supplier_id"], "primary_key"),
            *[_cnt("suppliers", f"not_null:{c}", f"{c} IS NULL")
              for c in ("supplier_id", "name", "phone", "service_type")],
            *[_cnt("suppliers", f"max_length:{c}", f"length({c}) > {n}")
              for c, n in (("name", 100), ("phone", 20), ("service_type", 120))]],
        ("events", "events_t"): [
            _dup("events", ["event_id"], "primary_key"),
            *[_cnt("events", f"not_null:{c}", f"{c} IS NULL")
              for c in ("event_id", "customer_id", "venue_id", "event_name", "event_time",
                        "budget")],
            _cnt("events", "max_length:event_name", "length(event_name) > 150"),
            _orph("events", "customer_id", "customers", "customer_id", "foreign_key:customer_id"),
            _orph("events", "venue_id", "venues", "venue_id", "foreign_key:venue_id")],
        ("bookings", "bookings"): [
            _dup("bookings", ["booking_id"], "primary_key"),
            _dup("bookings", ["event_id", "customer_id"], "unique:event_customer"),
            *[_cnt("bookings", f"not_null:{c}", f"{c} IS NULL")
              for c in ("booking_id", "booking_date", "event_id", "customer_id")],
            _orph("bookings", "event_id", "events_t", "event_id", "foreign_key:event_id"),
            _orph("bookings", "customer_id", "customers", "customer_id",
                  "foreign_key:customer_id")],
        ("booking_audit_log", "booking_audit_log"): [
            _dup("booking_audit_log", ["audit_id"], "primary_key"),
            *[_cnt("booking_audit_log", f"not_null:{c}", f"{c} IS NULL")
              for c in ("audit_id", "event_id", "customer_id", "action_type", "action_note",
                        "action_time")],
            _cnt("booking_audit_log", "enum:action_type",
                 "action_type NOT IN ('BOOKED', 'CANCELLED')"),
            _cnt("booking_audit_log", "max_length:action_note", "length(action_note) > 255")],
        ("event_staff", "event_staff"): [
            _dup("event_staff", ["event_id", "staff_id"], "primary_key"),
            *[_cnt("event_staff", f"not_null:{c}", f"{c} IS NULL") for c in ("event_id", "staff_id")],
            _orph("event_staff", "event_id", "events_t", "event_id", "foreign_key:event_id"),
            _orph("event_staff", "staff_id", "staff", "staff_id", "foreign_key:staff_id")],
        ("event_suppliers", "event_suppliers"): [
            _dup("event_suppliers", ["event_id", "supplier_id"], "primary_key"),
            *[_cnt("event_suppliers", f"not_null:{c}", f"{c} IS NULL")
              for c in ("event_id", "supplier_id")],
            _orph("event_suppliers", "event_id", "events_t", "event_id", "foreign_key:event_id"),
            _orph("event_suppliers", "supplier_id", "suppliers", "supplier_id",
                  "foreign_key:supplier_id")],
    }
    parts = [q.format(src=src) for (_, src), qs in spec.items() for q in qs]
    return with_bindings("\nUNION ALL\n".join(parts))


@register("integrity_report", _integrity_sql())
def q_integrity_report(spark, sf_dir):
    return V.integrity_report(tables(spark, sf_dir))


@register("overbooked_events", with_bindings("""
SELECT e.event_id, e.venue_id, v.capacity, COUNT(*) AS booking_total,
       COUNT(*) - v.capacity AS excess
FROM events_t e JOIN venues v ON e.venue_id = v.venue_id
JOIN bookings b ON b.event_id = e.event_id
GROUP BY e.event_id, e.venue_id, v.capacity
HAVING COUNT(*) > v.capacity"""))
def q_overbooked_events(spark, sf_dir):
    return V.overbooked_events(tables(spark, sf_dir))


ID_RX = "^[ \\t\\n\\r\\x0B\\f]*([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)"


@register("parse_id_list", f"""
WITH lists AS (
  SELECT c_custkey AS request_id,
         string_split(concat_ws(',', c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR),
                                CAST(c_nationkey AS VARCHAR), ' 12abc'), ',') AS arr
  FROM customer),
items AS (SELECT request_id, unnest(arr) AS v, unnest(generate_series(1, len(arr))) AS i FROM lists),
parsed AS (SELECT request_id, i, regexp_extract(v, '{ID_RX}', 1) AS lead FROM items),
vals AS (SELECT request_id, i, coalesce(
           CASE WHEN regexp_matches(lead, '^[+-]?[0-9]+$') THEN TRY_CAST(lead AS BIGINT)
                ELSE CAST(trunc(TRY_CAST(lead AS DOUBLE)) AS BIGINT) END, 0) AS val FROM parsed),
firsts AS (SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY request_id, val ORDER BY i) = 1)
SELECT request_id, string_agg(CAST(val AS VARCHAR), ',' ORDER BY i) AS ids FROM firsts
GROUP BY request_id""")
def q_parse_id_list(spark, sf_dir):
    """V10 over form id arrays: PHP int casts, de-duplicated, first-seen order."""
    from pyspark.sql import functions as F
    from seatplan.functions.text import parse_id_list
    lists = B.bind_id_lists(spark, sf_dir)
    return lists.select("request_id", F.array_join(
        F.transform(parse_id_list("staff_ids"), lambda x: x.cast("string")), ",").alias("ids"))
