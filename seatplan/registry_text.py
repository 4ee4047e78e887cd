"""Registered text, search and per-viewer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seatplan.functions import text as X
from seatplan.functions.dates import strtotime
from seatplan.operators import reports as R
from seatplan.operators import search as S
from seatplan.registry import AS_OF_SQL, register, tables, with_bindings
from seatplan.registry_validate import email_ok
from seatplan.sources import bindings as B


def _search_sql(pattern: str) -> str:
    """Which names match is settled per table; an event is found when any of its three is."""
    return with_bindings("""
SELECT event_id, customer_id, event_name, event_time, budget,
       (SELECT venue_name FROM vm WHERE vm.venue_id = x.venue_id) AS venue_name,
       (SELECT capacity FROM vm WHERE vm.venue_id = x.venue_id) AS capacity,
       (SELECT name FROM cm WHERE cm.customer_id = x.customer_id) AS organizer_name,
       (SELECT COUNT(*) FROM bookings b WHERE b.event_id = x.event_id) AS booking_total
FROM found x""", extra=f"""
vm AS (SELECT *, venue_name ILIKE '{pattern}' AS hit FROM venues),
cm AS (SELECT *, name ILIKE '{pattern}' AS hit FROM customers),
found AS (
  SELECT * FROM events_t
  WHERE venue_id IN (SELECT venue_id FROM vm) AND customer_id IN (SELECT customer_id FROM cm)
    AND (event_name ILIKE '{pattern}' OR venue_id IN (SELECT venue_id FROM vm WHERE hit)
         OR customer_id IN (SELECT customer_id FROM cm WHERE hit)))""")


@register("event_search", _search_sql("%urgent #10%"))
def q_event_search(spark, sf_dir):
    return S.event_search(tables(spark, sf_dir), "  Urgent #10 ")


@register("event_search_organizer", _search_sql("%er#00000001%"))
def q_event_search_organizer(spark, sf_dir):
    """A plain term that hits organizer names through the OR."""
    return S.event_search(tables(spark, sf_dir), "ER#00000001")


@register("event_search_venue", _search_sql("%nation_2%"))
def q_event_search_venue(spark, sf_dir):
    """A term that hits venue names; its _ is a one-character wildcard."""
    return S.event_search(tables(spark, sf_dir), "Nation_2")


@register("event_search_wildcard", _search_sql("%#1_0%"))
def q_event_search_wildcard(spark, sf_dir):
    """The page never escapes % and _, so a user's _ matches any one character."""
    return S.event_search(tables(spark, sf_dir), "#1_0")


# Wildcard terms (the _ of a nation's name), plain ones, accented ones, and
# ones with a backslash that escapes nothing.
TERMS_SQL = """terms AS (
  SELECT lower(n_name) AS term FROM nation
  UNION SELECT '#' || CAST(n_nationkey + 10 AS VARCHAR) FROM nation
  UNION SELECT 'Ürgént #' || CAST(n_nationkey AS VARCHAR) FROM nation
  UNION SELECT 'low\\ #' || CAST(n_nationkey AS VARCHAR) FROM nation
  UNION SELECT p_name FROM part),
pats AS (SELECT term, '%' || strip_accents(replace(term, '\\', '')) || '%' AS pat FROM terms)"""
PAIRS_SQL = """
SELECT term, event_id FROM pats, events_t e
WHERE e.venue_id IN (SELECT venue_id FROM venues) AND e.customer_id IN (SELECT customer_id FROM customers)
  AND (e.event_name ILIKE pat
    OR (SELECT venue_name FROM venues v WHERE v.venue_id = e.venue_id) ILIKE pat
    OR (SELECT name FROM customers c WHERE c.customer_id = e.customer_id) ILIKE pat)"""


def _search_terms(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("term"))
    return (n.select(F.lower("n_name").alias("term"))
            .unionAll(n.select(F.concat(F.lit("#"), (F.col("n_nationkey") + 10).cast("string"))))
            .unionAll(n.select(F.concat(F.lit("Ürgént #"), key)))
            .unionAll(n.select(F.concat(F.lit("low\\ #"), key)))
            .unionAll(parts))


@register("search_terms_batch", with_bindings(PAIRS_SQL, extra=TERMS_SQL))
def q_search_terms_batch(spark, sf_dir):
    return S.search_terms_batch(tables(spark, sf_dir), _search_terms(spark, sf_dir))


@register("search_hit_counts", with_bindings(
    f"SELECT t.term, COUNT(p.event_id) AS hits FROM terms t LEFT JOIN ({PAIRS_SQL}) p "
    "ON p.term = t.term GROUP BY t.term", extra=TERMS_SQL))
def q_search_hit_counts(spark, sf_dir):
    return S.search_hit_counts(tables(spark, sf_dir), _search_terms(spark, sf_dir))


@register("account_by_email", with_bindings("""
SELECT s.request_id, s.email, c.customer_id, c.name, c.role, c.email AS account_email
FROM (SELECT request_id, email FROM signups) s
JOIN customers c ON lower(strip_accents(rtrim(s.email))) = lower(strip_accents(rtrim(c.email)))"""))
def q_account_by_email(spark, sf_dir):
    emails = B.bind_signups(spark, sf_dir).select("request_id", "email")
    return S.account_by_email(tables(spark, sf_dir), emails)


@register("viewer_action", with_bindings(f"""
SELECT w.view_id, w.viewer_id, w.event_id,
  CASE WHEN c.role = 'customer' THEN
         CASE WHEN EXISTS (SELECT 1 FROM bookings b
                           WHERE b.event_id = w.event_id AND b.customer_id = w.viewer_id)
                THEN 'Already Booked'
              WHEN NOT (e.event_time > {AS_OF_SQL}) THEN 'Event Closed'
              WHEN (SELECT COUNT(*) FROM bookings b WHERE b.event_id = e.event_id) >= v.capacity
                THEN 'Event Full'
              ELSE 'Reserve Seat' END
       WHEN c.role = 'organizer' AND e.customer_id = w.viewer_id THEN 'Edit/Delete'
  END AS action
FROM event_views w
JOIN events_t e ON w.event_id = e.event_id
JOIN venues v ON e.venue_id = v.venue_id
JOIN customers c ON c.customer_id = w.viewer_id"""))
def q_viewer_action(spark, sf_dir):
    views = B.bind_event_views(spark, sf_dir)
    return S.viewer_action(tables(spark, sf_dir), views, B.AS_OF, page="catalogue")


@register("viewer_action_search", with_bindings(f"""
SELECT w.view_id, w.viewer_id, w.event_id,
  CASE WHEN c.role = 'organizer' THEN CASE WHEN e.customer_id = w.viewer_id THEN 'Edit' END
       WHEN c.role = 'customer' THEN coalesce(
         (SELECT 'Already Booked' FROM bookings b
          WHERE b.event_id = w.event_id AND b.customer_id = w.viewer_id LIMIT 1),
         CASE WHEN e.event_time <= {AS_OF_SQL} THEN 'Event Closed' END,
         (SELECT CASE WHEN v.capacity <= (SELECT COUNT(*) FROM bookings b WHERE b.event_id = w.event_id)
                      THEN 'Event Full' END FROM venues v WHERE v.venue_id = e.venue_id),
         'Reserve Seat') END AS action
FROM event_views w JOIN events_t e USING (event_id) JOIN customers c ON c.customer_id = w.viewer_id
WHERE e.venue_id IN (SELECT venue_id FROM venues)"""))
def q_viewer_action_search(spark, sf_dir):
    views = B.bind_event_views(spark, sf_dir)
    return S.viewer_action(tables(spark, sf_dir), views, B.AS_OF, page="search")


@register("ucfirst", "SELECT doc_id, upper(substr(text, 1, 1)) || substr(text, 2) AS text FROM documents")
def q_ucfirst(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.ucfirst("text").alias("text"))


@register("normalize_text", """
SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text
FROM documents""")
def q_normalize_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.normalize_text("text").alias("text"))


@register("email_validity", with_bindings(f"""
SELECT request_id, email, {email_ok('email')} AS is_valid
FROM signups"""))
def q_email_validity(spark, sf_dir):
    s = B.bind_signups(spark, sf_dir)
    return s.select("request_id", "email", X.email_is_valid("email").alias("is_valid"))


#: Address forms of one customer; {k} is its key, {n} its name.  As text of SQL that both engines run.
EMAIL_FORMS = [
    "'a.' || {k} || '@mail.example.org'", "'.a' || {k} || '@example.com'", "'a..' || {k} || '@example.com'",
    """'"a b ' || {k} || '"@example.com'""", """'"quoted@at' || {k} || '".x@example.com'""", """'"un' || {k} || '@example.com'""",
    "'a@[192.0.2.' || {k} || ']'", "'a@[IPv6:2001:db8::' || {k} || ']'", "'a@[ipv6:1:2:3:4:5:6:7:' || {k} || ']'",
    "'a@[IPv6:1:2:3:4:5:6:7]'", "'a@[IPv6:::ffff:192.0.2.' || {k} || ']'", "'a@[IPv6:1::2::' || {k} || ']'", "'a@[IPv6:12345::1]'",
    "'a@x-' || {k} || '-.com'", "'a@x--' || {k} || '.co'", "'a@' || repeat('l', CAST({k} AS INT) % 80) || '.com'", "'a@localhost'",
    "repeat('u', CAST({k} AS INT) % 90) || '@example.com'", "'a@example.' || {k}", "'a@example.c' || {k}", "{n} || '@example.com'",
    "'a@b@c' || {k} || '.com'", "'a@[300.0.0.' || {k} || ']'", "'é' || {k} || '@example.com'"]


def _form(k: str, n: str) -> str:
    cases = " ".join(f"WHEN {i} THEN " + f.replace("{k}", f"CAST({k} AS STRING)").replace("{n}", n)
                     for i, f in enumerate(EMAIL_FORMS))
    return f"CASE CAST({k} AS INT) % {len(EMAIL_FORMS)} {cases} END"


@register("email_forms", f"""
SELECT c_custkey, email, {email_ok('email')} AS is_valid
FROM (SELECT c_custkey, {_form('c_custkey', 'c_name')} AS email FROM customer) c""")
def q_email_forms(spark, sf_dir):
    """Quoted local parts, address literals, labels and lengths at and beyond their limits."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return (c.select("c_custkey", F.expr(_form("c_custkey", "c_name")).alias("email"))
            .withColumn("is_valid", X.email_is_valid("email")))


# Moments written in many ways: what each text means is known from the date it was made of.
_MOMENT = "(o_orderdate + (o_orderkey % 86400) * INTERVAL 1 SECOND)"


@register("strtotime", f"""
SELECT o_orderkey, text, CASE o_orderkey % 12
    WHEN 0 THEN date_trunc('minute', d) WHEN 1 THEN date_trunc('day', d) WHEN 2 THEN date_trunc('minute', d)
    WHEN 3 THEN d WHEN 4 THEN date_trunc('day', d)
    WHEN 5 THEN now_ + (o_orderkey % 400) * INTERVAL 1 DAY WHEN 6 THEN now_ - (o_orderkey % 50) * INTERVAL 7 DAY
    WHEN 7 THEN now_ + ((isodow(d) - isodow(now_) + 6) % 7 + 1) * INTERVAL 1 DAY
    WHEN 8 THEN date_trunc('month', d) + INTERVAL 1 MONTH + (day(d) - 1) * INTERVAL 1 DAY
    WHEN 9 THEN now_ + INTERVAL 1 DAY + hour(d) * INTERVAL 1 HOUR WHEN 10 THEN d END AS moment
FROM (SELECT *, CASE o_orderkey % 12
    WHEN 0 THEN strftime(d, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(d, '%d %B %Y') WHEN 2 THEN strftime(d, '%b %d, %Y %I:%M %p')
    WHEN 3 THEN strftime(d, '%m/%d/%Y %H:%M:%S') WHEN 4 THEN strftime(d, '%-d.%-m.%Y')
    WHEN 5 THEN '+' || CAST(o_orderkey % 400 AS VARCHAR) || ' days' WHEN 6 THEN CAST(o_orderkey % 50 AS VARCHAR) || ' weeks ago'
    WHEN 7 THEN 'next ' || strftime(d, '%A') WHEN 8 THEN strftime(d, '%Y-%m-%d') || ' +1 month'
    WHEN 9 THEN 'tomorrow ' || strftime(d, '%I %p') WHEN 10 THEN '@' || CAST(CAST(epoch(d) AS BIGINT) AS VARCHAR)
    ELSE 'around ' || strftime(d, '%Y-%m-%d') END AS text
  FROM (SELECT o_orderkey, {_MOMENT} AS d, {AS_OF_SQL} AS now_ FROM orders) o) t""")
def q_strtotime(spark, sf_dir):
    """Free-form date and time texts, read from a fixed moment on."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)"))
    forms = ["yyyy-MM-dd'T'HH:mm", "dd MMMM yyyy", "MMM dd, yyyy hh:mm a", "MM/dd/yyyy HH:mm:ss", "d.M.yyyy"]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k % 12 == i, F.date_format(d, form)).otherwise(text)
    text = (F.when(k % 12 == 5, F.concat(F.lit("+"), (k % 400).cast("string"), F.lit(" days")))
            .when(k % 12 == 6, F.concat((k % 50).cast("string"), F.lit(" weeks ago")))
            .when(k % 12 == 7, F.concat(F.lit("next "), F.date_format(d, "EEEE")))
            .when(k % 12 == 8, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" +1 month")))
            .when(k % 12 == 9, F.concat(F.lit("tomorrow "), F.date_format(d, "hh a")))
            .when(k % 12 == 10, F.concat(F.lit("@"), F.unix_timestamp(d).cast("string")))
            .when(k % 12 == 11, F.concat(F.lit("around "), F.date_format(d, "yyyy-MM-dd"))).otherwise(text))
    return (o.select("o_orderkey", text.alias("text"))
            .withColumn("moment", strtotime(F.col("text"), F.lit(B.AS_OF).cast("timestamp_ntz"))))


@register("event_cards", with_bindings("""
SELECT event_id, strftime(event_time, '%b %d, %Y %I:%M %p') AS when_text,
  'BDT ' || format('{:,.2f}', budget::DOUBLE) AS budget_text,
  upper(left(split_part(trim(organizer_name), ' ', 1), 1))
    || upper(left(split_part(trim(organizer_name), ' ', 2), 1)) AS organizer_initials,
  venue_name || ' (Capacity: ' || CAST(capacity AS VARCHAR) || ')' AS venue_label,
  strftime(event_time, '%Y-%m-%dT%H:%M') AS input_time
FROM cat""", extra="""cat AS (SELECT e.*, c.name AS organizer_name, v.venue_name, v.capacity
  FROM events_t e JOIN customers c ON e.customer_id = c.customer_id
  JOIN venues v ON e.venue_id = v.venue_id)"""))
def q_event_cards(spark, sf_dir):
    """Display formatting of catalogue cards (dates, money, initials, labels)."""
    cat = R.event_catalogue(tables(spark, sf_dir))
    return cat.select(
        "event_id", X.format_datetime("event_time").alias("when_text"),
        X.format_currency("budget").alias("budget_text"),
        X.initials("organizer_name").alias("organizer_initials"),
        X.resource_label("venue").alias("venue_label"),
        X.format_input_time("event_time").alias("input_time"))
