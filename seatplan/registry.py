"""Registered queries (Spark) and their DuckDB oracle SQL.

Each query takes (spark, sf_dir), binds the driver tables to the booking
schema (``seatplan.sources.bindings``) and runs one library operator over
the whole tables.  The oracle SQL re-states the same binding as CTEs and
answers in the reference's own SQL shape (e.g. COUNT(DISTINCT) over the
fan-out), so it does not share our rewrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seatplan.operators import reports as R
from seatplan.session import importable_on_workers
from seatplan.sources import bindings as B

AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"

# DuckDB text of the bindings (same rows as seatplan.sources.bindings).
BINDINGS_SQL = {
    "customers": """select c_custkey as customer_id, c_name as name,
        '+880' || lpad(cast(c_custkey as varchar), 10, '0') as phone,
        lower(c_name) || '@example.com' as email, cast(null as varchar) as password,
        case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'organizer' else 'customer' end as role
        from customer""",
    "venues": """select cast(n_nationkey as bigint) as venue_id, n_name as venue_name,
        r_name as address, cast(2 + n_nationkey % 9 as int) as capacity
        from nation join region on n_regionkey = r_regionkey""",
    "staff": """select cast(n_nationkey as bigint) as staff_id, n_name as name, r_name as role,
        cast(null as varchar) as phone from nation join region on n_regionkey = r_regionkey""",
    "suppliers": """select s_suppkey as supplier_id, s_name as name, cast(null as varchar) as phone,
        n_name as service_type from supplier join nation on s_nationkey = n_nationkey""",
    "events_t": """select o_orderkey as event_id, o_custkey as customer_id,
        cast(c_nationkey as bigint) as venue_id,
        o_orderpriority || ' #' || cast(o_orderkey as varchar) as event_name,
        o_orderdate as event_time, cast(o_totalprice as decimal(12,2)) as budget
        from orders join customer on o_custkey = c_custkey""",
    "bookings": """select l_orderkey * 100000 + l_partkey as booking_id,
        cast(min(l_shipdate) as date) as booking_date, l_orderkey as event_id,
        l_partkey as customer_id from lineitem group by l_orderkey, l_partkey""",
    "event_staff": """select distinct l_orderkey as event_id, cast(l_linenumber as bigint) as staff_id
        from lineitem""",
    "event_suppliers": """select distinct l_orderkey as event_id, l_suppkey as supplier_id
        from lineitem""",
    "booking_audit_log": """select event_id as audit_id, event_id as booking_id,
        case when user_id % 5 = 0 then -1 - event_id else event_id end as event_id,
        case when user_id % 7 = 0 then -1 - user_id else user_id end as customer_id,
        case when event_type = 'error' then 'CANCELLED' else 'BOOKED' end as action_type,
        'note' as action_note, ts as action_time from events""",
    "booking_requests": f"""select event_id as request_id,
        cast(floor(value * 4) as bigint) - 5 as event_id, user_id as customer_id,
        {AS_OF_SQL} as requested_at from events""",
    "cancel_requests": f"""select l_orderkey * 100000 + l_partkey as request_id,
        l_orderkey * 100000 + l_partkey as booking_id,
        case when l_partkey % 5 = 0 then l_partkey + 1 else l_partkey end as customer_id,
        {AS_OF_SQL} as requested_at
        from (select distinct l_orderkey, l_partkey from lineitem) t""",
    "signups": """select c_custkey as request_id,
        case when c_custkey % 9 = 0 then '' when c_custkey % 11 = 0 then repeat(c_name, 6)
             else c_name end as name,
        case when c_custkey % 13 = 0 then '+880 1700 000 000 000 000' else '+880' end as phone,
        case when c_custkey % 7 = 0 then 'user.example.com'
             when c_custkey % 5 = 0 then 'CUSTOMER#000000003@Example.com'
             else lower(c_name) || '@new.example.com' end as email,
        case when c_custkey % 8 = 0 then 'abc' else 'abcdef' end as password,
        case when c_custkey % 4 = 0 then 'admin' else 'organizer' end as role from customer""",
    "event_drafts": """select o_orderkey as draft_id, o_custkey as customer_id,
        o_orderkey % 27 as venue_id,
        case when o_orderkey % 11 = 0 then '  '
             else '  ' || o_orderpriority || '   #' || cast(o_orderkey as varchar) end as event_name,
        case when o_orderkey % 17 = 0 then ''
             else substr(cast(o_orderdate as varchar), 1, 10) || 'T10:00' end as event_time,
        case when o_orderkey % 13 = 0 then -1.0e0 when o_orderkey % 19 = 0 then 0.001e0
             else o_totalprice end as budget,
        case when o_orderkey % 2 = 0 then [cast(o_orderkey % 30 as varchar), '3',
             cast(o_orderkey % 30 as varchar) || 'x'] end as staff_ids,
        case when o_orderkey % 5 = 0 then [cast(o_orderkey % 120 as varchar)] end as supplier_ids
        from orders""",
    "venue_rows": """select p_partkey as request_id, p_name as venue_name, p_brand as address,
        case when p_partkey % 10 = 0 then '99999999999' else cast(p_size - 25 as varchar) end as capacity
        from part""",
    "staff_rows": """select c_custkey as request_id, c_name as name, c_mktsegment as role,
        case when c_acctbal < 0 then ' ' else '+880 ' || cast(c_nationkey as varchar) end as phone
        from customer""",
    "supplier_rows": """select s_suppkey as request_id, s_name as name,
        case when s_acctbal < 0 then '  ' else '+880' || cast(s_suppkey as varchar) end as phone,
        'Service' || chr(9) || '  ' || cast(s_nationkey as varchar) as service_type from supplier""",
    "profile_updates": """select request_id, request_id as customer_id, name, phone, email, password
        from signups""",
    "profile_moves": """select (c_custkey * 7919) % 1000003 as request_id, c_custkey as customer_id,
        c_name as name, '+880' as phone, case c_custkey % 5 when 0 then 'free' || cast(c_custkey as varchar)
          when 1 then c_name else 'customer#' || lpad(cast(c_custkey + 1 as varchar), 9, '0') end || '@example.com' as email,
        '' as password from customer
        union all select 2000000 + (c_custkey * 104729) % 1000003, c_custkey, c_name, '+880',
        'customer#' || lpad(cast(c_custkey + 2 as varchar), 9, '0') || '@EXAMPLE.com', '' from customer where c_custkey % 3 = 0""",
    "event_deletes": f"""select o_orderkey as request_id, o_orderkey as event_id,
        case when o_orderkey % 3 = 0 then o_custkey else o_custkey + 1 end as customer_id,
        {AS_OF_SQL} as requested_at from orders""",
    "event_edits": """select case when draft_id % 23 = 0 then 0 when draft_id % 7 = 0 then draft_id + 1
        else draft_id end as event_id, * from event_drafts""",
    "resource_deletes": """select cast(n_nationkey as bigint) + 1000000 as request_id, 'venue' as kind,
        cast(n_nationkey as bigint) as id from nation
        union all select cast(n_nationkey as bigint) + 2000000, 'staff', cast(n_nationkey as bigint) - 3
        from nation
        union all select s_suppkey + 3000000, 'supplier', s_suppkey from supplier
        union all select cast(n_nationkey as bigint) + 4000000, 'room', cast(n_nationkey as bigint)
        from nation""",
    "booking_commands": """select request_id * 1000000000000 as request_id, 'create' as kind, event_id,
        customer_id, cast(null as bigint) as booking_id, requested_at from booking_requests
        union all select (booking_id * 7919) % 10000 * 1000000000000 + booking_id + 1, 'cancel', null,
        customer_id, booking_id, requested_at from cancel_requests
        union all select (request_id + 5) * 1000000000000 + 7, 'cancel', event_id, customer_id,
        (select max(booking_id) from bookings) + request_id * 1000000000000 + 1, requested_at
        from booking_requests where request_id % 3 = 0""",
    "event_views": """select event_id as view_id, user_id as viewer_id,
        cast(floor(value * 4) as bigint) - 5 as event_id from events""",
}


def with_bindings(body: str, extra: str = "") -> str:
    ctes = ",\n".join(f"{n} AS ({s})" for n, s in BINDINGS_SQL.items())
    if extra:
        ctes += ",\n" + extra
    return f"WITH {ctes}\n{body}"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load_all()
    return {name: importable_on_workers(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from seatplan import (  # noqa: F401
        registry_changes, registry_reports, registry_results, registry_streams, registry_text,
        registry_validate)


def tables(spark: SparkSession, sf_dir: str):
    return B.bind_tables(spark, sf_dir)


__all__ = ["register", "queries", "oracle_sql", "recursive", "with_bindings", "tables", "R", "B"]
