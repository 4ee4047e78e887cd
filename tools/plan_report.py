"""Write PLANS.md: physical-plan shape of each operator over stored tables.

For every operator: shuffles (Exchange), join strategies, windows, top-k,
Python stages, and whether scans carry pushed filters -- once with Spark's
size-checked broadcast as configured, once with broadcast disabled (every
table treated as large, as at 100 TB).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from seatplan.operators import changes as C  # noqa: E402
from seatplan.operators import reports as R  # noqa: E402
from seatplan.operators import search as S  # noqa: E402
from seatplan.operators import validate as V  # noqa: E402
from seatplan.operators.replay import replay_commands  # noqa: E402
from seatplan.plans.lineage import scratch_path  # noqa: E402
from seatplan.session import get_session  # noqa: E402
from seatplan.sources import bindings as B  # noqa: E402
from seatplan.sources.tables import load_tables  # noqa: E402

COUNTS = [("shuffles", r"Exchange (hash|range|SinglePartition|RoundRobin)"),
          ("broadcasts", r"BroadcastExchange"), ("smj", r"SortMergeJoin"),
          ("bhj", r"BroadcastHashJoin"), ("nested_loop", r"BroadcastNestedLoopJoin"),
          ("cartesian", r"CartesianProduct"), ("windows", r"\bWindow\b"),
          ("top_k", r"TakeOrderedAndProject"), ("python", r"(FlatMapGroupsInPandas|MapInPandas|"
                                                          r"ArrowEvalPython|BatchEvalPython)")]


def shape(df) -> dict:
    p = df._jdf.queryExecution().executedPlan().toString()
    out = {k: len(re.findall(rx, p)) for k, rx in COUNTS}
    out["pushed_filters"] = len(re.findall(r"PushedFilters: \[[^\]]", p))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 16, app_name="seatplan-plans")
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_path(spark, f"plans-{uuid.uuid4().hex}")
    for n, df in B.bind_tables(spark, sf_dir).as_dict().items():
        df.repartition(4).write.parquet(f"{root}/tables/{n}")
    cmds = {"requests": B.bind_booking_requests(spark, sf_dir),
            "cancels": B.bind_cancel_requests(spark, sf_dir),
            "commands": B.bind_booking_commands(spark, sf_dir),
            "drafts": B.bind_event_drafts(spark, sf_dir),
            "signups": B.bind_signups(spark, sf_dir),
            "views": B.bind_event_views(spark, sf_dir),
            "deletes": B.bind_event_deletes(spark, sf_dir)}
    for n, df in cmds.items():
        df.repartition(4).write.parquet(f"{root}/cmd/{n}")
    t = load_tables(spark, f"{root}/tables")
    c = {n: spark.read.parquet(f"{root}/cmd/{n}") for n in cmds}
    terms = spark.createDataFrame([("urgent",), ("er#00000001",)], "term string")
    ops = {
        "event_catalogue": lambda: R.event_catalogue(t),
        "event_state": lambda: R.event_state(t, B.AS_OF),
        "upcoming_events": lambda: R.upcoming_events(t, B.AS_OF),
        "dashboard_totals": lambda: R.dashboard_totals(t),
        "organizer_summary": lambda: R.organizer_summary(t),
        "customer_booking_totals": lambda: R.customer_booking_totals(t),
        "customer_itinerary (one customer)": lambda: R.customer_itinerary(t, customer_ids=[7]),
        "attendee_roster": lambda: R.attendee_roster(t),
        "venue_usage": lambda: R.venue_usage(t),
        "unassigned_staff": lambda: R.unassigned_staff(t),
        "event_assignments": lambda: R.event_assignments(t),
        "booking_activity_report": lambda: R.booking_activity_report(t, 20),
        "owned_events": lambda: R.owned_events(t, c["deletes"]),
        "event_search": lambda: S.event_search(t, "urgent #10"),
        "search_terms_batch (plain)": lambda: S.search_terms_batch(t, terms),
        "account_by_email": lambda: S.account_by_email(t, c["signups"]),
        "viewer_action": lambda: S.viewer_action(t, c["views"], B.AS_OF),
        "validate_events": lambda: V.validate_events(c["drafts"], B.AS_OF),
        "validate_signups": lambda: V.validate_signups(t, c["signups"]),
        "integrity_report": lambda: V.integrity_report(t),
        "overbooked_events": lambda: V.overbooked_events(t),
        "admit_bookings": lambda: C.admit_bookings(t, c["requests"]),
        "cancel_bookings": lambda: C.cancel_bookings(t, c["cancels"]),
        "delete_events (outcomes)": lambda: C.delete_events(t, c["deletes"]).outcomes,
        "replay_commands": lambda: replay_commands(t, c["commands"]),
    }
    keys = [k for k, _ in COUNTS] + ["pushed_filters"]
    print("# PLANS\n")
    print("Physical-plan shape of each operator over the bound tables stored as parquet "
          f"({os.path.basename(sf_dir)}), from `tools/plan_report.py`.  Jobs that checkpoint "
          "an intermediate (admissions, cancellations, deletes) show the plan after the "
          "checkpoint.  Columns count plan nodes.\n")
    for label, conf in (("Broadcast as configured (AQE, size-checked auto-broadcast)", None),
                        ("Broadcast disabled: every table treated as large", "-1")):
        if conf:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        print(f"## {label}\n")
        print("| operator | " + " | ".join(keys) + " |")
        print("| --- | " + " | ".join("---" for _ in keys) + " |")
        for name, build in ops.items():
            s = shape(build())
            print(f"| {name} | " + " | ".join(str(s[k]) for k in keys) + " |")
        print()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    print("No operator has a nested loop or a cartesian product.  `windows` appear in admissions and "
          "the replay: one over range counts (at most 1024 rows a key) and one that ranks the single "
          "range in which a key's last seat lies.  `python` is the ordered fold of the replay, for "
          "events that mix live creates and cancels.")
    _ = F


if __name__ == "__main__":
    main()
