"""Benchmark: headline queries on the bound driver tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3).  The driver tables are bound to the booking schema
and written once as parquet (as a deployment would store them); each query
is then run to completion into the no-op sink, one warm-up run and the
median of BENCH_REPEAT timed runs.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# Python workers import the package too, wherever the bench is started.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

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
from seatplan.functions.text import normalize_text  # noqa: E402

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        app_name="seatplan-bench")
    spark.sparkContext.setLogLevel("ERROR")

    root = scratch_path(spark, f"bench-{uuid.uuid4().hex}")
    bound = B.bind_tables(spark, sf_dir).as_dict()
    # Stored as a deployment would: several files per table, so scans split
    # across cores (a single small driver file is one row group, one task).
    for name, df in bound.items():
        df.repartition(cpus).write.mode("overwrite").parquet(f"{root}/tables/{name}")
    cmds = {
        "requests": B.bind_booking_requests(spark, sf_dir),
        "cancels": B.bind_cancel_requests(spark, sf_dir),
        "commands": B.bind_booking_commands(spark, sf_dir),
        "drafts": B.bind_event_drafts(spark, sf_dir),
        "signups": B.bind_signups(spark, sf_dir),
        "edits": B.bind_event_edits(spark, sf_dir),
        "profiles": B.bind_profile_updates(spark, sf_dir),
        "views": B.bind_event_views(spark, sf_dir),
        "deletes": B.bind_event_deletes(spark, sf_dir),
    }
    for name, df in cmds.items():
        df.repartition(cpus).write.mode("overwrite").parquet(f"{root}/cmd/{name}")
    t = load_tables(spark, f"{root}/tables")
    cmd = {n: spark.read.parquet(f"{root}/cmd/{n}") for n in cmds}
    terms = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.lower("n_name").alias("term")).unionAll(  # wildcard terms, then plain ones
        spark.read.parquet(f"{sf_dir}/nation.parquet").select(
            F.concat(F.lit("#"), (F.col("n_nationkey") + 100).cast("string"))))
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(cpus).write.mode(
        "overwrite").parquet(f"{root}/documents")
    docs = spark.read.parquet(f"{root}/documents")

    plan = {
        "event_catalogue": lambda: R.event_catalogue(t),
        "event_state": lambda: R.event_state(t, B.AS_OF),
        "upcoming_events": lambda: R.upcoming_events(t, B.AS_OF),
        "dashboard_totals": lambda: R.dashboard_totals(t),
        "organizer_summary": lambda: R.organizer_summary(t),
        "customer_itinerary": lambda: R.customer_itinerary(t),
        "attendee_roster": lambda: R.attendee_roster(t),
        "booking_activity_report": lambda: R.booking_activity_report(t, 20),
        "event_search": lambda: S.event_search(t, "Urgent #10"),
        "search_terms_batch": lambda: S.search_terms_batch(t, terms),
        "viewer_action": lambda: S.viewer_action(t, cmd["views"], B.AS_OF),
        "integrity_report": lambda: V.integrity_report(t),
        "overbooked_events": lambda: V.overbooked_events(t),
        "validate_events": lambda: V.validate_events(cmd["drafts"], B.AS_OF),
        "validate_signups": lambda: V.validate_signups(t, cmd["signups"]),
        "admit_bookings": lambda: C.admit_bookings(t, cmd["requests"]),
        "cancel_bookings": lambda: C.cancel_bookings(t, cmd["cancels"]),
        "delete_events": lambda: C.delete_events(t, cmd["deletes"]).outcomes,
        "insert_events": lambda: C.insert_events(t, cmd["drafts"], B.AS_OF).outcomes,
        "update_events": lambda: C.update_events(t, cmd["edits"], B.AS_OF).outcomes,
        "update_profiles": lambda: C.update_profiles(t, cmd["profiles"]).outcomes,
        "replay_commands": lambda: replay_commands(t, cmd["commands"]),
        "normalize_text": lambda: docs.select("doc_id", normalize_text("text").alias("t")),
    }
    only = [a for a in sys.argv[1:]]
    times = {}
    for name, build in plan.items():
        if only and name not in only:
            continue
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    name = os.path.basename(sf_dir.rstrip("/"))
    try:
        sf = float(name[2:]) if name.startswith("sf") else name
    except ValueError:
        sf = name
    print(json.dumps({"metric": "sum_of_median_query_seconds",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))


if __name__ == "__main__":
    main()
