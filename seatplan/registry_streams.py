"""Registered streaming jobs, run with ``availableNow``.

Each check writes its stand-in commands to files under the session's
checkpoint folder, runs the stream to completion and reads the sink back.
"""

from __future__ import annotations

import uuid


from seatplan.plans.lineage import scratch_path
from seatplan.operators.changes import NOTE_BOOKED, NOTE_CANCELLED
from seatplan.registry import register, tables
from seatplan.registry_changes import replay_sql
from seatplan.registry_validate import _VALIDATE_EVENTS_SQL
from seatplan.sources import bindings as B
from seatplan.streaming import admissions as S
from seatplan.streaming.files import write_in_order

def _run_admissions(spark, sf_dir):
    root = scratch_path(spark, f"stream-admissions-{uuid.uuid4().hex}")
    files = write_in_order(B.bind_booking_commands(spark, sf_dir), f"{root}/in", "request_id", 2)
    q = S.start_stream_admissions(spark, tables(spark, sf_dir), f"{root}/in", f"{root}/out",
                                  f"{root}/ckpt", max_files_per_trigger=files)
    q.awaitTermination()
    return root


@register("stream_admissions", replay_sql("SELECT * FROM replayed"))
def q_stream_admissions(spark, sf_dir):
    """Mixed commands as a file stream, folded per event with kept state."""
    root = _run_admissions(spark, sf_dir)
    return S.read_batches(spark, f"{root}/out", "outcomes").drop("batch_id")


@register("stream_audit", replay_sql(f"""
SELECT (SELECT max(audit_id) FROM booking_audit_log) + request_id + 1 AS audit_id, booking_id, event_id,
       customer_id, outcome AS action_type,
       CASE outcome WHEN 'BOOKED' THEN '{NOTE_BOOKED}' ELSE '{NOTE_CANCELLED}' END AS action_note,
       requested_at AS action_time
FROM replayed WHERE outcome IN ('BOOKED', 'CANCELLED')"""))
def q_stream_audit(spark, sf_dir):
    """The audit rows written alongside T01's outcomes."""
    root = _run_admissions(spark, sf_dir)
    return S.read_batches(spark, f"{root}/out", "audit").drop("batch_id")


@register("stream_validate_events", _VALIDATE_EVENTS_SQL)
def q_stream_validate_events(spark, sf_dir):
    """V03 over a file stream of drafts; accepted and rejected read back."""
    root = scratch_path(spark, f"stream-validate-{uuid.uuid4().hex}")
    files = write_in_order(B.bind_event_drafts(spark, sf_dir), f"{root}/in", "draft_id", 4)
    q = S.start_stream_validate_events(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt",
                                       B.AS_OF, max_files_per_trigger=files)
    q.awaitTermination()
    acc = S.read_batches(spark, f"{root}/out", "accepted")
    rej = S.read_batches(spark, f"{root}/out", "rejected")
    return acc.unionByName(rej).select("draft_id", "reason", "status")
