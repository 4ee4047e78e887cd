"""Stream = batch for T01 and T03; a restart adds nothing; state carries over."""

import os
import random
import tempfile
import time

import pandas as pd

from support import SEED_AS_OF

from seatplan.operators import validate as V
from seatplan.operators.replay import replay_commands
from seatplan.sources import schemas
from seatplan.sources.snapshot import latest_version, read_snapshot, write_snapshot
from seatplan.streaming import admissions as S
from test_admission_sim import cmd_df, mixed_commands, world


def test_stream_admissions_equal_batch_and_restart(spark):
    rnd = random.Random(11)
    t, events, bookings, roles = world(spark, rnd)
    base = max(bookings) if bookings else 0
    cmds = mixed_commands(rnd, bookings, base)
    root = tempfile.mkdtemp(prefix="seatplan-stream-")
    src, out, ck = f"{root}/in", f"{root}/out", f"{root}/ck"
    first, rest = cmds[:70], cmds[70:]
    for i in range(0, 70, 25):
        cmd_df(spark, first[i:i + 25]).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    S.start_stream_admissions(spark, t, src, out, ck).awaitTermination()
    n_batches = len(os.listdir(f"{out}/outcomes"))
    # restart with no new input: nothing new is written
    S.start_stream_admissions(spark, t, src, out, ck).awaitTermination()
    assert len(os.listdir(f"{out}/outcomes")) == n_batches
    # new file: judged against the kept state
    cmd_df(spark, rest).coalesce(1).write.mode("append").parquet(src)
    S.start_stream_admissions(spark, t, src, out, ck).awaitTermination()
    got = {(r["request_id"], r["outcome"], r["booking_id"])
           for r in S.read_batches(spark, out, "outcomes").collect()}
    want = {(r["request_id"], r["outcome"], r["booking_id"])
            for r in replay_commands(t, cmd_df(spark, cmds)).collect()}
    assert got == want
    audit = S.read_batches(spark, out, "audit").collect()
    assert len(audit) == sum(1 for g in got if g[1] in ("BOOKED", "CANCELLED"))


class _State:
    """As much of Spark's group state as the fold uses."""
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


def test_neighbouring_events_share_a_group_and_keep_their_own_ledgers():
    at, later = pd.Timestamp(2026, 1, 1), pd.Timestamp(2026, 2, 1)

    def fold(state, *commands):
        rows = [(r, e, c, kind, at, None, later, 1, 0, static, bid, 100 + r)
                for r, e, c, kind, bid, static in commands]
        pdf = pd.DataFrame(rows, columns=[
            "request_id", "event_id", "customer_id", "kind", "requested_at", "gate", "event_time",
            "capacity", "existing", "static_bid", "booking_id", "new_booking_id"]).astype(
            {c: "object" for c in ("gate", "static_bid", "booking_id")})
        out = pd.concat(S._stateful_fold((0,), iter([pdf]), state))
        return dict(zip(out["request_id"], out["outcome"]))

    state = _State()
    # Out of order; each event has one seat, customer 7 takes one at both.
    assert fold(state, (3, 2, 8, "create", None, None), (1, 1, 7, "create", None, None),
                (2, 2, 7, "create", None, None), (4, 3, 9, "cancel", 50, 50)) == {
        1: "BOOKED", 2: "BOOKED", 3: "FULL", 4: "CANCELLED"}
    assert fold(state, (5, 1, 8, "create", None, None), (6, 2, 7, "cancel", 102, None),
                (7, 2, 8, "create", None, None), (8, 3, 9, "cancel", 50, 50)) == {
        5: "FULL", 6: "CANCELLED", 7: "BOOKED", 8: "MISSING"}
    assert sorted(zip(*state.get), key=str) == [(1, 7, 101), (2, 8, 107), (3, 9, None)]
    fold(state, (9, 1, 7, "cancel", 101, None), (10, 2, 8, "cancel", 107, None))
    assert list(zip(*state.get)) == [(3, 9, None)]


def test_stream_validate_events_equals_batch(spark):
    rows = [(i, 1, 1 + i % 3, " ev  %d " % i if i % 5 else "  ",
             "2026-05-0%dT10:00" % (1 + i % 9) if i % 7 else "2026-04-01T10:00",
             float(i % 4) - 0.5, None, None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, schemas.EVENT_DRAFTS)
    root = tempfile.mkdtemp(prefix="seatplan-t03-")
    for i in range(3):
        df.filter(f"draft_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{root}/in")
    S.start_stream_validate_events(spark, f"{root}/in", f"{root}/out", f"{root}/ck",
                                   SEED_AS_OF).awaitTermination()
    got = {(r["draft_id"], r["reason"]) for r in
           S.read_batches(spark, f"{root}/out", "accepted").unionByName(
               S.read_batches(spark, f"{root}/out", "rejected")).collect()}
    want = {(r["draft_id"], r["reason"]) for r in V.validate_events(df, SEED_AS_OF).collect()}
    assert got == want and len(got) == 59


def test_snapshot_versions(spark, seed):
    root = tempfile.mkdtemp(prefix="seatplan-snap-")
    write_snapshot(spark, seed.as_dict(), root, 1)
    fewer = seed.bookings.filter("booking_id <> 2")
    write_snapshot(spark, {"bookings": fewer}, root, 2, base_version=1)
    # a crashed job: table written, no commit marker
    seed.events.limit(1).write.parquet(f"{root}/v=000000000003/events")
    assert latest_version(spark, root) == 2
    t = read_snapshot(spark, root)
    assert t.bookings.count() == 2 and t.events.count() == 3
    assert read_snapshot(spark, root, version=1).bookings.count() == 3
