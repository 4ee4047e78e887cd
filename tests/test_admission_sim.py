"""W08 / W09 / W12 against a row-by-row model on random small batches."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from support import make_tables

from seatplan.operators import changes as C
from seatplan.operators.replay import replay_commands
from sim import simulate

NOW = dt.datetime(2026, 1, 1, 12, 0)


def world(spark, rnd, n_events=4, n_cust=6):
    roles = {c: ("organizer" if c == 1 else "customer") for c in range(1, n_cust + 1)}
    events = {}
    ev_rows, venues = [], []
    for e in range(1, n_events + 1):
        cap = rnd.randint(0, 3) if e > 1 else 40   # event 1 is the hot one
        when = NOW + dt.timedelta(days=rnd.choice([-1, 3, 5])) if e > 1 else \
            NOW + dt.timedelta(days=2)
        venues.append((e, f"V{e}", "addr", cap))
        ev_rows.append((e, 1, e, f"E{e}", when, Decimal("10.00")))
        events[e] = (when, cap)
    book_rows, bookings = [], {}
    bid = 100
    for e in events:
        for c in rnd.sample(range(2, n_cust + 1), rnd.randint(0, 2)):
            bid += 1
            book_rows.append((bid, dt.date(2025, 12, 1), e, c))
            bookings[bid] = (e, c)
    cust_rows = [(c, f"C{c}", "p", f"c{c}@x.com", "secret", r) for c, r in roles.items()]
    t = make_tables(spark, customers=cust_rows, venues=venues, events=ev_rows,
                    bookings=book_rows)
    return t, events, bookings, roles


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_admit_bookings_matches_row_by_row(spark, seed):
    rnd = random.Random(seed)
    t, events, bookings, roles = world(spark, rnd)
    reqs = []
    for rid in rnd.sample(range(1, 500), 80):
        e = rnd.choice([1, 1, 1, 2, 3, 4, 9, 0])          # hot event 1, missing 9, invalid 0
        reqs.append({"request_id": rid, "kind": "create", "event_id": e,
                     "customer_id": rnd.randint(1, 6), "booking_id": None,
                     "requested_at": NOW})
    reqs.sort(key=lambda r: r["request_id"])
    df = spark.createDataFrame([(r["request_id"], r["event_id"], r["customer_id"], NOW)
                                for r in reqs],
                               "request_id long, event_id long, customer_id long, "
                               "requested_at timestamp_ntz")
    got = {r["request_id"]: r["outcome"] for r in
           C.admit_bookings(t, df).collect()}
    want = simulate(events, bookings, roles, reqs, lambda rid: 10_000 + rid)
    assert got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_cancel_bookings_matches_row_by_row(spark, seed):
    rnd = random.Random(seed)
    t, events, bookings, roles = world(spark, rnd)
    ids = list(bookings) + [0, -3, 999]
    cmds = []
    for rid in range(1, 40):
        b = rnd.choice(ids)
        owner = bookings.get(b, (None, rnd.randint(1, 6)))[1]
        cust = owner if rnd.random() < 0.8 else rnd.randint(1, 6)
        cmds.append({"request_id": rid, "kind": "cancel", "event_id": None, "customer_id": cust,
                     "booking_id": b, "requested_at": NOW})
    df = spark.createDataFrame([(c["request_id"], c["booking_id"], c["customer_id"], NOW)
                                for c in cmds],
                               "request_id long, booking_id long, customer_id long, "
                               "requested_at timestamp_ntz")
    got = {r["request_id"]: r["outcome"] for r in C.cancel_bookings(t, df).collect()}
    assert got == simulate(events, bookings, roles, cmds, lambda rid: None)


def mixed_commands(rnd, bookings, base):
    cmds, made = [], []
    for rid in range(1, 120):
        if rnd.random() < 0.6 or not (bookings or made):
            e = rnd.choice([1, 1, 2, 3, 4, 9])
            cmds.append({"request_id": rid, "kind": "create", "event_id": e,
                         "customer_id": rnd.randint(1, 6), "booking_id": None,
                         "requested_at": NOW})
            made.append((base + rid + 1, e, cmds[-1]["customer_id"]))
        else:
            pool = [(b, v[0], v[1]) for b, v in bookings.items()] + made
            b, e, c = rnd.choice(pool)
            if rnd.random() < 0.15:
                c = rnd.randint(1, 6)
            cmds.append({"request_id": rid, "kind": "cancel", "event_id": e, "customer_id": c,
                         "booking_id": b, "requested_at": NOW})
    return cmds


CMD_SCHEMA = ("request_id long, kind string, event_id long, customer_id long, booking_id long, "
              "requested_at timestamp_ntz")


def cmd_df(spark, cmds):
    return spark.createDataFrame([(c["request_id"], c["kind"], c["event_id"], c["customer_id"],
                                   c["booking_id"], c["requested_at"]) for c in cmds], CMD_SCHEMA)


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_replay_commands_matches_row_by_row(spark, seed):
    rnd = random.Random(seed)
    t, events, bookings, roles = world(spark, rnd)
    base = max(bookings) if bookings else 0
    cmds = mixed_commands(rnd, bookings, base)
    got = {r["request_id"]: r["outcome"] for r in replay_commands(t, cmd_df(spark, cmds)).collect()}
    want = simulate(events, bookings, roles, cmds, lambda rid: base + rid + 1)
    assert got == want
    assert "CANCELLED" in want.values() and "BOOKED" in want.values()


@pytest.mark.parametrize("seed", [7, 11, 12])
def test_parallel_fold_matches_row_by_row(spark, seed, monkeypatch):
    """Every mixed event goes the way of a hot one, in stretches of a few commands."""
    from seatplan.operators import hot_replay
    monkeypatch.setattr(hot_replay, "STRETCH", 5)
    rnd = random.Random(seed)
    t, events, bookings, roles = world(spark, rnd)
    base = max(bookings) if bookings else 0
    cmds = mixed_commands(rnd, bookings, base)
    got = {r["request_id"]: r["outcome"] for r in replay_commands(t, cmd_df(spark, cmds), hot_commands=0).collect()}
    assert got == simulate(events, bookings, roles, cmds, lambda rid: base + rid + 1)


def test_hot_event_is_split_over_tasks(spark, monkeypatch):
    """A third of all commands on one event: no sequential fold, several tasks, the same outcomes."""
    from seatplan.operators import hot_replay, replay
    monkeypatch.setattr(hot_replay, "STRETCH", 64)
    monkeypatch.setattr(replay, "_fold_bucket", None)  # the sequential fold is not called
    rnd = random.Random(3)
    roles = {c: "customer" for c in range(1, 401)}
    events = {1: (NOW + dt.timedelta(days=2), 60)}
    bookings = {c: (1, c) for c in range(1, 71)}  # more than there are seats
    t = make_tables(spark, customers=[(c, f"C{c}", "p", f"c{c}@x.com", "secret", "customer") for c in roles],
                    venues=[(1, "V", "a", 60)], events=[(1, 1, 1, "E", events[1][0], Decimal("1.00"))],
                    bookings=[(b, dt.date(2025, 1, 1), 1, c) for b, (_, c) in bookings.items()])
    base, cmds, made = max(bookings), [], list(bookings.items())
    for rid in range(1, 1500):
        if rnd.random() < .6:
            c = rnd.randint(1, 400)
            cmds.append(dict(request_id=rid, kind="create", event_id=1, customer_id=c, booking_id=None, requested_at=NOW))
            made.append((base + rid + 1, (1, c)))
        else:
            b, (_, c) = rnd.choice(made)
            cmds.append(dict(request_id=rid, kind="cancel", event_id=1, customer_id=c, booking_id=b, requested_at=NOW))
    settled, rest = hot_replay.parallel_replay(live_rows(spark, t, cmds))
    assert rest.isEmpty() and settled.select("_stretch").distinct().count() > 10
    want = simulate(events, bookings, roles, cmds, lambda rid: base + rid + 1)
    assert {r["request_id"]: r["outcome"] for r in settled.collect()} == want
    assert {"BOOKED", "FULL", "DUPLICATE", "CANCELLED", "MISSING"} <= set(want.values())


def live_rows(spark, t, cmds):
    from seatplan.operators.changes import id_base
    from seatplan.operators.replay import prepare_commands, settled_outcome
    from pyspark.sql import functions as F
    new_bid = (F.lit(id_base(t.bookings, "booking_id")) + F.col("request_id") + F.lit(1)).cast("bigint")
    return prepare_commands(t, cmd_df(spark, cmds), new_bid).filter(settled_outcome().isNull())
