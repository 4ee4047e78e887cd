"""E-mails that change hands inside a batch, against a row-by-row model."""

import random

import pytest

from seatplan.operators import changes as C
from seatplan.operators.releases import settle_claims
from sim import simulate_profiles
from support import make_tables

CLAIMS = "at long, customer_id long, ek string, effect boolean"
HELD = "customer_id long, ek string"


def settled(spark, held, requests):
    claims = spark.createDataFrame([(r, c, k, fits and c in held) for r, c, k, fits in requests], CLAIMS)
    return {r["at"]: r["granted"] for r in settle_claims(claims, spark.createDataFrame(list(held.items()), HELD)).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_batches(spark, seed):
    rnd = random.Random(seed)
    held = {c: f"e{c}" for c in range(1, 9)}
    requests = [(r, rnd.randint(1, 10), f"e{rnd.randint(1, 11)}", rnd.random() < .9) for r in range(1, 60)]
    assert settled(spark, held, requests) == simulate_profiles(held, requests)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """Each account takes the e-mail that the one after it gives up; all wait for the first request."""
    from seatplan.operators import releases
    rounds = []
    monkeypatch.setattr(releases, "_holders", lambda *a, real=releases._holders: rounds.append(1) or real(*a))
    n = 200
    held = {c: f"e{c}" for c in range(n)}
    chain = [(i + 1, n - 1 - i, f"e{n - i}", True) for i in range(n)]
    assert settled(spark, held, chain) == simulate_profiles(held, chain) == dict.fromkeys(range(1, n + 1), True)
    assert len(rounds) <= 2
    # In a circle the earliest request finds its e-mail held, and so do all others.
    circle = [(i + 1, n - 1 - i, f"e{(n - i) % n}", True) for i in range(n)]
    assert settled(spark, held, circle) == simulate_profiles(held, circle)
    # Against the order nobody gets anything but the last.
    against = [(i + 1, i, f"e{i + 1}", True) for i in range(n)]
    assert settled(spark, held, against) == simulate_profiles(held, against)


def test_hot_email(spark):
    """One e-mail that all want: its holder leaves late, the next one stays."""
    held = {0: "hot", **{c: f"e{c}" for c in range(1, 300)}}
    requests = [(c, c, "hot", True) for c in range(1, 150)] + [(150, 0, "free", True)] + [
        (c + 1, c, "hot", c % 7 != 3) for c in range(150, 300)]
    assert settled(spark, held, requests) == simulate_profiles(held, requests)


def test_profiles_and_tables(spark):
    t = make_tables(spark, customers=[(c, f"N{c}", "1", f"n{c}@example.com", "secret", "customer") for c in (1, 2, 3)])
    updates = spark.createDataFrame([
        (5, 2, "N2", "1", "N1@example.com", ""),       # given up by request 3
        (3, 1, "N1", "1", "new@example.com", ""),
        (4, 3, "N3", "1", "n2@example.com", ""),       # still held then
        (6, 3, "N3", "1", "n2@example.com", ""),       # free since request 5
        (7, 9, "N9", "1", "other@example.com", ""),    # no such account: nothing changes
        (8, 1, "N1", "1", "OTHER@example.com", "")],
        "request_id long, customer_id long, name string, phone string, email string, password string")
    res = C.update_profiles(t, updates)
    assert {r["request_id"]: r["outcome"] for r in res.outcomes.collect()} == {
        3: "UPDATED", 4: "PROFILE_EMAIL_TAKEN", 5: "UPDATED", 6: "UPDATED", 7: "UPDATED", 8: "UPDATED"}
    assert {r["customer_id"]: r["email"] for r in res.tables.customers.collect()} == {
        1: "OTHER@example.com", 2: "N1@example.com", 3: "n2@example.com"}
