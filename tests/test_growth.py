"""What keeps profile checks and the integrity report in proportion to their input."""

import random

from seatplan.operators import releases
from seatplan.operators import validate as V
from sim import simulate_profiles
from support import make_tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def people(spark, n):
    return make_tables(spark, customers=[(c, f"N{c}", "1", f"n{c}@example.com", "secret", "customer")
                                         for c in range(1, n + 1)])


def test_row_checks_are_dealt_out_and_done_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(V, "materialize", lambda df, real=V.materialize: kept.append(plan_of(df)) or real(df))
    t = people(spark, 4)
    updates = spark.createDataFrame(
        [(1, 1, "N1", "1", "N2@Example.com ", "secret"), (2, 2, "N2", "1", "new@example.com", "short"),
         (3, 3, "N3", "", "n3@example.com", ""), (4, 4, "N4", "1", "no address", "")],
        "request_id long, customer_id long, name string, phone string, email string, password string")
    signups = updates.drop("customer_id").selectExpr("*", "'customer' AS role")
    for judge, want in ((lambda: V.validate_profile_updates(t, updates),
                         {1: "PROFILE_EMAIL_TAKEN", 2: "PROFILE_SHORT_PASSWORD", 3: "PROFILE_NAME_PHONE", 4: "BAD_EMAIL"}),
                        (lambda: V.validate_signups(t, signups),
                         {1: "EMAIL_TAKEN", 2: "SHORT_PASSWORD", 3: "NAME_PHONE", 4: "BAD_EMAIL"})):
        kept.clear()
        out = judge()
        assert {r["request_id"]: r["reason"] for r in out.collect()} == want
        assert len(kept) == 1 and "Repartition" in kept[0] and "octet_length" in kept[0]
        assert "octet_length" not in plan_of(out)


def test_rounds_join_numbers(spark, monkeypatch):
    types = []
    monkeypatch.setattr(releases, "_holders", lambda claims, held, real=releases._holders:
                        types.append((claims.schema["ek"].dataType.simpleString(),
                                      held.schema["ek"].dataType.simpleString())) or real(claims, held))
    rnd = random.Random(7)
    held = {c: f"e{c}" for c in range(1, 9)}
    requests = [(r, rnd.randint(1, 10), f"E{rnd.randint(1, 11)}", rnd.random() < .9) for r in range(1, 40)]
    claims = spark.createDataFrame([(r, c, k, fits and c in held) for r, c, k, fits in requests],
                                   "at long, customer_id long, ek string, effect boolean")
    collated = "*", "collate(ek, 'UNICODE_CI') AS folded"
    got = releases.settle_claims(
        claims.selectExpr(*collated).drop("ek").withColumnRenamed("folded", "ek"),
        spark.createDataFrame(list(held.items()), "customer_id long, ek string").selectExpr(*collated)
        .drop("ek").withColumnRenamed("folded", "ek"))
    want = simulate_profiles(held, [(r, c, k.lower(), fits) for r, c, k, fits in requests])
    assert {r["at"]: r["granted"] for r in got.collect()} == want
    assert types and set(types) == {("bigint", "bigint")}


def test_integrity_entries_are_small(spark):
    report = V.integrity_report(people(spark, 3))
    plan = plan_of(report)
    # No call per element, numbers for places, and no counter for each of the eight references.
    assert "lambdafunction" not in plan and "place#" in plan
    assert not any(f"AS r{i}#" in plan for i in range(4, 9))
    assert sum(r["violations"] for r in report.collect()) == 0
