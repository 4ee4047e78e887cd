"""Who may take an e-mail when accounts change theirs in request order.

A request for an e-mail is granted when no other account holds it at that
moment, and a granted request gives up the e-mail that its account held before.
So a request may wait for another's outcome, that for a third's, and so on.

``settle_claims`` finds all outcomes in rounds of joins.  For each e-mail it
knows who holds it after the requests settled so far, and by a window over each
account's requests which request may give it up first (*release*).  Then at once

* every request made before that is refused (someone still holds the e-mail),
  however many there are;
* the first one after it is granted if the release was, and
* if the release is itself open, and the only one in question, the request has the
  same outcome: a link.  Links lead to earlier requests only, so they form
  chains (accounts that wait for each other in a circle end at the earliest of
  them, which is refused); pointer jumping takes every request to its chain's end.

The earliest open request can always be settled, so rounds end; their number
follows how often one e-mail changes hands, not the length of chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize

_LATE = 1 << 62


def _holders(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(ek, holder, since, release, release_state, next_after): who holds each
    e-mail after its settled requests, and the first request that may give it up."""
    moves = (claims.filter(F.col("effect") & F.col("state").isin("open", "granted"))
             .select("customer_id", "at", "ek", "state")
             .unionByName(held.select("customer_id", F.lit(0).cast("long").alias("at"), "ek", F.lit("granted").alias("state"))))
    order = Window.partitionBy("customer_id").orderBy("at")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    seq = moves.withColumn("_before", F.lag("ek").over(order)).withColumn("_next", F.lead("at").over(order))
    # The first row after a run of one e-mail asks for another one.
    change = F.when((F.col("at") > 0) & (F.col("_before") != F.col("ek")), F.struct("at", "state", "_next"))
    seq = seq.withColumn("_change", change).withColumn("_release", F.first("_change", ignorenulls=True).over(later))
    granted = seq.filter("state = 'granted'").withColumnRenamed("customer_id", "holder")
    latest = granted.groupBy("ek").agg(F.max("at").alias("since"))
    return granted.join(latest, "ek").filter(F.col("at") == F.col("since")).select(
        "ek", "holder", "since", F.coalesce("_release.at", F.lit(_LATE)).alias("release"),
        F.col("_release.state").alias("release_state"), F.coalesce("_release._next", F.lit(_LATE)).alias("next_after"))


def _jumped(links: DataFrame) -> DataFrame:
    """(at, end): every link followed to its chain's end."""
    now = materialize(links.select("at", F.col("to").alias("end")))
    while True:
        further = now.select(F.col("at").alias("end"), F.col("end").alias("_further"))
        now = materialize(now.join(further.hint("merge"), "end", "left").select(
            "at", F.coalesce("_further", "end").alias("end"), F.col("_further").isNotNull().alias("_moved")))
        if now.filter("_moved").isEmpty():
            return now.select("at", "end")
        now = now.drop("_moved")


def settle_claims(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(at, granted) of every row of ``claims``.

    ``claims``: ``at`` (place in request order, from 1, unique), ``customer_id``, ``ek``
    (the e-mail's key) and ``effect``: whether a granted request changes the
    account (false for accounts that do not exist and for values the table
    refuses).  ``held``: (customer_id, ek) of every account.
    """
    keys = claims.select("ek").distinct()
    asking = claims.select("customer_id").distinct()
    held = held.join(keys, "ek", "left_semi").unionByName(held.join(asking, "customer_id", "left_semi"))
    # The rounds join numbers in place of collated texts.
    numbers = materialize(claims.select("ek").unionByName(held.select("ek")).distinct()
                          .withColumn("_number", F.monotonically_increasing_id()))

    def by_number(rows: DataFrame) -> DataFrame:
        return rows.join(numbers, "ek", "left").drop("ek").withColumnRenamed("_number", "ek")
    held = materialize(by_number(held).distinct())
    claims = materialize(by_number(claims).select("at", "customer_id", "ek", "effect", F.lit("open").alias("state")))
    while True:
        open_ = claims.filter("state = 'open'").drop("state")
        if open_.isEmpty():
            return claims.select("at", (F.col("state") == "granted").alias("granted"))
        holders = materialize(_holders(claims, held).join(open_.select("ek").distinct(), "ek", "left_semi"))
        # Of several holders (accounts that shared an e-mail before) the one that stays longest counts.
        top = holders.groupBy("ek").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.struct("release", "holder")).alias("top"),
            F.count_if(F.col("release_state") == "open").alias("n_open"),
            F.max("release_state").alias("release_state"), F.max("next_after").alias("next_after"))
        second = (holders.join(top.filter("n > 1").select("ek", F.col("top.holder").alias("_top")), "ek")
                  .filter("holder <> _top").groupBy("ek").agg(F.max("release").alias("second")))
        own = holders.select("ek", F.col("holder").alias("customer_id"), F.col("release").alias("own_release"),
                             (F.col("release_state") == "open").alias("own_open"))
        seen = (open_.join(top, "ek", "left").join(second, "ek", "left").join(own, ["ek", "customer_id"], "left"))
        is_own = F.col("own_release").isNotNull()
        others = F.coalesce("n", F.lit(0)) - is_own.cast("int")
        stays = F.when(F.col("top.holder") == F.col("customer_id"), F.coalesce("second", F.lit(0))) \
            .otherwise(F.coalesce("top.release", F.lit(0)))
        waiting = F.coalesce("n_open", F.lit(0)) - F.coalesce(F.col("own_open"), F.lit(False)).cast("int")
        # A holder who may have left and comes back: requests in between are settled first.
        back = F.col("effect") & F.coalesce(F.col("own_open") & (F.col("at") > F.col("own_release")), F.lit(False))
        seen = materialize(seen.select(
            "at", "customer_id", "ek", "effect", ((others > 0) & (F.col("at") < stays)).alias("refused"),
            (is_own & (others == 0) & (F.col("at") < F.col("own_release"))).alias("keeps"),
            (((others == 0) | (waiting == 0)) & ~back).alias("free"),
            # One other holder, whose open release is the only one before this request.
            F.when((others == 1) & (F.col("n") == 1) & (F.col("release_state") == "open")
                   & (F.col("next_after") > F.col("at")), F.col("top.release")).alias("to")))
        first = (seen.filter(F.col("effect") & ~F.col("refused") & ~F.col("keeps")).groupBy("ek")
                 .agg(F.min("at").alias("first")))
        front = F.col("first").isNull() | (F.col("at") <= F.col("first"))
        judged = materialize(seen.join(first, "ek", "left").select(
            "at", F.when(F.col("refused"), "refused").when(F.col("keeps") | (front & F.col("free")), "granted").alias("now"),
            F.when(~F.col("refused") & ~F.col("keeps") & front & ~F.col("free"), F.col("to")).alias("to")))
        links = judged.filter("now IS NULL AND to IS NOT NULL")
        known = judged.filter("now IS NOT NULL").select("at", "now")
        if not links.isEmpty():
            ends = _jumped(links)
            known = known.unionByName(ends.join(known.withColumnRenamed("at", "end"), "end").select("at", "now"))
        claims = materialize(claims.join(known, "at", "left").select(
            "at", "customer_id", "ek", "effect", F.coalesce("now", "state").alias("state")))
