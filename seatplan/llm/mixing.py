"""Mixing sources to target weights by Efraimidis-Spirakis keys (DataFrame functions only).

Every document gets the key ``-ln(u) / weight`` (``u`` uniform from a hash of
its id, ``weight`` its quality weight); the smallest keys of a source are its
weighted sample without replacement.  Sizes are prefix-summed in key order up
to each source's budget.  A target of r times the source's size gives every
document floor(r) complete epochs, and only the fraction left is sampled.

No source is sorted in one task: keys fall into ``buckets`` ranges of equal
probability, sizes are summed per (source, range) with map-side combine, and
only the range in which the budget ends is ranked.  What reaches the documents
is one threshold row per source.  Texts are scanned once for their sizes; the
sampling moves narrow rows.

Defined results: a null text has size 0; a null source is a source of its own
and the last; rows that repeat a ``doc_id`` share a key and come one after the
other; null or non-positive weights count as 1; a source without words is taken
once; an empty table gives an empty result; a corpus without words has targets
of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize
from seatplan.plans.numbering import fresh_name, keyed_rows

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 8192
#: No document is taken more often than this.
MAX_EPOCHS = 3
#: One threshold row per source is broadcast up to this many sources; beyond it Spark joins by shuffle.
BROADCAST_SOURCES = 20_000


def measured(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, source, size, weight) of every document, checkpointed.

    The one scan of the texts; all that follows moves these narrow rows.
    ``labels`` (doc_id, quality) covers some documents: quality 1 weighs 2,
    quality 0 weighs 0.5, no label 1; of several labels of an id the highest
    counts.
    """
    # One read of the table, checkpointed with its numbers.
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return _measured(docs.select("doc_id", "text", "source", number.alias("_row")), labels)


def _measured(keyed: DataFrame, labels: DataFrame | None) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    narrow = keyed.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    if labels is None:
        return materialize(narrow.withColumn("weight", F.lit(1.0)))
    best = labels.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_label"))
    weight = F.when(F.col("_label") == 1, 2.0).when(F.col("_label") == 0, 0.5).otherwise(1.0)
    return materialize(narrow.join(best, narrow["doc_id"] == best["_labelled"], "left")
                       .withColumn("weight", weight).drop("_labelled", "_label"))


def _keyed(rows: DataFrame, seed: str, buckets: int) -> DataFrame:
    """``rows`` with its sampling key's range and its place in key order."""
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), text_id)), 1, 13)
    u = (F.conv(hexes, 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    key = -F.log(u) / F.when(w > 0, w).otherwise(1.0)
    # 1 - exp(-key) grows with the key and is uniform at weight 1.
    bucket = F.least(F.lit(buckets - 1), F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * buckets)).cast("int")
    return (rows.withColumn("_key", key).withColumn("_bucket", bucket)
            .withColumn("_order", F.struct("_key", F.coalesce("doc_id", F.lit(-2 ** 63)).alias("_id"), "size", "row")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3),
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of sources: (source, source_size) -> plus target, by water-filling.

    Sources in code-point order (null last) get ``weights`` in turn; targets
    share the total by weight, stop at ``max_epochs`` times the source's size,
    and the excess is shared again by weight until none is above.  The capped
    sources are those with the smallest cap / weight, so one pass over the
    sources in that order finds them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    big = "decimal(38,0)"
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long"))
    capped = weighted.withColumn("_cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().orderBy(F.lit(0)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (capped.withColumn("_total", F.sum("source_size").over(whole))
              .withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
              .withColumn("_ws", F.sum("_w").over(onward)))
    at_cap = (F.col("_cap").cast(big) * F.col("_ws").cast("decimal(12,0)")
              <= (F.col("_total") - F.col("_caps")).cast(big) * F.col("_w").cast("decimal(12,0)"))
    marked = filled.withColumn("_at_cap", at_cap)
    rest = F.when(F.col("_at_cap"), None)
    shared = (marked.withColumn("_left", F.col("_total") - F.coalesce(
                  F.sum(F.when(F.col("_at_cap"), F.col("_cap"))).over(whole), F.lit(0)))
              .withColumn("_left_w", F.sum(rest.otherwise(F.col("_w"))).over(whole)))
    target = F.when(F.col("_at_cap"), F.col("_cap").cast("double")).otherwise(
        (F.col("_left") * F.col("_w")).cast("double") / F.col("_left_w").cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def mix_sources(rows: DataFrame, seed: str = "mix", buckets: int = BUCKETS,
                weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``rows`` of :func:`measured` plus ``source_size, target, copies``.

    ``copies`` is how often the mix takes the row (0 to ``MAX_EPOCHS``).
    """
    keyed = _keyed(rows, seed, buckets)
    in_range = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    totals = in_range.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = (source_targets(totals, weights)
               .withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.lit(MAX_EPOCHS), F.floor(
                   F.col("target") / F.col("source_size")))).otherwise(1).cast("int"))
               .withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size")))
    # The range of keys in which a source's budget ends.
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = in_range.withColumn("_start", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    t = targets.withColumnRenamed("source", "_s")
    cuts = materialize(
        start.join(t, start["source"].eqNullSafe(t["_s"])).filter("_start <= _budget")
        .groupBy("source", "source_size", "target", "_epochs", "_budget")
        .agg(F.max(F.struct("_bucket", "_start")).alias("_end"))
        .select("source", "source_size", "target", "_epochs", "_budget",
                F.col("_end._bucket").alias("_cut"), F.col("_end._start").alias("_start")))
    # Rank only the documents of that range.
    c = _small(cuts.select(F.col("source").alias("_s"), "_cut", "_start", "_budget"))
    inside = keyed.join(c, keyed["source"].eqNullSafe(c["_s"]) & (keyed["_bucket"] == c["_cut"]))
    ranked = Window.partitionBy("source").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    middle = (F.col("_start") + F.coalesce(F.sum("size").over(ranked), F.lit(0))) * 2 + F.col("size")
    last = (inside.withColumn("_middle", middle).filter(F.col("_middle") <= 2 * F.col("_budget"))
            .groupBy("source").agg(F.max("_order").alias("_last")).withColumnRenamed("source", "_t"))
    plan = _small(materialize(
        cuts.join(last, cuts["source"].eqNullSafe(last["_t"]), "left")
        .select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_cut", "_last")))
    got = keyed.join(plan, keyed["source"].eqNullSafe(plan["_s"]), "left")
    sampled = (F.col("_bucket") < F.col("_cut")) | (
        (F.col("_bucket") == F.col("_cut")) & F.col("_last").isNotNull() & (F.col("_order") <= F.col("_last")))
    copies = F.least(F.lit(MAX_EPOCHS), F.col("_epochs") + F.coalesce(sampled, F.lit(False)).cast("int"))
    return got.select("row", "doc_id", "source", "size", "weight", "source_size", "target", copies.alias("copies"))


def _small(per_source: DataFrame) -> DataFrame:
    """Checkpointed rows, one per source: broadcast only when their count is proven small."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def mixed_rows(docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    key, copy = fresh_name(docs, "_row"), fresh_name(docs, "_copy")
    keyed = keyed_rows(docs, key)
    rows = _measured(keyed.select("doc_id", "text", "source", F.col(key).alias("_row")), labels)
    taken = (mix_sources(rows, seed).filter("copies > 0")
             .select(F.col("row").alias(key), F.explode(F.sequence(F.lit(1), "copies")).alias(copy)))
    return keyed.join(taken, key).drop(key, copy)
