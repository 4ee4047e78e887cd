"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is normalised by deleting every character of ``[\\x20\\x09-\\x0D]``,
cut into content-defined chunks, and described by its *recipe*: the ordered
list of its chunks' identifiers.  Chunks are deduplicated once over the whole
table, which verifies each identifier (an identifier that stands for two
different chunk texts gets ordinals).  Texts are equal exactly when their
verified lists are equal, so whole documents are never compared or moved
again: later steps carry lists of 8-byte identifiers.

Defined results: a null text counts as empty; all empty texts form one group;
rows with a null ``doc_id`` take part and lose ties; of rows that repeat a
``doc_id`` and its text exactly one is kept; empty tables give empty results;
other columns of the input are ignored (:func:`exact_groups`) or carried
(:func:`drop_duplicates`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize, written
from seatplan.plans.numbering import fresh_name, keyed_rows

WHITE = r"[\x20\x09-\x0D]+"
#: Chunk sizes in characters; a chunk ends at the first sentence mark past the minimum,
#: where there is none at the first of BREAKS (a few characters of every script), else at the maximum.
MIN_CHUNK, MAX_CHUNK = 256, 2048
SENTENCE_MARKS = "[.!?;:。！？।]"
BREAKS = "[0Uz\u03b8\u0431\u0448\u0628\u0924\u0e2d\u3042\u30a2\u4e00-\u4f2f\uac00-\uad50]"
#: Colliding identifiers are broadcast only up to this many rows; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 10_000


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def chunks_of(norm, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK):
    """Content-defined chunks of a column; their concatenation is the column."""
    some = f".{{{min_chunk},{max_chunk - 1}}}?"
    cut = f"(?s){some}{SENTENCE_MARKS}|{some}{BREAKS}|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(cut), F.lit(0))


def _recipes(keyed: DataFrame, min_chunk: int, max_chunk: int) -> DataFrame:
    """One written row per document: keys, digest, chunks and unverified identifiers."""
    norm = keyed.select(
        "_row",
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text"), F.lit(0)).alias("_points"),
        normalised(F.col("text")).alias("_norm"))
    cut = norm.select("_row", "doc_id", "_points", F.sha2("_norm", 256).alias("text_sha256"),
                      chunks_of(F.col("_norm"), min_chunk, max_chunk).alias("_chunks"))
    return written(cut.withColumn("_recipe", F.transform("_chunks", lambda c: F.xxhash64(c))),
                   "chunk-recipes")


def _bounded(rows: DataFrame) -> DataFrame:
    """Checkpointed rows, broadcast only when a count proves them few."""
    kept = materialize(rows)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _collided_ids(recipes: DataFrame) -> DataFrame:
    """Identifiers that stand for several chunk texts.

    Every chunk text is moved once (after map-side combine of its copies);
    the second grouping moves identifiers alone.
    """
    distinct = (recipes.select(F.explode("_chunks").alias("_chunk"))
                .groupBy(F.xxhash64("_chunk").alias("_id"), "_chunk").agg(F.count(F.lit(1)).alias("_n")))
    return (distinct.groupBy("_id").agg(F.count(F.lit(1)).alias("_texts"))
            .filter("_texts > 1").select("_id"))


def _fixes(recipes: DataFrame, collided: DataFrame) -> DataFrame:
    """(row, [(place, ordinal)]) for the chunks of collided identifiers: the
    ordinal of a chunk's text among the texts of its identifier."""
    placed = (recipes.select("_row", F.posexplode("_chunks").alias("_at", "_chunk"))
              .withColumn("_id", F.xxhash64("_chunk")).join(_bounded(collided), "_id"))
    texts = (placed.select("_id", "_chunk").distinct()
             .withColumn("_ordinal", F.row_number().over(Window.partitionBy("_id").orderBy("_chunk"))))
    return (placed.join(_bounded(texts), ["_id", "_chunk"])
            .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
                F.col("_at").cast("long").alias("at"), F.col("_ordinal").cast("long").alias("n")))).alias("_fix")))


def exact_groups(docs: DataFrame, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text
    stays, then the smallest ``doc_id``; ``keep_id`` is that row's id.
    """
    # One read of the table, whose result is written with its numbers.
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return _groups(docs.select("doc_id", "text", number.alias("_row")), min_chunk, max_chunk).drop("_row")


def _groups(keyed: DataFrame, min_chunk: int, max_chunk: int) -> DataFrame:
    """:func:`exact_groups` of rows with a key ``_row``, which is returned too."""
    recipes = _recipes(keyed, min_chunk, max_chunk)
    collided = materialize(_collided_ids(recipes))
    rows = recipes.select("_row", "doc_id", "_points", "text_sha256", "_recipe")
    if collided.isEmpty():
        verified = rows.select("_row", "doc_id", "_points", "text_sha256", F.array("_recipe").alias("_ids"))
    else:
        flat = F.flatten(F.transform("_fix", lambda x: F.array(x["at"], x["n"])))
        verified = rows.join(_fixes(recipes, collided), "_row", "left").select(
            "_row", "doc_id", "_points", "text_sha256",
            F.when(F.col("_fix").isNull(), F.array("_recipe")).otherwise(F.array(F.col("_recipe"), flat)).alias("_ids"))
    best = F.min(F.struct((-F.col("_points")).alias("_few"), F.col("doc_id").isNull().alias("_none"), "doc_id", "_row"))
    groups = (verified.groupBy("_ids").agg(F.count(F.lit(1)).alias("group_size"), best.alias("_best"))
              .filter("group_size > 1"))
    # Checkpointed, so that the join deals out both sides itself and can split a hot group.
    groups = materialize(groups)
    return (verified.join(groups, "_ids", "left")
            .select("doc_id",
                    F.when(F.col("_best").isNull(), F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("_best").isNull() | (F.col("_row") == F.col("_best._row"))).alias("kept"),
                    "text_sha256", "_row"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, in any order."""
    key = fresh_name(docs, "_row")
    keyed = keyed_rows(docs, key)
    stay = _groups(keyed.select("doc_id", "text", F.col(key).alias("_row")), MIN_CHUNK, MAX_CHUNK).filter("kept")
    return keyed.join(stay.select(F.col("_row").alias(key)), key, "left_semi").drop(key)
