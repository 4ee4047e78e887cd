"""Token counts by separator scan over flat token files.

A token file is a flat run of 16-bit ids (little endian): documents end to
end, each closed by the end-of-document id, without an index.  It is read in
blocks that start and end anywhere.  In each block one vectorised search finds
the separators, which gives the lengths of documents inside the block and the
open ends: tokens before the first separator and after the last.  A prefix
scan over the blocks' summaries gives every block the number of documents
before it and the tokens of the document still open at its start, which
stitches documents that run over blocks (any number of them).

The scan has two levels, so that no task sees all blocks of a long file:
prefix sums inside spans of ``SPAN`` blocks, then over the spans.

Defined results: an empty document counts 0 tokens; tokens after the last
separator of a file are an unfinished document, reported with ``closed`` false;
a null text is an empty document; repeated rows are documents of their own;
blocks that are null or empty hold no tokens; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seatplan.llm.bpe import Vocabulary

#: Tokens in a block of a file this module writes, and blocks in a span of the scan.
BLOCK_TOKENS = 1 << 16
SPAN = 512
ID = np.dtype("<u2")


def flat_files(docs: DataFrame, vocabulary: Vocabulary, eod: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, tokens, place, doc_ids): the documents of each partition as one flat token file.

    ``tokens`` alone is the file.  Beside it stand the ids of its documents, in
    their order from ``place`` on, which no count reads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = vocabulary.encoder(), TaskContext.get().partitionId()
        if max(eod, len(encoder.tokens)) > 0xFFFF:
            raise ValueError("ids don't fit into 16 bits")
        held, size, block, place = [], 0, 0, 0
        names: list[int | None] = []
        end = np.array([eod], ID)

        def cut(last: bool):
            nonlocal held, size, block, place
            flat = np.concatenate(held) if held else np.empty(0, ID)
            whole = len(flat) if last else len(flat) - len(flat) % block_tokens
            pieces = [flat[i:min(i + block_tokens, whole)].tobytes() for i in range(0, whole, block_tokens)]
            held, size = [flat[whole:]], len(flat) - whole
            if pieces:
                at, others = np.arange(block, block + len(pieces)), len(pieces) - 1
                yield pa.record_batch({"file": pa.array(np.full(len(pieces), file), pa.int64()),
                                       "block": pa.array(at, pa.int64()), "tokens": pa.array(pieces, pa.binary()),
                                       "place": pa.array([place, *[None] * others], pa.int64()),
                                       "doc_ids": pa.array([names, *[None] * others], pa.list_(pa.int64()))})
                block, place = block + len(pieces), place + len(names)
                names.clear()

        for batch in batches:
            for ids, doc_id in zip(encoder.encode_all([t or "" for t in batch.column(0).to_pylist()]), batch.column(1).to_pylist()):
                names.append(doc_id)
                held += [ids.astype(ID), end]
                size += len(ids) + 1
                if size >= 32 * block_tokens:
                    yield from cut(False)
        yield from cut(True)

    return docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long")).mapInArrow(
        run, "file long, block long, tokens binary, place long, doc_ids array<long>")


def named_counts(files: DataFrame, eod: int) -> DataFrame:
    """:func:`count_tokens` of written :func:`flat_files` with the ``doc_id`` of each document."""
    names = (files.select("file", "place", F.posexplode("doc_ids").alias("at", "doc_id"))
             .select("file", (F.col("place") + F.col("at")).alias("doc"), "doc_id"))
    return (count_tokens(files, eod).join(names, ["file", "doc"], "left")
            .select("doc_id", "n_tokens", "closed", "file", "doc"))


def _scan(eod: int):
    """Blocks to rows: length, separators, places of the first and last, lengths between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n, first, last, inside = [], [], [], [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_py() or b"", ID)
                at = np.flatnonzero(ids == eod)
                size.append(len(ids))
                n.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inside.append((np.diff(at) - 1).astype(np.int64))
            longs = {k: pa.array(v, pa.int64()) for k, v in
                     (("size", size), ("n", n), ("first", first), ("last", last))}
            yield pa.record_batch({"file": batch.column(0), "block": batch.column(1), **longs,
                                   "inside": pa.array(inside, pa.list_(pa.int64()))})
    return run


def _prefix(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """Prefix scan of (size, n, last): what lies before each row, as (start, docs, seen).

    ``start`` tokens and ``docs`` separators come before the row; ``seen`` is
    the place of the last separator before it (null: none yet).
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
              .withColumn("docs", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return placed.withColumn("seen", F.max(F.col("start") + F.col("last")).over(before))


def count_tokens(blocks: DataFrame, eod: int) -> DataFrame:
    """(file, doc, n_tokens, closed) of blocks (file, block, tokens); ``doc`` counts from 0 in its file.

    Blocks of a file are numbered in order (gaps are allowed).
    """
    scanned = (blocks.select("file", "block", "tokens").mapInArrow(
        _scan(eod), "file long, block long, size long, n long, first long, last long, inside array<long>")
        .withColumn("span", F.floor(F.col("block") / SPAN)))
    local = _prefix(scanned, ["file", "span"], "block")
    spans = local.groupBy("file", "span").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.col("start") + F.col("last")).alias("last"))
    above = _prefix(spans, ["file"], "span").select(
        "file", "span", F.col("start").alias("span_start"), F.col("docs").alias("span_docs"),
        F.col("seen").alias("span_seen"))
    placed = (local.join(above, ["file", "span"])
              .withColumn("seen", F.coalesce(F.col("span_start") + F.col("seen"), F.col("span_seen"), F.lit(-1)))
              .withColumn("start", F.col("span_start") + F.col("start"))
              .withColumn("docs", F.col("span_docs") + F.col("docs")))
    closing = F.array(F.col("start") + F.col("first") - F.col("seen") - 1)
    closed = (placed.filter("n > 0")
              .select("file", "docs", F.posexplode(F.concat(closing, "inside")).alias("at", "n_tokens"))
              .select("file", (F.col("docs") + F.col("at")).alias("doc"), "n_tokens", F.lit(True).alias("closed")))
    ends = above.withColumnRenamed("span_docs", "docs").join(
        spans.select("file", "span", "size", "n", "last"), ["file", "span"]).groupBy("file").agg(
        F.sum("n").alias("doc"), F.sum("size").alias("size"),
        F.max(F.col("span_start") + F.col("last")).alias("seen"))
    left = F.col("size") - F.coalesce("seen", F.lit(-1)) - 1
    return closed.union(ends.filter(left > 0).select("file", "doc", left.alias("n_tokens"), F.lit(False).alias("closed")))
