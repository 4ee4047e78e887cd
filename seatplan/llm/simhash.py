"""SimHash near-dedup with pigeonring filtering.

Fingerprints are 64 bits over shingles of words (ASCII letters lower-cased,
words are runs of ``[^\\x20\\x09-\\x0D]``, repeats count); bit i is 1 when it
is set in over half of the shingles' XXH64 values (seed 42).

Two fingerprints link when at most ``max_bits`` bits differ.  Candidates come
from the pigeonring principle: the 64 bits are a ring of ``segments`` equal
segments, and if at most t bits differ, some chain of consecutive segments
keeps, for every length l, the sum of its first l differences within
l * t / segments.  The first segments of such a chain have a budget below one
bit, so they are equal: they are the join key.  Every pair that meets in a
key's bucket must then pass the whole chain before its full Hamming distance is
taken.  With t = 2 and 8 segments the key has 3 segments (24 bits).

Buckets are compared in blocks inside a task, which gives a spanning forest of
the links it found, never all pairs; no connection is lost.  Buckets of more than ``bucket_rows`` fingerprints are
dealt out anew by the pigeonhole principle: the bits outside the key fall
into t + 1 parts, of which a linked pair shares at least one.

Components are found on distinct fingerprints by alternating large-star and
small-star steps, checkpointed each round; links never reach the driver.

Defined results: null or wordless text has fingerprint 0, linked like any
other; fewer words than a shingle make one shingle of the whole sequence;
repeated rows share fingerprint and component; null ids take part but name a
component only if it has no other id; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatplan.plans.lineage import materialize
from seatplan.plans.numbering import fresh_name, keyed_rows

SEED = 42
SEGMENTS = 8
#: Fingerprints compared in one bucket; larger buckets are dealt out anew.
BUCKET_ROWS = 4096


def fingerprint(text: bytes | None, width: int) -> int:
    """64-bit SimHash of UTF-8 ``text`` over shingles of ``width`` words."""
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    stops = ends[min(width, len(words)) - 1:] - 1
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = [hash64(joined[a:b], SEED) for a, b in
                zip(starts[i:min(n, i + 65536)].tolist(), stops[i:i + 65536].tolist())]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(0)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.record_batch({"row": batch.column(1), "doc_id": batch.column(2), "fp": pa.array(signed)})
    return run


def row_fingerprints(keyed: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, fp) of every row: its key ``_row``, its id, its fingerprint as a signed long."""
    rows = keyed.select(F.col("text").cast("string").cast("binary").alias("text"),
                        F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(_fingerprints(width), "row struct<file string, at long>, doc_id long, fp long")


def _ring(segments: int, t: int) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Per start on the ring: the key's mask, and (mask, budget) of the longer chains.

    Of chains with one budget only the longest is listed: it holds the others.
    """
    bits = 64 // segments
    key_len = next(n for n in range(1, segments + 1) if (n + 1) * t // segments >= 1 or n == segments)
    keys, chains = [], []
    for start in range(segments):
        mask, grown = 0, {}
        for n in range(segments):
            mask |= ((1 << bits) - 1) << (start + n) % segments * bits
            if n < key_len:
                key = mask
            else:
                grown[(n + 1) * t // segments] = mask
        keys.append(key)
        chains.append([(m, b) for b, m in grown.items()])
    return keys, chains


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pass(diff: np.ndarray, chain: list[tuple[int, int]], t: int) -> np.ndarray:
    """Places in ``diff`` that keep every budget of the chain, then the Hamming bound."""
    at = np.arange(len(diff))
    for mask, budget in [*chain, ((1 << 64) - 1, t)]:
        at = at[np.bitwise_count(diff[at] & np.uint64(mask)) <= budget]
    return at


def _links_in(start: np.ndarray, bucket: np.ndarray, fps: np.ndarray, chains, t: int) -> Iterator[tuple]:
    """Index pairs that link, in rows sorted by bucket (``bucket`` numbers them)."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.append(first, len(bucket)))
    size_at = np.repeat(sizes, sizes)
    small = size_at <= 32
    for gap in range(1, 32):  # all pairs of small buckets, by their distance in the rows
        i = np.flatnonzero(small[:-gap] & (bucket[:-gap] == bucket[gap:])) if gap < len(fps) else []
        if not len(i):
            break
        diff = fps[i] ^ fps[i + gap]
        for s in np.unique(start[i]).tolist():
            own = np.flatnonzero(start[i] == s)
            ok = i[own[_pass(diff[own], chains[s], t)]]
            yield ok, ok + gap
    block = 512
    for f, n in zip(first[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        for a in range(f, f + n, block):
            for b in range(a, f + n, block):
                x = fps[a:min(a + block, f + n), None] ^ fps[None, b:min(b + block, f + n)]
                at = _pass(x.ravel(), chains[int(start[f])], t)
                i, j = np.divmod(at, x.shape[1])
                i, j = i + a, j + b
                yield i[i < j], j[i < j]


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """The links of a spanning forest of ``pairs`` over 0..n-1."""
    root = list(range(n))
    kept = []
    for left, right in pairs:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = i, j
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((i, j))
    return kept


def _bucket_links(segments: int, t: int):
    """Rows (start, tag, key, fp) sorted by (tag, key) to links (a, b); a bucket
    that goes on in the next batch waits for it."""
    _, chains = _ring(segments, t)

    def work(table: pa.Table) -> pa.RecordBatch:
        start, tag, key = (table[c].to_numpy() for c in ("start", "tag", "key"))
        fps = table["fp"].to_numpy().view(np.uint64)
        change = (tag[1:] != tag[:-1]) | (key[1:] != key[:-1])
        bucket = np.concatenate(([0], np.cumsum(change)))
        known, number = np.unique(fps, return_inverse=True)
        pairs = ((number[i], number[j]) for i, j in _links_in(start, bucket, fps, chains, t))
        ends = np.array(_forest(len(known), pairs), np.int64).reshape(-1, 2)
        return pa.record_batch({"a": pa.array(known[ends[:, 0]].view(np.int64)),
                                "b": pa.array(known[ends[:, 1]].view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tag, key = held["tag"].to_numpy(), held["key"].to_numpy()
            inner = np.flatnonzero((tag != tag[-1]) | (key != key[-1]))
            if len(inner) > 50_000:
                yield work(held.slice(0, int(inner[-1]) + 1))
                held = held.slice(int(inner[-1]) + 1)
        if held is not None and held.num_rows:
            yield work(held)

    return run


def links(fps: DataFrame, max_bits: int, segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that connect what
    ``max_bits`` or fewer bits connect; a spanning forest of every task's links."""
    t = max_bits
    if segments <= t or 64 % segments:
        raise ValueError("segments must divide 64 and exceed max_bits")
    masks, _ = _ring(segments, t)
    used = F.element_at(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), F.col("start") + 1)
    level = (fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("start"))
             .withColumn("tag", F.col("start").cast("long")).withColumn("used", used)
             .withColumn("key", F.col("fp").bitwiseAND(F.col("used"))))
    out, digit = None, 1
    while True:
        sizes = level.groupBy("tag", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = materialize(level.join(sizes, ["tag", "key"]))
        # Keys longer by every digit leave so few bits free that a bucket is small by nature.
        last = digit >= 64
        whole = shared if last else shared.filter(F.col("n") <= bucket_rows)
        found = (whole.select("start", "tag", "key", "fp").repartition("tag", "key")
                 .sortWithinPartitions("tag", "key", "fp")
                 .mapInArrow(_bucket_links(segments, t), "a long, b long"))
        out = found if out is None else out.union(found)
        large = shared.filter(F.col("n") > bucket_rows)
        if last or large.isEmpty():
            return out.distinct()
        level = _dealt_anew(large, t, digit)
        digit *= t + 1


def _dealt_anew(large: DataFrame, t: int, digit: int) -> DataFrame:
    """Rows of too large buckets under longer keys.

    The bits fall into t + 1 parts by one digit (base t + 1) of their place;
    each part in turn joins the key.  t differing bits leave one part equal.
    """
    parts = [sum(1 << i for i in range(64) if i // digit % (t + 1) == k) for k in range(t + 1)]
    more = F.element_at(F.array(*[F.lit(_signed(p)).cast("long") for p in parts]), F.col("part") + 1)
    return (large.select("fp", "start", "tag", "used", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("part"))
            .select("fp", "start", (F.col("tag") * 64 + F.col("part") + 1).alias("tag"),
                    F.col("used").bitwiseOR(more).alias("used"))
            .withColumn("key", F.col("fp").bitwiseAND(F.col("used"))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) but the roots, with the smallest node it reaches.

    Alternates large-star and small-star steps until the edges stay; every
    round is checkpointed, so lineage stays short.
    """
    now = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    mark = None
    while True:
        now = materialize(_star(_star(now, True), False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)


def near_groups(docs: DataFrame, width: int, max_bits: int, segments: int = SEGMENTS,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: row, doc_id, fingerprint, component_id, stays.

    ``component_id`` is the smallest doc_id that links reach, itself included;
    ``stays`` marks one row of each component, of the smallest doc_id.
    """
    # One read of the table, checkpointed with its numbers.
    number = F.struct(F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return _groups(docs.select("doc_id", "text", number.alias("_row")), width, max_bits, segments, bucket_rows)


def _groups(keyed: DataFrame, width: int, max_bits: int, segments: int, bucket_rows: int) -> DataFrame:
    rows = materialize(row_fingerprints(keyed, width))
    edges = links(rows.select("fp").distinct(), max_bits, segments, bucket_rows)
    roots = components(edges)
    placed = (rows.join(roots, rows["fp"] == roots["node"], "left")
              .select("row", "doc_id", "fp", F.coalesce("root", "fp").alias("root")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    # Checkpointed, so that the join deals out both sides itself and can split a hot group.
    groups = materialize(placed.groupBy("root").agg(best))
    return (placed.join(groups, "root")
            .select("row", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.col("best.doc_id").alias("component_id"),
                    (F.col("row") == F.col("best.row")).alias("stays")))


def keep_one_each(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each component."""
    key = fresh_name(docs, "_row")
    keyed = keyed_rows(docs, key)
    groups = _groups(keyed.select("doc_id", "text", F.col(key).alias("_row")), width, max_bits, SEGMENTS, BUCKET_ROWS)
    stay = groups.filter("stays").select(F.col("row").alias(key))
    return keyed.join(stay, key, "left_semi").drop(key)
