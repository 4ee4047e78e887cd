"""A common-prefix-aware distributed merge sort of byte strings.

Every task sorts its strings in runs of bounded size, cuts the runs at
splitters, and front-codes each piece: of a string only the bytes beyond its
common prefix with the one before are kept, with that prefix's length.  Pieces
go to the task of their range, where a loser tree merges them.  The tree
carries, for every head, its common prefix with the last string out; heads with
different prefix lengths are ordered by them alone, and equal ones are compared
from that length on, so no known prefix is compared again.  The merge also
yields the common prefix of every string with the one before it.

Splitters are strings of the input, so each range but the first starts with
one; a range is told the next one too and sees its right neighbour without any
exchange between ranges.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of strings sorted as one run, and aimed at for a range.
RUN_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
#: Ranges at least and at most, and sampled strings for each (splitters are picked on the driver).
LEAST_RANGES, MOST_RANGES, PER_RANGE = 48, 1024, 8
_HEAD = struct.Struct("<IIqqI")

Item = tuple[bytes, int, int, bytes]  # string, row, place, rest
Splitter = tuple[bytes, int, int]  # string, row, place


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are known to be common."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known:known + 64], b[known:known + 64]
        if x != y:
            m = min(len(x), len(y))
            x, y = x[:m], y[:m]
            if x == y:
                return known + m
            diff = int.from_bytes(x) ^ int.from_bytes(y)
            return known + m - (diff.bit_length() + 7) // 8
        known += 64
    return n


def front_coded(items: list[Item]) -> bytes:
    """Sorted items, each string without what it shares with the one before."""
    out, before = [], b""
    for key, row, at, rest in items:
        shared = common_prefix(before, key)
        out.append(_HEAD.pack(shared, len(key) - shared, row, at, len(rest)))
        out.append(key[shared:])
        out.append(rest)
        before = key
    return b"".join(out)


def _decoded(blob: bytes) -> Iterator[tuple[int, Item]]:
    """(prefix shared with the one before, item) of a front-coded piece."""
    place, key = 0, b""
    while place < len(blob):
        shared, more, row, at, n = _HEAD.unpack_from(blob, place)
        place += _HEAD.size
        key = key[:shared] + blob[place:place + more]
        rest = blob[place + more:place + more + n]
        place += more + n
        yield shared, (key, row, at, rest)


def merged(blobs: list[bytes]) -> Iterator[tuple[int, Item]]:
    """(prefix shared with the one before, item) of all pieces in order, by a loser tree."""
    runs = [_decoded(b) for b in blobs]
    k = 1 << max(0, len(runs) - 1).bit_length()
    heads: list[Item | None] = [None] * k
    shared = [0] * k  # with the last string out

    def advance(r: int) -> None:
        shared[r], heads[r] = next(runs[r], (0, None))

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before b's; the loser learns its prefix with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        h = common_prefix(x[0], y[0], shared[a])
        less = x[0][h:h + 1] < y[0][h:h + 1]
        if h == len(x[0]) == len(y[0]):
            less = x[1:3] < y[1:3]
        shared[b if less else a] = h
        return less

    for r in range(len(runs)):
        advance(r)
    losers = [0] * k
    # First round: play the tree from its leaves.
    winners = list(range(k))
    level = k
    while level > 1:
        level //= 2
        up = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            won = beats(a, b)
            losers[level + i] = b if won else a
            up.append(a if won else b)
        winners = up
    top = winners[0]
    while heads[top] is not None:
        yield shared[top], heads[top]
        advance(top)
        node = (top + k) // 2
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node //= 2


def _runs(splitters: list[Splitter]):
    """(string, row, place, rest) to front-coded pieces (range, blob)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Item] = []
        size = 0

        def cut() -> pa.RecordBatch:
            held.sort(key=lambda x: x[:3])
            pieces: dict[int, list[Item]] = {}
            for item in held:
                pieces.setdefault(bisect_right(splitters, item[:3]), []).append(item)
            return pa.record_batch({"range": pa.array(list(pieces), pa.int32()),
                                    "blob": pa.array([front_coded(p) for p in pieces.values()], pa.binary())})

        for batch in batches:
            for item in zip(*(batch.column(i).to_pylist() for i in range(4))):
                held.append(item)
                size += len(item[0]) + len(item[3])
                if size >= RUN_BYTES:
                    yield cut()
                    held, size = [], 0
        if held:
            yield cut()

    return run


def sorted_ranges(strings: DataFrame, read: Callable[[Iterator[tuple[int, Item]], Splitter | None, bool],
                                                     Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """``read`` over every range of the sorted ``strings`` (key, row, at, rest).

    ``strings`` should be a written table: it is read twice.  ``read`` gets
    the range's items in order, each with its common prefix with the one
    before (0 for the first), then the next range's first item (None at the
    end) and whether the range is the first; it yields rows of ``schema``.
    """
    size, n = strings.agg(F.coalesce(F.sum(F.length("key") + F.length("rest")), F.lit(0)),
                          F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-size // RANGE_BYTES)))
    # A hash sample of about PER_RANGE strings a range, whatever the number of strings.
    share = int(min(1.0, ranges * PER_RANGE / max(1, n)) * (1 << 40))
    drawn = strings.select("key", "row", "at").filter(
        F.pmod(F.xxhash64("row", "at"), F.lit(1 << 40)) < F.lit(share))
    sample = sorted((bytes(r["key"]), r["row"], r["at"]) for r in drawn.collect())
    splitters = [sample[i] for i in sorted({len(sample) * i // ranges for i in range(1, ranges)})] if sample else []
    del sample
    pieces = strings.select("key", "row", "at", "rest").mapInArrow(_runs(splitters), "range int, blob binary")

    def work(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        following = splitters[k] if k < len(splitters) else None
        rows = list(read(merged([b.as_py() for b in table["blob"]]), following, k == 0))
        columns = zip(*rows) if rows else [[] for _ in schema]
        return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    names = {pa.int64(): "long", pa.binary(): "binary"}
    return pieces.groupBy("range").applyInArrow(work, ", ".join(f"{f.name} {names[f.type]}" for f in schema))
