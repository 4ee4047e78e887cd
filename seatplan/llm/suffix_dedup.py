"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts elsewhere too.

A full suffix array of a large corpus would move hundreds of bytes for every
byte of text.  The same answer comes from few suffixes:

1. *Cells.*  Each window of ``length`` bytes has an anchor: the k-gram of
   least hash near its start (winnowing), which depends on the window's bytes
   alone.  The windows of one anchor are a cell.  Equal windows have equal
   anchors, and so equal *cores* (the half window from the anchor on).  Cells
   whose core occurs once have no repeated window.
2. Cells that are equal as a whole are repeated as a whole.  One cell of each
   class stays to be compared with the core's other classes.
3. *Starts.*  Classes of one core are sorted by the text left of the anchor,
   backwards.  The common prefixes in that order tell where two cells part to
   the left; only suffixes from such places (and from the cell's start) can
   begin a repeated stretch.
4. *Suffixes* from those starts, to the end of the cell, are sorted; if the
   longest common prefix with a neighbour has ``length`` bytes or more, all of
   it is covered.

Both sorts are the distributed merge sort of :mod:`seatplan.llm.suffix_merge`
(front-coded runs, loser trees that carry common prefixes).  A range is read
alone: where a group of one core goes on beyond it, all places that its
neighbours there could add are taken as starts, which costs suffixes but no
exactness.  Matches never cross documents; both occurrences may be in one.

Equality of cells is by a 128-bit hash within equal 64-bit cores; all other
decisions compare the bytes.

Defined results: a null text is empty (0 bytes, nothing removed); texts below
``length`` bytes stay whole; repeated rows are occurrences of each other; long
texts are taken in segments, as a whole; an empty table gives an empty result;
other columns are ignored.  The input must read the same rows in the same order
each time (a table, a checkpoint): rows are numbered by partition and position.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatplan.llm.suffix_merge import Item, Splitter, common_prefix, sorted_ranges
from seatplan.plans.lineage import materialize, written

LENGTH = 400
#: Parts of a class of equal cells in the join that marks them.
SALTS = 16
_SEGMENT = 1 << 20  # bytes handled at once
#: A cell: hashes of its core and of the whole (two halves), anchor, first window, past the last window.
_CELL = ("core", "cell", "half", "p", "s", "e")
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _shape(length: int) -> tuple[int, int, int]:
    """(bytes of a core, of a k-gram, k-grams that a window's anchor is chosen from)."""
    core = max(1, length // 2)
    k = min(8, max(1, length // 4))
    return core, k, max(1, length - core - k + 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, _MAX)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _cells(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, past the last window) of the cells of texts laid end to end.

    ``ends`` holds, for every byte, where its text ends.
    """
    _, k, width = _shape(length)
    if len(flat) < length:
        return (np.empty(0, np.int64),) * 3
    grams = np.zeros(len(flat) - k + 1, np.uint64)
    for j in range(k):
        grams = grams << np.uint64(8) | flat[j:len(grams) + j]
    grams = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    grams = (grams ^ grams >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    # The upper half orders the k-grams, the lower half holds the place: the first of equals wins.
    keyed = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    starts = np.arange(len(flat) - length + 1)
    anchor = (_least(keyed, width)[:len(starts)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = starts[starts + length <= ends[:len(starts)]]
    if not len(windows):
        return (np.empty(0, np.int64),) * 3
    a = anchor[windows]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (windows[1:] != windows[:-1] + 1)
                                           | (ends[windows[1:]] != ends[windows[:-1]]))))
    last = np.append(first[1:], len(windows)) - 1
    return a[first], windows[first], windows[last] + 1


def _pieces(texts: list[bytes], length: int, segment: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset in the text, bytes) of bounded size; pieces of a long text overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), segment):
            piece = t[at:at + segment + length - 1]
            group.append((i, at, piece))
            size += len(piece)
            if size >= segment:
                yield group
                group, size = [], 0
    if group:
        yield group


def _cells_of(length: int):
    core, _, _ = _shape(length)
    segment = _SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64, hash128 = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(0)]
            found: list[list[list]] = [[[] for _ in texts] for _ in range(6)]
            for group in _pieces(texts, length, segment):
                raw = b"".join([p for _, _, p in group])
                sizes = np.array([len(p) for _, _, p in group])
                stops = np.cumsum(sizes)
                owner = np.repeat(np.arange(len(group)), sizes)
                cells = _cells(np.frombuffer(raw, np.uint8), stops[owner], length)
                shift = np.array([at for _, at, _ in group]) - (stops - sizes)
                which = owner[cells[1]] if len(cells[1]) else owner[:0]
                for g, p, s, e in zip(which.tolist(), *(c.tolist() for c in cells)):
                    i, move = group[g][0], int(shift[g])
                    cell = hash128(raw[s:e - 1 + length], seed=p - s)
                    for column, v in zip(found, (
                            hash64(raw[p:p + core]), cell >> 64, cell & (1 << 64) - 1, p + move, s + move, e + move)):
                        column[i].append(v)
            n = np.array([len(x) for x in found[0]])
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            lists = []
            for j, column in enumerate(found):
                flat = np.array([v for x in column for v in x], np.uint64 if j < 3 else np.int64).view(np.int64)
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
            yield pa.record_batch({"row": batch.column(1), **dict(zip(_CELL, lists))})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text binary, ...) with the text compressed, for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = pa.array([pack.compress(t.as_py() or b"") for t in batch.column(0)], pa.binary())
        yield pa.record_batch([text, *batch.columns[1:]], names=batch.schema.names)


def _unpack(column) -> Iterator[bytes]:
    tool = zstandard.ZstdDecompressor()
    return (tool.decompress(t.as_py()) for t in column)


def _cell_strings(length: int):
    """(text, row, [(core, p, s, e)]) to strings for the sort by left context:
    key is the core and the text from the anchor back to the cell's start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, row, cells in zip(_unpack(batch.column(0)), batch.column(1).to_pylist(),
                                        batch.column(2).to_pylist()):
                for c in cells:
                    core, p, s, e = c["core"], c["p"], c["s"], c["e"]
                    key = struct.pack(">q", core) + text[s:p][::-1]
                    # The rest: how many windows, and the text from the anchor to the last window's end.
                    for column, v in zip(out, (key, row, s, struct.pack("<I", e - s) + text[p:e - 1 + length])):
                        column.append(v)
            yield pa.record_batch({"key": pa.array(out[0], pa.binary()), "row": pa.array(out[1], pa.int64()),
                                   "at": pa.array(out[2], pa.int64()), "rest": pa.array(out[3], pa.binary())})
    return run


_STRING = pa.schema([("key", pa.binary()), ("row", pa.int64()), ("at", pa.int64()), ("rest", pa.binary())])
_COVER = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _starts(items: Iterator[tuple[int, Item]], following: Splitter | None, first: bool) -> Iterator[tuple]:
    """Suffixes from every place where a cell and another of its core part to the left.

    Those places are the running minima of the common prefixes to either side.
    """
    def suffixes(group: list[tuple[int, Item]], beyond: tuple[int | None, int | None]) -> Iterator[tuple]:
        """``beyond``: common left context of the group's first and last item
        with what may lie before and after the range (None: nothing of the core)."""
        # shared[i]: bytes of left context that items i - 1 and i have in common.
        shared = [h - 8 for h, _ in group]
        parts: list[set[int]] = [set() for _ in group]
        for order, link, reach in ((range(len(group)), 0, beyond[0]), (range(len(group) - 1, -1, -1), 1, beyond[1])):
            minima: list[int] = []  # ascending
            for j, i in enumerate(order):
                if j:
                    h = shared[i + link]
                    while minima and minima[-1] > h:
                        minima.pop()
                    if not minima or minima[-1] < h:
                        minima.append(h)
                    reach = None if reach is None else min(reach, h)
                parts[i].update(minima)
                if reach is not None:
                    parts[i].update(range(reach + 1))
        for (_, (key, row, s, rest)), places in zip(group, parts):
            left = key[:7:-1]
            count, = struct.unpack_from("<I", rest)
            text = left + rest[4:]
            # Windows start at s to s + count - 1, the anchor is at s + len(left).
            for v in places | {len(left)}:
                if 0 <= len(left) - v < count:
                    yield text[len(left) - v:], row, s + len(left) - v, b""

    group: list[tuple[int, Item]] = []
    before = None if first else -1
    for h, item in items:
        if group and item[0][:8] != group[-1][1][0][:8]:
            yield from suffixes(group, (before if before is None else len(group[0][1][0]) - 8, None))
            group, before = [], None
        group.append((h, item))
    if group:
        last = group[-1][1][0]
        after = None
        if following is not None and following[0][:8] == last[:8]:
            after = common_prefix(last, following[0], 8) - 8
        yield from suffixes(group, (before if before is None else len(group[0][1][0]) - 8, after))


def _covered(length: int):
    """Sorted suffixes to covered bytes (row, a, b)."""
    def read(items: Iterator[tuple[int, Item]], following: Splitter | None, first: bool) -> Iterator[tuple]:
        before: Item | None = None
        best = 0
        for h, item in items:
            if before is not None:
                if max(best, h) >= length:
                    yield before[1], before[2], before[2] + max(best, h)
                best = h
            before = item
        if before is not None:
            h = common_prefix(before[0], following[0]) if following is not None else 0
            if max(best, h) >= length:
                yield before[1], before[2], before[2] + max(best, h)
            if h >= length:  # the next range does not see this neighbour of its first item
                yield following[1], following[2], following[2] + h
    return read


def numbered_texts(docs: DataFrame) -> DataFrame:
    """(text, row, doc_id), written: UTF-8 bytes of every text (null: empty) and a number of its row."""
    return written(docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "numbered-texts")


def repeated_bytes(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, a, b) of :func:`numbered_texts`: stretches of the bytes that a repeated string
    of ``length`` bytes covers; stretches may overlap, their union is all."""
    lists = ", ".join(f"{c} array<long>" for c in _CELL)
    cells = written(texts.select("text", "row").mapInArrow(_cells_of(length), f"row long, {lists}"), "cells")
    each = cells.select("row", F.explode(F.arrays_zip(*_CELL)).alias("c")).select("row", "c.*")
    # Checkpointed, so that the join deals out both sides itself and can split a hot core.
    repeated = materialize(each.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
                           .filter("n > 1").select("core"))
    alike = written(each.join(repeated, "core"), "cells-alike")
    classes = materialize(alike.groupBy("core", "cell", "half").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "p", "s", "e")).alias("one")))
    # One class may hold a large part of all cells: its rows are salted, its one class row repeated.
    salted = alike.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    repeats = classes.filter("n > 1").select(
        "core", "cell", "half", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    whole = (salted.join(repeats, ["core", "cell", "half", "salt"])
             .select("row", F.col("s").alias("a"), (F.col("e") - 1 + length).alias("b")))
    mixed = classes.groupBy("core").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("core")
    wanted = (classes.join(mixed, "core").select("core", "one.*").groupBy("row")
              .agg(F.collect_list(F.struct("core", "p", "s", "e")).alias("cells")))
    packed = texts.select("text", "row").mapInArrow(_packed, "text binary, row long")
    strings = written(packed.join(wanted, "row").select("text", "row", "cells").mapInArrow(
        _cell_strings(length), "key binary, row long, at long, rest binary"), "cell-strings")
    suffixes = written(sorted_ranges(strings, _starts, _STRING), "suffixes")
    covered = sorted_ranges(suffixes, _covered(length), _COVER)
    return whole.union(covered)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, [(a, b)]) to the figures of each text and what is left of it."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, spans in zip(_unpack(batch.column(0)), batch.column(2).to_pylist()):
            kept, removed, n, at, stop = [], 0, 0, 0, -1
            for x in sorted(spans or [], key=lambda x: x["a"]):
                if x["a"] > stop:  # a new run: bytes up to it stay
                    kept.append(text[at:x["a"]])
                    n, stop = n + 1, x["a"]
                if x["b"] > stop:
                    removed, stop = removed + x["b"] - stop, x["b"]
                at = stop
            kept.append(text[at:])
            left = b"".join(kept)
            for column, v in zip(out, (len(text), removed, n, hashlib.sha256(left).hexdigest(), left)):
                column.append(v)
        yield pa.record_batch({"doc_id": batch.column(1)} | {k: pa.array(v, t) for k, v, t in zip(
            ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), out,
            (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    texts = numbered_texts(docs)
    spans = (repeated_bytes(texts, length).groupBy("row")
             .agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    packed = texts.mapInArrow(_packed, "text binary, row long, doc_id long")
    return (packed.join(spans, "row", "left").select("text", "doc_id", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
