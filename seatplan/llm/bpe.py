"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is split by a pattern; each piece is merged on its own.  Distinct
pieces are bucketed by length into padded matrices of token ids, one row a
piece.  Each round looks up all neighbouring pairs in a hash table, and every
row merges its leftmost pair of minimum rank; equal pairs further right in the
row merge in the same round where the order cannot matter (no pair that the
new token can form ranks before it).  Rows without a pair left are taken out,
and the matrix is compacted to the rows and columns still in use.

A piece of more than ``LONG`` bytes is cut into overlapping blocks, which are rows
like any others, so its time grows with its length.  Two blocks are joined
at a token that both have at the same bytes of their overlap.  That is exact:
a sequence of tokens is the encoding of its bytes if each two neighbours are
that of theirs (the first merge over a border of the sequence would be made in
these two tokens alone as well), and all neighbours stand side by side in one
block.  Blocks without a common token are encoded as one, in doubling sizes.

Results equal those of the tiktoken library without special tokens: the
pieces are those of the Unicode tables of the tiktoken library, and ranks are
looked up by the bytes of a pair.

Defined results: null and empty texts have no tokens; texts of any length are
encoded whole; repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a worker remembers before it forgets all.
CACHE_PIECES = 300_000
#: Characters handled at once, and cells of one matrix.
CHUNK, CELLS = 1_000_000, 2_000_000
#: Bytes of a piece that is cut, of a block's own part, of its overlap with the next (at most the own part).
LONG, BLOCK, OVERLAP = 512, 128, 64
_NONE = np.int64(1) << 40  # a rank above all


class PairTable:
    """Open-addressing hash table from pairs of token ids to ranks, looked up by whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.array([a << 24 | b for a, b in pairs], np.int64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, at = self._slots(keys), np.arange(len(keys))
        while len(at):
            free = self.keys[slot[at]] < 0
            took, first = np.unique(slot[at[free]], return_index=True)
            won = at[free][first]
            self.keys[took], self.ranks[took] = keys[won], ranks[won]
            at = np.setdiff1d(at, won, assume_unique=True)
            slot[at] = (slot[at] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``_NONE`` for pairs that do not merge."""
        keys = left.astype(np.int64) << 24 | right
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], _NONE)
        at = np.flatnonzero((found != keys) & (found >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            found = self.keys[slot[at]]
            hit = found == keys[at]
            out[at[hit]] = self.ranks[slot[at[hit]]]
            at = at[~hit & (found >= 0)]
        return out


class Encoder:
    """Encoding and decoding with the ranks of one file."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.names = [str(i) for i in range(len(self.tokens))]
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks}
        self.table = PairTable(pairs)
        # steady[r]: no pair with token r ranks before r, so equal pairs of rank r may merge together.
        lowest = np.full(len(self.tokens), _NONE)
        for (a, b), r in pairs.items():
            lowest[a] = min(lowest[a], r)
            lowest[b] = min(lowest[b], r)
        self.steady = lowest > np.arange(len(self.tokens))
        self.split = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}

    def merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece; long pieces as blocks that are joined afterwards."""
        long = {i: [(at, min(len(r), at + BLOCK + OVERLAP)) for at in range(0, len(r) - OVERLAP, BLOCK)]
                for i, r in enumerate(rows) if len(r) > LONG}
        if not long:
            return self._merge_rows(rows)
        blocks = [rows[i][a:b] for i, cuts in long.items() for a, b in cuts]
        out = self._merge_rows([b"" if i in long else r for i, r in enumerate(rows)] + blocks)
        found = iter(out[len(rows):])
        for i, cuts in long.items():
            out[i] = self._joined(rows[i], cuts, [next(found) for _ in cuts])
        return out[:len(rows)]

    def _places(self, ids: np.ndarray, start: int) -> np.ndarray:
        """Where each token starts, and after the last one where it ends."""
        return start + np.concatenate(([0], np.cumsum(self.sizes[ids])))

    def _joined(self, row: bytes, cuts: list[tuple[int, int]], found: list[np.ndarray]) -> np.ndarray:
        """One encoding from those of overlapping blocks (start, stop)."""
        done: list[tuple[int, int, np.ndarray, int]] = []  # start, stop, ids, the first token that counts
        ends: list[int] = []                               # of all but the last: the token that is the next block's
        ahead = list(zip(cuts, found))[::-1]
        while ahead:
            (start, stop), ids = ahead.pop()
            if not done:
                done.append((start, stop, ids, 0))
                continue
            left_start, left_stop, left, _ = done[-1]
            a, b = self._places(left, left_start), self._places(ids, start)
            # A token is known by its place and its length.
            at, i, j = np.intersect1d(a[:-1] << 8 | np.diff(a), b[:-1] << 8 | np.diff(b), assume_unique=True, return_indices=True)
            if len(at):
                ends.append(int(i[0]))
                done.append((start, stop, ids, int(j[0])))
                continue
            # As one, with as many of the blocks that follow as double its size.
            done.pop()
            if ends:
                ends.pop()
            while ahead and stop - left_start < 2 * (left_stop - left_start):
                stop = ahead.pop()[0][1]
            ahead.append(((left_start, stop), self._merge_rows([row[left_start:stop]])[0]))
        return np.concatenate([ids[first:end] for (_, _, ids, first), end in zip(done, [*ends, None])])

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Token ids of each row; rows of like length share a padded matrix."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            # A bucket: lengths within a factor of 1.25, cells bounded.
            widest = max(int(lengths[order[at]] * 1.25), int(lengths[order[at]]))
            stop = min(int(np.searchsorted(lengths[order], widest, "right")), at + max(1, CELLS // widest))
            self._merge_bucket(rows, order[at:stop], lengths, out)
            at = stop
        return out

    def _merge_bucket(self, rows, which: np.ndarray, lengths: np.ndarray, out: list) -> None:
        n = lengths[which]
        width = int(n.max())
        inside = np.arange(width) < n[:, None]
        ids = np.full((len(which), width), -1, np.int64)
        ids[inside] = self.single[np.frombuffer(b"".join([rows[i] for i in which.tolist()]), np.uint8)]
        while True:
            rank = np.full((len(which), width), _NONE, np.int64)
            pair = inside[:, 1:]
            rank[:, :-1][pair] = self.table.rank(ids[:, :-1][pair], ids[:, 1:][pair])
            least = rank.min(1)
            done = least == _NONE
            if done.any():
                for r in np.flatnonzero(done).tolist():
                    out[which[r]] = ids[r, :n[r]].astype(np.int32)
                go = ~done
                which, n, least = which[go], n[go], least[go]
                if not len(which):
                    return
                width = int(n.max())
                ids, rank, inside = ids[go, :width], rank[go, :width], inside[go, :width]
            hit = rank == least[:, None]
            # Of adjoining hits every second merges; rows of an unsteady token merge the first alone.
            column = np.arange(width)
            before = np.maximum.accumulate(np.where(hit, -1, column), axis=1)
            hit &= (column - before) % 2 == 1
            hit &= self.steady[least][:, None] | (column == hit.argmax(1)[:, None])
            gone = np.zeros_like(hit)
            gone[:, 1:] = hit[:, :-1]
            ids = np.where(hit, least[:, None], ids)
            keep = inside & ~gone
            flat, n = ids[keep], keep.sum(1)
            width = int(n.max())
            inside = np.arange(width) < n[:, None]
            ids = np.full((len(which), width), -1, np.int64)
            ids[inside] = flat

    def split_text(self, text: str) -> list[str]:
        if _newer(text):
            shape = text.translate(_unassigned())
            return [text[m.start():m.end()] for m in self.split.finditer(shape)]
        return self.split.findall(text)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids (int32) of each text; pieces not met before are merged together, chunk by chunk."""
        start, size = 0, 0
        for stop in range(1, len(texts) + 1):
            size += len(texts[stop - 1])
            if size >= CHUNK or stop == len(texts):
                split = [self.split_text(t) for t in texts[start:stop]]
                new = list(set().union(*split) - self.pieces.keys())
                if len(self.pieces) + len(new) > CACHE_PIECES:
                    self.pieces.clear()
                    new = list(set().union(*split))
                self.pieces.update(zip(new, (i.tobytes() for i in self.merge([p.encode() for p in new]))))
                for pieces in split:
                    yield np.frombuffer(b"".join([self.pieces[p] for p in pieces]), np.int32)
                start, size = stop, 0

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


_newer = regex.compile(r"[^\x00-՗]").search


@functools.cache
def _unassigned() -> dict[int, int]:
    """Characters that this Python calls letters or numbers and the tiktoken
    library does not (its Unicode tables are older), mapped to one that neither does."""
    import tiktoken
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)},
                                  special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(every)).decode())
        out |= {ord(c): 0xE000 for c in regex.findall(kind, every) if c not in theirs}
    return out


@functools.cache
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


class Vocabulary:
    """A rank file and its pattern, sent to the tasks once (the file has about a MB)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank_file = f.read()
        self.pattern = pattern

    def encoder(self) -> Encoder:
        return _encoder(self.rank_file, self.pattern)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(0).to_pylist()]


def encode_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        for batch in batches:
            ids = list(vocabulary.encoder().encode_all(_texts(batch)))
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.record_batch({"doc_id": batch.column(1), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat)})
    return (docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))
            .mapInArrow(run, "doc_id long, ids array<int>"))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids); null ids decode to no bytes."""
    def run(batches):
        for batch in batches:
            e = vocabulary.encoder()
            out = [e.decode(np.array(ids or [], np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "bytes": pa.array(out, pa.binary())})
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encodes each text and decodes the ids in the same task, so that ids are
    not moved; digests are of the ids in decimal, joined by one space, and of
    the decoded bytes.
    """
    def run(batches):
        for batch in batches:
            e, n, a, b = vocabulary.encoder(), [], [], []
            for ids in e.encode_all(_texts(batch)):
                n.append(len(ids))
                names = e.names
                a.append(hashlib.sha256(" ".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
                b.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.record_batch({"doc_id": batch.column(1), "n_tokens": pa.array(n, pa.int64()),
                                   "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})
    return (docs.select(F.col("text").cast("string"), F.col("doc_id").cast("long"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
